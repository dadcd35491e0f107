"""Fixed, hopping and tumbling minute windows over many detectors.

Each record becomes fixed-width contribution rows: one for the record, one per link. Sums are taken in
hash aggregates keyed by detector, slot and link, with partial aggregation before the shuffle. When the
window is longer than the hop, contributions are first summed into buckets of gcd(window, hop) minutes,
so the hop copies buckets, not records.

Where a bucket is in many windows it is not copied at all. Time is cut into blocks as long as the window; a window is the end
of one block and the begin of the next, so running sums from each block's begin and from its end, one row of each, make up any
window. Nothing is subtracted: sums of nothing are exactly 0, and minima work like sums.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtables.functions import flow
from flowtables.operators.grid import minute_grid, templates

# A link's first sighting is minute * POSITIONS + position in the record: arrays have fewer than 2^31 elements,
# and minutes up to the year 9999 times that fit a BIGINT.
POSITION_BITS = 31
POSITIONS = 1 << POSITION_BITS
# Windows that a bucket may be copied into; beyond, running sums cost less.
MOST_COPIES = 8
TOTALS = ("first", "volume", "moved", "occupancy", "valid", "abnormal", "repaired")


def contributions(minutes: DataFrame, *, count_abnormal: bool) -> DataFrame:
    """VDID, lo, hi (covered minutes), LinkID (null on record rows) and the summable readings."""
    usable = F.col("DataStatus").isin(flow.NORMAL, flow.REPAIR)
    if not count_abnormal:
        minutes = minutes.where(usable)

    def row(is_link, link_id, first, volume, moved, occupancy, valid, abnormal, repaired):
        return F.struct(
            F.lit(is_link).alias("is_link"), link_id.cast("string").alias("LinkID"), first.alias("first"),
            volume.alias("volume"), moved.alias("moved"), occupancy.alias("occupancy"),
            valid.cast("bigint").alias("valid"), abnormal.cast("bigint").alias("abnormal"),
            repaired.cast("int").alias("repaired"))

    zero = F.lit(0.0)
    record = row(False, F.lit(None), F.when(usable, F.col("minute") * POSITIONS), zero, zero, zero,
                 usable, F.col("DataStatus") == flow.ABNORMAL, F.col("DataStatus") == flow.REPAIR)
    links = F.transform(
        F.when(usable, F.col("LinkFlows")),
        lambda link, at: row(True, link["LinkID"], F.col("minute") * POSITIONS + at, link["Volume"],
                             link["Speed"] * link["Volume"], link["Occupancy"], F.lit(0), F.lit(0), F.lit(0)))
    return minutes.select(
        "VDID", F.col("minute").alias("lo"), F.col("minute").alias("hi"),
        F.explode(F.when(links.isNull(), F.array(record)).otherwise(F.concat(F.array(record), links))).alias("c"),
    ).select("VDID", "lo", "hi", "c.*")


def _totals() -> list[Column]:
    """What is known of any set of contribution rows, from the same of its parts."""
    return [F.min("first").alias("first"), *[F.sum(name).alias(name) for name in ("volume", "moved", "occupancy", "valid", "abnormal")],
            F.max("repaired").alias("repaired")]


def _sums(rows: DataFrame, *at: str) -> DataFrame:
    return rows.groupBy("VDID", *at, "is_link", "LinkID").agg(*_totals())


def first_slot(start: int, interval: int, rolling: int) -> int:
    """The first slot at or after ``start``; slots are congruent to start - rolling modulo interval."""
    return start + (-rolling) % interval


def slots_of(lo: Column, hi: Column, *, start: int, end: int, interval: int, rolling: int) -> Column:
    """The slots whose window (slot - rolling, slot] covers the minutes lo..hi; null when there are none."""
    step = F.lit(interval).cast("bigint")
    first = F.greatest(hi + F.pmod(F.lit(start - rolling) - hi, step), F.lit(first_slot(start, interval, rolling)))
    last = F.least(lo + (rolling - 1), F.lit(end))
    return F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"), step))


def _to_buckets(rows: DataFrame, *, start: int, width: int) -> DataFrame:
    """Sum contributions over buckets of ``width`` minutes whose edges coincide with window edges."""
    lo = F.col("lo") - F.pmod(F.col("lo") - F.lit(start + 1), F.lit(width))
    return _sums(rows.withColumn("lo", lo), "lo").withColumn("hi", F.col("lo") + (width - 1))


def _running(rows: DataFrame, *, start: int, end: int, interval: int, rolling: int, width: int) -> DataFrame:
    """Rows whose sums by slot are those of the windows, at most two for each detector, link and slot, however long the window.

    A row of running sums stands for all slots up to where the next row changes them.
    """
    block = F.floor((F.col("lo") - (start + 1)) / rolling)
    rows = rows.select("VDID", "is_link", "LinkID", "lo", *TOTALS, (block * rolling + (start + 1)).alias("begin"))
    parts = Window.partitionBy("VDID", "is_link", "LinkID", "begin")
    up, down = parts.orderBy(F.col("lo").asc()), parts.orderBy(F.col("lo").desc())
    far = (Window.unboundedPreceding, Window.currentRow)
    totals = {name: (F.min if name == "first" else F.max if name == "repaired" else F.sum)(name) for name in TOTALS}
    until_here = F.struct(
        (F.col("lo") + (width - 1)).alias("from"),
        F.least(F.lead("lo").over(up) + (width - 2), F.col("begin") + (rolling - 1)).alias("to"),
        *[total.over(up.rowsBetween(*far)).alias(name) for name, total in totals.items()])
    from_here = F.struct(
        (F.coalesce(F.lead("lo").over(down), F.col("begin")) + rolling).alias("from"), (F.col("lo") + (rolling - 1)).alias("to"),
        *[total.over(down.rowsBetween(*far)).alias(name) for name, total in totals.items()])
    spans = rows.select("VDID", "is_link", "LinkID", until_here.alias("a"), from_here.alias("b"))
    spans = spans.select("VDID", "is_link", "LinkID", F.inline(F.array("a", "b")))
    step = F.lit(interval).cast("bigint")
    low = F.greatest(F.col("from") + F.pmod(F.lit(start - rolling) - F.col("from"), step), F.lit(first_slot(start, interval, rolling))).cast("bigint")
    high = F.least(F.col("to"), F.lit(end)).cast("bigint")
    return spans.withColumn("slot", F.explode(F.when(low <= high, F.sequence(low, high, step)))).drop("from", "to")


def slot_rows(rows: DataFrame, *, start: int, end: int, interval: int, rolling: int) -> DataFrame:
    """Contribution rows, or sums of them, by the slots they count for."""
    width = gcd(interval, rolling)
    if rolling > interval and width > 1:
        rows = _to_buckets(rows, start=start, width=width)
    if rolling > interval and rolling // width > MOST_COPIES:
        return _running(rows, start=start, end=end, interval=interval, rolling=rolling, width=width)
    slots = slots_of(F.col("lo"), F.col("hi"), start=start, end=end, interval=interval, rolling=rolling)
    return rows.withColumn("slot", F.explode(slots))


def window_sums(rows: DataFrame, *, start: int, end: int, interval: int, rolling: int) -> DataFrame:
    return _sums(slot_rows(rows, start=start, end=end, interval=interval, rolling=rolling), "slot")


def _link_readings(links: Column, valid: Column, first: Column, rolling: int) -> Column:
    """Links of the first valid minute only, in that record's order."""
    minute = lambda first_seen: F.shiftright(first_seen, POSITION_BITS)
    kept = F.sort_array(F.filter(links, lambda link: minute(link["first"]) == minute(first)))
    return F.transform(kept, lambda link: F.struct(
        link["LinkID"].alias("LinkID"),
        (link["volume"] / valid * rolling).alias("Volume"),
        F.when(link["volume"] == 0, F.lit(0.0)).otherwise(link["moved"] / link["volume"]).alias("Speed"),
        (link["occupancy"] / valid).alias("Occupancy")))


def roll(minutes: DataFrame, *, start: int, end: int, interval: int = 1, rolling: int = 1,
         empty_windows: bool = False, fill_template: bool = False, detectors: DataFrame | None = None,
         descending: bool = False) -> DataFrame:
    """Windows over one record per detector and minute: VDID, minute (the slot), DataStatus, LinkFlows.

    ``empty_windows`` adds the windows without a usable record, with the template's blanked links when
    ``fill_template`` is set and without links otherwise. ``detectors`` (VDID) may name the detectors of
    ``minutes`` where a narrow scan knows them.
    """
    sums = window_sums(contributions(minutes, count_abnormal=empty_windows),
                       start=start, end=end, interval=interval, rolling=rolling)
    blank = F.lit(None).cast("array<struct<LinkID: string, Volume: double, Speed: double, Occupancy: double>>")
    parts = sums.withColumn("Template", blank)
    if empty_windows:
        if fill_template:
            known = templates(minutes, descending=descending)
        else:
            known = (minutes if detectors is None else detectors).select("VDID").distinct().withColumn("Template", blank)
        grid = minute_grid(known, first_slot(start, interval, rolling), end, interval)
        parts = parts.unionByName(
            grid.select("VDID", F.col("minute").alias("slot"), F.lit(False).alias("is_link"), "Template",
                        F.lit(0).cast("bigint").alias("valid"), F.lit(0).cast("bigint").alias("abnormal")),
            allowMissingColumns=True)

    link = F.when(F.col("is_link"), F.struct("first", "LinkID", "volume", "moved", "occupancy"))
    record = lambda name: F.max(F.when(~F.col("is_link"), F.col(name)))
    windows = parts.groupBy("VDID", "slot").agg(
        record("valid").alias("valid"), record("abnormal").alias("abnormal"), record("repaired").alias("repaired"),
        record("first").alias("first"), F.collect_list(link).alias("links"),
        *([F.max("Template").alias("Template")] if fill_template else []))
    usable = F.col("valid") > 0
    if not empty_windows:
        windows = windows.where(usable)
    empty_links = F.col("Template") if fill_template else blank
    empty_status = F.when(F.col("abnormal") == rolling, F.lit(flow.ABNORMAL)).otherwise(F.lit(flow.NODATA))
    return windows.select(
        "VDID", F.col("slot").alias("minute"),
        F.when(~usable, empty_status).when(F.col("repaired") == 1, F.lit(flow.REPAIR))
        .otherwise(F.lit(flow.NORMAL)).alias("DataStatus"),
        F.when(usable, _link_readings(F.col("links"), F.col("valid"), F.col("first"), rolling))
        .otherwise(empty_links).alias("LinkFlows"))
