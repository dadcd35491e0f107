"""Repair of abnormal and missing minutes by interpolation between a link's valid readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtables.functions import flow
from flowtables.operators.grid import minute_grid

READINGS = ("Volume", "Speed", "Occupancy")
# Minutes sorted in one task; neighbours across pieces are found among the pieces' edge rows only.
PIECE = 1440


def neighbours(points: DataFrame, keys, order: str, value: Column, *, before: int, after: int, piece: int = PIECE) -> DataFrame:
    """Add prev1..prevN and next1..nextN: ``value`` of the rows before and after, per key.

    Rows are windowed per key and piece of ``piece`` order units. Only the first and last few rows of each
    piece take part in the second window over the whole key, which makes that window ``piece`` times smaller.
    """
    reach = max(before, after)
    local = Window.partitionBy(*keys, "_piece").orderBy(order)
    whole = Window.partitionBy(*keys).orderBy(order)
    wanted = {f"prev{i}": -i for i in range(1, before + 1)} | {f"next{i}": i for i in range(1, after + 1)}
    inside = points.withColumn("_piece", F.floor(F.col(order) / piece)).withColumn("_value", value)
    inside = inside.select(
        "*",
        (F.lag(order, reach).over(local).isNull() | F.lead(order, reach).over(local).isNull()).alias("_edge"),
        *[F.lead("_value", step).over(local).alias(name) for name, step in wanted.items()])
    edges = inside.where("_edge").select(
        *points.columns, "_piece", "_value", "_edge",
        *[F.coalesce(F.col(name), F.lead("_value", step).over(whole)).alias(name) for name, step in wanted.items()])
    return inside.where(~F.col("_edge")).unionByName(edges).drop("_piece", "_value", "_edge")


def _linear(name: str) -> Column:
    left, right = F.col("here"), F.col("next1")
    share = (F.col("minute") - left["minute"]) / (right["minute"] - left["minute"])
    return left[name] + (right[name] - left[name]) * share


def _cubic(name: str) -> Column:
    """Lagrange polynomial through two valid readings on each side; linear when one is lacking."""
    points = [F.col(c) for c in ("prev1", "here", "next1", "next2")]
    at = F.col("minute").cast("double")
    total = F.lit(0.0)
    for i, own in enumerate(points):
        term = own[name]
        for j, other in enumerate(points):
            if i != j:
                term = term * (at - other["minute"]) / (own["minute"] - other["minute"])
        total = total + term
    return F.when(F.col("prev1").isNotNull() & F.col("next2").isNotNull(), total).otherwise(_linear(name))


def repaired_cells(minutes: DataFrame, *, method: str = "linear", missing: bool = True) -> DataFrame:
    """VDID, minute, LinkID and interpolated readings for the minutes inside a link's gaps.

    A minute whose record is valid is never touched; a minute without any record only when ``missing``.
    """
    cubic = method == "polynomial"
    valid = minutes.where(F.col("DataStatus") == flow.NORMAL).select("VDID", "minute", F.inline("LinkFlows"))
    point = F.struct("minute", *READINGS)
    rows = neighbours(valid.withColumn("here", point), ("VDID", "LinkID"), "minute", point,
                      before=1 if cubic else 0, after=2 if cubic else 1)
    gaps = rows.where(F.col("next1.minute") > F.col("minute") + 1).drop(*READINGS)
    first, last = F.col("minute") + 1, F.col("next1.minute") - 1
    long = last - first >= PIECE  # cut into pieces: the minutes of one gap of years are no single row's array
    short = gaps.where(~long).withColumn("minute", F.explode(F.sequence(first, last)))
    gaps = short.unionByName(minute_grid(gaps.where(long).withColumnRenamed("minute", "_since"), F.col("_since") + 1, last).drop("_since"))
    formula = _cubic if cubic else _linear
    cells = gaps.select("VDID", "minute", "LinkID", *[formula(name).alias(name) for name in READINGS])
    status = minutes.select("VDID", "minute", F.col("DataStatus").alias("_was"))
    repairable = F.col("_was") == flow.ABNORMAL
    if missing:
        repairable = F.col("_was").isNull() | repairable
    return cells.join(status, ["VDID", "minute"], "left" if missing else "inner").where(repairable).drop("_was")


def repair_minutes(minutes: DataFrame, *, method: str = "linear", missing: bool = True) -> DataFrame:
    """The records with repaired minutes put in (status 3) and the unrepairable abnormal ones left."""
    fixed = (
        repaired_cells(minutes, method=method, missing=missing)
        .groupBy("VDID", "minute")
        .agg(F.sort_array(F.collect_list(F.struct("LinkID", *READINGS))).alias("Fixed"))
    )
    abnormal = F.coalesce(F.col("DataStatus") == flow.ABNORMAL, F.lit(True))
    repaired = F.col("Fixed").isNotNull() & abnormal
    joined = minutes.join(fixed, ["VDID", "minute"], "full" if missing else "left")
    return joined.select(
        "VDID", "minute",
        F.when(repaired, F.lit(flow.REPAIR)).otherwise(F.col("DataStatus")).alias("DataStatus"),
        F.when(repaired, F.col("Fixed")).otherwise(F.col("LinkFlows")).alias("LinkFlows"))


def repair_report(minutes: DataFrame, first: int, last: int, *, method: str = "linear") -> DataFrame:
    """One row per detector, link it ever reported, and minute of the range.

    Valid readings as they are, interpolated ones with status 3, the rest filled with -1 and status
    2 (abnormal record) or 1 (no record). A valid record without the link gives no row.
    """
    links = minutes.select("VDID", "DataStatus", "minute", F.inline("LinkFlows"))
    usable = F.col("DataStatus") == flow.NORMAL
    spans = links.groupBy("VDID", "LinkID").agg(
        F.min(F.when(usable, F.col("minute"))).alias("since"), F.max(F.when(usable, F.col("minute"))).alias("until"))
    before = F.struct(F.lit(first).cast("bigint").alias("low"), F.coalesce(F.col("since") - 1, F.lit(last)).cast("bigint").alias("high"))
    after = F.struct((F.col("until") + 1).alias("low"), F.lit(last).cast("bigint").alias("high"))
    ends = spans.select("VDID", "LinkID", F.inline(F.when(F.col("since").isNull(), F.array(before)).otherwise(F.array(before, after))))
    outside = minute_grid(ends, F.col("low"), F.col("high"))
    status = minutes.select("VDID", "minute", F.col("DataStatus").alias("_was"))
    unrepaired = outside.join(status, ["VDID", "minute"], "left").where(
        F.coalesce(F.col("_was") != flow.NORMAL, F.lit(True))).select(
        "VDID", "minute", "LinkID", F.coalesce("_was", F.lit(flow.NODATA)).alias("DataStatus"),
        *[F.lit(flow.FILL).alias(name) for name in READINGS])
    fixed = repaired_cells(minutes, method=method).withColumn("DataStatus", F.lit(flow.REPAIR))
    return links.where(usable).unionByName(fixed).unionByName(unrepaired)
