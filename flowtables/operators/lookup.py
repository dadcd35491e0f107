"""Point, range and sorted reads of a class table, for one id or many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtables.catalog import RecordClass
from flowtables.functions.timecols import instant_literal


def by_id(table: DataFrame, cls: RecordClass, oid) -> DataFrame:
    """``oid`` is one id or several."""
    ids = [oid] if isinstance(oid, str) else list(oid)
    return table.where(F.col(cls.id_field).isin(ids))


def at_time(table: DataFrame, cls: RecordClass, date) -> DataFrame:
    return table.where(F.col(cls.time_field) == instant_literal(date))


def in_range(table: DataFrame, cls: RecordClass, sdate, edate) -> DataFrame:
    """Both ends inclusive."""
    return table.where(F.col(cls.time_field).between(instant_literal(sdate), instant_literal(edate)))


def at_points(table: DataFrame, cls: RecordClass, points: DataFrame) -> DataFrame:
    """Point reads for a table of (id, time) pairs."""
    return table.join(points.select(*cls.key), list(cls.key), "left_semi")


def sorted_by_time(table: DataFrame, cls: RecordClass, sort=None) -> DataFrame:
    """``sort`` is 1, -1 or None; equal times are ordered by id."""
    if sort is None:
        return table
    if sort not in (1, -1):
        raise ValueError("sort must be 1, -1 or None")
    time = F.col(cls.time_field)
    return table.orderBy(time.asc() if sort == 1 else time.desc(), cls.id_field)


def position_per_id(table: DataFrame, cls: RecordClass, sort: int) -> DataFrame:
    """Rank of each record in its own id's history (1-based), counted in pieces of one day.

    A day's records are ranked inside (id, day); the records of earlier days are added from the daily
    counts. So a long history is never sorted in one task.
    """
    time = F.col(cls.time_field)
    direction = (lambda c: c.asc()) if sort == 1 else (lambda c: c.desc())
    days = table.withColumn("_day", F.date_trunc("day", time))
    day_key = [cls.id_field, "_day"]
    counts = days.groupBy(*day_key).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(cls.id_field).orderBy(direction(F.col("_day"))).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*day_key).orderBy(direction(time))
    return (
        days.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, day_key)
        .withColumn("pos", F.col("_offset") + F.col("_rank"))
        .drop("_day", "_rank", "_offset")
    )


def public(table: DataFrame) -> DataFrame:
    """Without the fields that are never shown."""
    return table.drop("_id", "SubAuthorityCode", "Status")


def without_vehicles(links: Column) -> Column:
    """Nested links with the vehicle entries taken out of each lane."""
    return F.transform(links, lambda link: link.withField(
        "Lanes", F.transform(link["Lanes"], lambda lane: lane.dropFields("Vehicles"))))
