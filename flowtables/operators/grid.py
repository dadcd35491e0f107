"""The minute axis: first record per minute, template record per detector, minute grid, gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtables.functions import flow
from flowtables.functions.timecols import epoch_minute

# Grid steps produced by one task; longer grids are cut into pieces of this many steps.
GRID_PIECE = 1440


def first_by(order: Column, payload: Column, descending: bool) -> Column:
    """Aggregate: the payload with the smallest (largest) order; equal orders fall back to the payload itself.

    It is a partial aggregate, so a key that holds a large share of the rows is reduced before the shuffle.
    """
    pick = F.max if descending else F.min
    return pick(F.struct(order.alias("o"), payload.alias("p")))["p"]


def first_per_minute(flows: DataFrame, *, order="At", descending=False) -> DataFrame:
    """One merged record per detector and minute: VDID, minute, DataStatus, LinkFlows."""
    payload = F.struct("DataStatus", "LinkFlows")
    return (
        flows.groupBy("VDID", epoch_minute(F.col(order)).alias("minute"))
        .agg(first_by(F.col(order), payload, descending).alias("first"))
        .select("VDID", "minute", "first.DataStatus", "first.LinkFlows")
        # Every user of the result implies this filter; stated here, they share one shuffle.
        .where(F.col("VDID").isNotNull() & F.col("minute").isNotNull())
    )


def templates(minutes: DataFrame, *, descending=False) -> DataFrame:
    """Per detector its first record with every reading blanked: VDID, Template."""
    blank = flow.blank_links(F.col("LinkFlows"))
    return minutes.groupBy("VDID").agg(first_by(F.col("minute"), blank, descending).alias("Template"))


def minute_grid(detectors: DataFrame, first: int | Column, last: int | Column, step: int = 1) -> DataFrame:
    """Each detector row repeated for the minutes first, first+step, .. last; none where last < first.

    Built in two explodes with a shuffle between, so one detector's long range is spread over many tasks.
    """
    span = step * GRID_PIECE
    low, high = ((F.lit(x) if isinstance(x, int) else x).cast("bigint") for x in (first, last))
    pieces = detectors.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn(
        "_piece", F.explode(F.sequence(F.col("_low"), F.col("_high"), F.lit(span).cast("bigint"))))
    return pieces.repartition("VDID", "_piece").withColumn("minute", F.explode(F.sequence(
        F.col("_piece"), F.least(F.col("_piece") + (span - step), F.col("_high")), F.lit(step).cast("bigint")))).drop(
        "_piece", "_low", "_high")


def fill_missing_minutes(minutes: DataFrame, first: int, last: int, *, descending=False) -> DataFrame:
    """Every minute of every detector; a missing one gets the blanked template and the nodata status.

    The template travels on the grid rows, so the only join is on (VDID, minute).
    """
    grid = minute_grid(templates(minutes, descending=descending), first, last)
    found = F.col("DataStatus").isNotNull()
    return grid.join(minutes, ["VDID", "minute"], "left").select(
        "VDID", "minute",
        F.coalesce("DataStatus", F.lit(flow.NODATA)).alias("DataStatus"),
        F.when(found, F.col("LinkFlows")).otherwise(F.col("Template")).alias("LinkFlows"))
