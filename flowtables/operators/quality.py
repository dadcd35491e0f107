"""Quality flags and the treatment of abnormal merged records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.functions import flow


def flags(records: DataFrame) -> DataFrame:
    """One row per record with each rule's outcome and the resulting status."""
    status, links = F.col("Status"), F.col("LinkFlows")
    return records.select(
        "VDID", "DataCollectTime",
        flow.status_hit(status).alias("status_hit"),
        flow.volume_hit(links).alias("volume_hit"),
        flow.speed_hit(links).alias("speed_hit"),
        flow.occupancy_hit(links).alias("occupancy_hit"),
        flow.data_status(status, links).alias("DataStatus"),
    )


def drop_abnormal(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("DataStatus") == flow.NORMAL)


def fill_abnormal(flows: DataFrame) -> DataFrame:
    """Readings of records that are not normal become the fill value; the status stays."""
    normal = F.col("DataStatus") == flow.NORMAL
    return flows.withColumn(
        "LinkFlows", F.when(normal, F.col("LinkFlows")).otherwise(flow.blank_links(F.col("LinkFlows"))))


def treat_abnormal(flows: DataFrame, error_process: int) -> DataFrame:
    return drop_abnormal(flows) if error_process == 1 else fill_abnormal(flows)
