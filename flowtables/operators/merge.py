"""Merging vehicle types and lanes of detector records, in the four published shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.functions import flow
from flowtables.functions.timecols import trunc_minute


def sum_lanes_sum_vehicles(records: DataFrame, *, keep=(), m_pce=1.0, s_pce=1.0, l_pce=1.0, t_pce=1.0) -> DataFrame:
    """One row per record: VDID, Time (minute), DataStatus, LinkFlows[LinkID, Volume, Speed, Occupancy]."""
    pce = dict(m_pce=m_pce, s_pce=s_pce, l_pce=l_pce, t_pce=t_pce)
    return records.select(
        "VDID",
        trunc_minute(F.col("DataCollectTime")).alias("Time"),
        flow.data_status(F.col("Status"), F.col("LinkFlows")).alias("DataStatus"),
        flow.merge_links(F.col("LinkFlows"), **pce).alias("LinkFlows"),
        *keep,
    )


def _by_type(link, **pce):
    """Readings of one link split by vehicle type, types in order of first appearance."""
    lanes = link["Lanes"]
    entries = F.flatten(F.transform(lanes, lambda lane: F.transform(
        F.coalesce(lane["Vehicles"], F.expr("cast(array() as array<struct<VehicleType:string,Volume:bigint,Speed:double>>)")),
        lambda v: F.struct(
            v["VehicleType"].alias("t"),
            flow.weighted_count(v, **pce).alias("v"),
            flow.reading(lane["Speed"]).alias("s"),
        ))))
    occupancy = F.when(F.size(lanes) > 0, F.aggregate(
        lanes, F.lit(0.0), lambda acc, lane: acc + flow.reading(lane["Occupancy"])) / F.size(lanes)).otherwise(F.lit(0.0))

    def one(kind):
        mine = F.filter(entries, lambda e: e["t"].eqNullSafe(kind))
        volume = F.aggregate(mine, F.lit(0.0), lambda acc, e: acc + e["v"])
        moved = F.aggregate(mine, F.lit(0.0), lambda acc, e: acc + e["v"] * e["s"])
        return F.struct(kind.alias("VehicleType"), volume.alias("Volume"), moved.alias("Moved"), occupancy.alias("Occupancy"))

    return F.transform(F.array_distinct(F.transform(entries, lambda e: e["t"])), one)


def sum_lanes_per_vehicle(records: DataFrame, *, m_pce=1.0, s_pce=1.0, l_pce=1.0, t_pce=1.0) -> DataFrame:
    """One row per record, link and vehicle type."""
    pce = dict(m_pce=m_pce, s_pce=s_pce, l_pce=l_pce, t_pce=t_pce)
    links = F.transform("LinkFlows", lambda link: F.struct(
        link["LinkID"].alias("LinkID"), _by_type(link, **pce).alias("types")))
    return (
        records.select(
            "VDID", trunc_minute(F.col("DataCollectTime")).alias("Time"),
            flow.data_status(F.col("Status"), F.col("LinkFlows")).alias("DataStatus"),
            F.inline(links))
        .select("VDID", "Time", "DataStatus", "LinkID", F.inline("types"))
        .select(
            "VDID", "Time", "DataStatus", "LinkID", "VehicleType", "Volume",
            F.when(F.col("Volume") > 0, F.col("Moved") / F.col("Volume")).otherwise(F.col("Moved")).alias("Speed"),
            "Occupancy")
    )


def flatten_lanes(records: DataFrame) -> DataFrame:
    """One row per record, link and lane; the lane is its 0-based position. Time keeps its seconds."""
    return (
        records.select(
            "VDID", F.col("DataCollectTime").alias("Time"),
            flow.data_status(F.col("Status"), F.col("LinkFlows")).alias("DataStatus"),
            F.inline("LinkFlows"))
        .select("VDID", "Time", "DataStatus", "LinkID", F.posexplode("Lanes").alias("LaneIndex", "Lane"))
    )


def per_lane_sum_vehicles(records: DataFrame, *, m_pce=1.0, s_pce=1.0, l_pce=1.0, t_pce=1.0) -> DataFrame:
    lane = F.col("Lane")
    return flatten_lanes(records).select(
        "VDID", "Time", "DataStatus", "LinkID", "LaneIndex",
        flow.lane_volume(lane, m_pce=m_pce, s_pce=s_pce, l_pce=l_pce, t_pce=t_pce).alias("Volume"),
        lane["Speed"].try_cast("double").alias("Speed"),
        lane["Occupancy"].try_cast("double").alias("Occupancy"))


def per_lane_per_vehicle(records: DataFrame, *, m_pce=1.0, s_pce=1.0, l_pce=1.0, t_pce=1.0) -> DataFrame:
    vehicle = F.col("Vehicle")
    return flatten_lanes(records).select(
        "VDID", "Time", "DataStatus", "LinkID", "LaneIndex", "Lane",
        F.explode("Lane.Vehicles").alias("Vehicle"),
    ).select(
        "VDID", "Time", "DataStatus", "LinkID", "LaneIndex",
        vehicle["VehicleType"].alias("VehicleType"),
        flow.weighted_count(vehicle, m_pce=m_pce, s_pce=s_pce, l_pce=l_pce, t_pce=t_pce).alias("Volume"),
        F.col("Lane.Speed").try_cast("double").alias("Speed"),
        F.col("Lane.Occupancy").try_cast("double").alias("Occupancy"))


def flatten_raw(records: DataFrame) -> DataFrame:
    """The stored record as vehicle rows: no weights, no rules, all original readings."""
    return (
        records.select("VDID", "DataCollectTime", "Status", F.inline("LinkFlows"))
        .select("VDID", "DataCollectTime", "Status", "LinkID", F.posexplode("Lanes").alias("LaneIndex", "Lane"))
        .select("VDID", "DataCollectTime", "Status", "LinkID", "LaneIndex",
                F.col("Lane.Speed").alias("LaneSpeed"), F.col("Lane.Occupancy").alias("Occupancy"),
                F.inline("Lane.Vehicles"))
    )


def flatten_links(flows: DataFrame) -> DataFrame:
    """Merged records as link rows; a record without links keeps one row with null readings."""
    return flows.select("VDID", "Time", "DataStatus", F.inline_outer("LinkFlows"))
