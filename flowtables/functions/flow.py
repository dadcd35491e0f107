"""Expressions over the nested detector record: weights, lane and link merging, quality rules.

Everything stays inside the row, so merging a record never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Record status codes, fill value, normal one-minute ranges.
NORMAL, NODATA, ABNORMAL, REPAIR = 0, 1, 2, 3
FILL = -1.0
VOLUME_RANGE = (0, 311)
SPEED_RANGE = (0, 150)
OCCUPANCY_RANGE = (0, 100)


def pce_factor(vehicle_type: Column, m_pce=1.0, s_pce=1.0, l_pce=1.0, t_pce=1.0) -> Column:
    """Passenger-car equivalent of a vehicle type; unknown types count as one car."""
    return (
        F.when(vehicle_type == "M", F.lit(float(m_pce)))
        .when(vehicle_type == "S", F.lit(float(s_pce)))
        .when(vehicle_type == "L", F.lit(float(l_pce)))
        .when(vehicle_type == "T", F.lit(float(t_pce)))
        .otherwise(F.lit(1.0))
    )


def vehicle_count(vehicle: Column) -> Column:
    return vehicle["Volume"].try_cast("bigint")


def weighted_count(vehicle: Column, **pce) -> Column:
    return F.coalesce(vehicle_count(vehicle), F.lit(0)).cast("double") * pce_factor(vehicle["VehicleType"], **pce)


def reading(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def lane_volume(lane: Column, **pce) -> Column:
    total = F.aggregate(lane["Vehicles"], F.lit(0.0), lambda acc, v: acc + weighted_count(v, **pce))
    return F.coalesce(total, F.lit(0.0))


def _merge_link(link: Column, **pce) -> Column:
    lanes = F.transform(
        link["Lanes"],
        lambda lane: F.struct(
            lane_volume(lane, **pce).alias("v"),
            reading(lane["Speed"]).alias("s"),
            reading(lane["Occupancy"]).alias("o"),
        ),
    )
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("vs"), F.lit(0.0).alias("o"), F.lit(0).alias("n"))

    def add(acc, lane):
        return F.struct(
            (acc["v"] + lane["v"]).alias("v"),
            (acc["vs"] + lane["s"] * lane["v"]).alias("vs"),
            (acc["o"] + lane["o"]).alias("o"),
            (acc["n"] + 1).alias("n"),
        )

    def finish(acc):
        return F.struct(
            acc["v"].alias("Volume"),
            F.when(acc["v"] > 0, acc["vs"] / acc["v"]).otherwise(acc["vs"]).alias("Speed"),
            F.when(acc["n"] > 0, acc["o"] / acc["n"]).otherwise(acc["o"]).alias("Occupancy"),
        )

    return F.aggregate(F.coalesce(lanes, F.expr("cast(array() as array<struct<v:double,s:double,o:double>>)")), zero, add, finish)


def merge_links(links: Column, **pce) -> Column:
    """Each link with its vehicle types and lanes summed: LinkID, Volume, Speed, Occupancy."""
    merged = F.transform(links, lambda link: F.struct(link["LinkID"].alias("LinkID"), _merge_link(link, **pce).alias("m")))
    return F.transform(
        merged,
        lambda x: F.struct(x["LinkID"].alias("LinkID"), x["m"]["Volume"].alias("Volume"),
                           x["m"]["Speed"].alias("Speed"), x["m"]["Occupancy"].alias("Occupancy")),
    )


def _any(items: Column, test) -> Column:
    return F.coalesce(F.exists(items, test), F.lit(False))


def _outside(value: Column, bounds) -> Column:
    """True also for a missing or unreadable value."""
    return ~F.coalesce(value.between(*bounds), F.lit(False))


def status_hit(status: Column) -> Column:
    return ~F.coalesce(status.cast("string") == "0", F.lit(False))


def volume_hit(links: Column) -> Column:
    return _any(links, lambda link: _any(link["Lanes"], lambda lane: _any(
        lane["Vehicles"], lambda v: _outside(vehicle_count(v), VOLUME_RANGE))))


def speed_hit(links: Column) -> Column:
    return _any(links, lambda link: _any(
        link["Lanes"], lambda lane: _outside(lane["Speed"].try_cast("double"), SPEED_RANGE)))


def occupancy_hit(links: Column) -> Column:
    return _any(links, lambda link: _any(
        link["Lanes"], lambda lane: _outside(lane["Occupancy"].try_cast("double"), OCCUPANCY_RANGE)))


def data_status(status: Column, links: Column) -> Column:
    hit = status_hit(status) | volume_hit(links) | speed_hit(links) | occupancy_hit(links)
    return F.when(hit, F.lit(ABNORMAL)).otherwise(F.lit(NORMAL))


def blank_links(links: Column) -> Column:
    """The same links with every reading set to the fill value."""
    return F.transform(links, lambda link: F.struct(
        link["LinkID"].alias("LinkID"), F.lit(FILL).alias("Volume"),
        F.lit(FILL).alias("Speed"), F.lit(FILL).alias("Occupancy")))
