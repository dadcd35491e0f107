"""Detector records derived from ``lineitem``, in Spark and in SQL.

An order is one detector record: 50 detectors, a record every 40 seconds, so a minute has one or two
records or, where orders are absent, none. Line items become vehicle counts of a lane. Counts are summed
per (record, link, lane, type) before anything is collected into arrays, so a record holds at most
lanes x types entries however many line items share its key.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtables.workload.registry import table

ORIGIN = datetime(2021, 1, 1, tzinfo=timezone.utc)
SECONDS_PER_RECORD = 40
DETECTORS = 50

_VEHICLE_TYPE = """CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'M' WHEN l_returnflag = 'A' THEN 'S'
    WHEN l_returnflag = 'R' THEN 'L' WHEN l_linestatus = 'F' THEN 'T' ELSE 'X' END"""
_VOLUME = "CAST(l_quantity AS INT) * CASE WHEN l_partkey % 200 = 7 THEN 10 ELSE 1 END"
_STATUS = "CASE WHEN l_orderkey % 97 = 0 THEN '1' ELSE '0' END"
_AUTHORITY = "CASE WHEN l_orderkey % 50 < 20 THEN 'NFB' WHEN l_orderkey % 50 < 35 THEN 'THB' ELSE 'TNN' END"
_LANE_SPEED = "CASE WHEN min(min_part) % 331 = 5 THEN 200 ELSE 20 + min(min_part) % 100 END"
_LANE_OCCUPANCY = "sum(sum_supp) % 60 + CASE WHEN min(min_part) % 499 = 3 THEN 60 ELSE 0 END"
_VEHICLE_SPEED = "CASE WHEN vehicle_type = 'X' THEN NULL ELSE 20 + min_part % 80 END"


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order (a record), lane and vehicle type, keyed by the numbers the names derive from."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"{_VEHICLE_TYPE} AS vehicle_type", f"{_VOLUME} AS volume", "l_partkey", "l_suppkey")
    return rows.groupBy("l_orderkey", "l_linenumber", "vehicle_type").agg(
        F.sum("volume").alias("volume"), F.min("l_partkey").alias("min_part"), F.sum("l_suppkey").alias("sum_supp"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested detector records: authority, VDID, DataCollectTime, Status, LinkFlows.

    After one shuffle on the record key the three nesting steps run in place.
    """
    vehicle = F.struct(F.col("vehicle_type").alias("VehicleType"), F.col("volume").alias("Volume"),
                       F.expr(_VEHICLE_SPEED).cast("double").alias("Speed"))
    lanes = (
        vehicles(spark, sf_dir).repartition("l_orderkey")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.expr(_LANE_SPEED).cast("double").alias("Speed"), F.expr(_LANE_OCCUPANCY).cast("double").alias("Occupancy"),
             F.sort_array(F.collect_list(vehicle)).alias("Vehicles"))
    )
    links = lanes.groupBy("l_orderkey", F.expr("concat('LK-', l_linenumber % 2)").alias("LinkID")).agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "Speed", "Occupancy", "Vehicles"))).alias("Lanes"))
    lanes_without_number = F.transform("Lanes", lambda lane: F.struct(
        lane["Speed"].alias("Speed"), lane["Occupancy"].alias("Occupancy"), lane["Vehicles"].alias("Vehicles")))
    nested = links.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("LinkID", lanes_without_number.alias("Lanes")))).alias("LinkFlows"))
    return nested.selectExpr(
        f"{_AUTHORITY} AS authority", f"concat('VD-', l_orderkey % {DETECTORS}) AS VDID",
        f"timestamp_seconds({int(ORIGIN.timestamp())} + {SECONDS_PER_RECORD} * (l_orderkey DIV {DETECTORS})) AS DataCollectTime",
        f"{_STATUS} AS Status", "LinkFlows")


def bounds(spark: SparkSession, sf_dir: str) -> tuple[datetime, datetime]:
    """A time range inside the data: from minute 4 to three minutes before the last record's minute.

    The one value read on the driver is the largest order key, which Parquet statistics answer.
    """
    last_key = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0] or 0
    last = ORIGIN + timedelta(seconds=SECONDS_PER_RECORD * (last_key // DETECTORS))
    return ORIGIN + timedelta(minutes=4), last.replace(second=0) - timedelta(minutes=3)


def detector_sql(m=1.0, s=1.0, l=1.0, t=1.0) -> str:
    """CTEs vehicle, lane, record, link and p (the range bounds)."""
    return f"""
WITH vehicle AS (
  SELECT {_AUTHORITY} AS authority, 'VD-' || (l_orderkey % 50) AS oid,
         TIMESTAMP '2021-01-01 00:00:00' + to_seconds({SECONDS_PER_RECORD} * (l_orderkey // {DETECTORS})) AS t,
         {_STATUS} AS status, 'LK-' || (l_linenumber % 2) AS link_id, l_linenumber AS lane_no,
         {_VEHICLE_TYPE} AS vehicle_type, CAST(sum({_VOLUME}) AS BIGINT) AS volume,
         min(l_partkey) AS min_part, sum(l_suppkey) AS sum_supp
  FROM lineitem GROUP BY ALL),
lane AS (
  SELECT authority, oid, t, status, link_id, lane_no,
         row_number() OVER (PARTITION BY oid, t, link_id ORDER BY lane_no) - 1 AS lane_index,
         CAST({_LANE_SPEED} AS DOUBLE) AS speed, CAST({_LANE_OCCUPANCY} AS DOUBLE) AS occupancy,
         CAST(sum(volume * CASE vehicle_type WHEN 'M' THEN {m} WHEN 'S' THEN {s} WHEN 'L' THEN {l} WHEN 'T' THEN {t}
              ELSE 1 END) AS DOUBLE) AS volume,
         bool_or(volume < 0 OR volume > 311) AS volume_hit
  FROM vehicle GROUP BY authority, oid, t, status, link_id, lane_no),
record AS (
  SELECT authority, oid, t, status, status <> '0' AS status_hit, bool_or(volume_hit) AS volume_hit,
         bool_or(speed < 0 OR speed > 150) AS speed_hit, bool_or(occupancy < 0 OR occupancy > 100) AS occupancy_hit,
         CASE WHEN status <> '0' OR bool_or(volume_hit) OR bool_or(speed < 0 OR speed > 150)
              OR bool_or(occupancy < 0 OR occupancy > 100) THEN 2 ELSE 0 END AS data_status
  FROM lane GROUP BY authority, oid, t, status),
link AS (
  SELECT oid, t, link_id, sum(volume) AS volume,
         CASE WHEN sum(volume) > 0 THEN sum(speed * volume) / sum(volume) ELSE 0 END AS speed,
         sum(occupancy) / count(*) AS occupancy
  FROM lane GROUP BY oid, t, link_id),
p AS (SELECT TIMESTAMP '2021-01-01 00:04:00' AS sdate,
             date_trunc('minute', max(t)) - INTERVAL 3 MINUTE AS edate FROM record)
"""


def minutes_sql(rolling: int = 1, error_process: int = 0, descending: bool = False, **pce) -> str:
    """Adds fst: the record that stands for each detector and minute of the scan window."""
    keep = "AND data_status = 0" if error_process == 1 else ""
    pick = "arg_max" if descending else "arg_min"
    return detector_sql(**pce) + f""",
fst AS (
  SELECT oid, date_trunc('minute', t) AS minute, {pick}(t, t) AS first_t, {pick}(data_status, t) AS ds
  FROM record, p WHERE t BETWEEN sdate - INTERVAL {rolling - 1} MINUTE AND edate {keep}
  GROUP BY oid, date_trunc('minute', t)),
tpl AS (SELECT oid, {'max' if descending else 'min'}(first_t) AS first_t FROM fst GROUP BY oid)"""


def windows_sql(rolling: int, interval: int, error_process: int = 0, **pce) -> str:
    """Adds slots, win (per detector and slot) and linkwin (per link), straight from the index rule."""
    return minutes_sql(rolling, error_process, **pce) + f""",
slots AS (
  SELECT sdate - INTERVAL {rolling - 1} MINUTE + to_minutes(i) AS slot
  FROM (SELECT sdate, unnest(generate_series({rolling - 1}, date_diff('minute', sdate, edate) + {rolling - 1})) AS i FROM p)
  WHERE i % {interval} = {interval - 1}),
win AS (
  SELECT oid, slot, count(*) FILTER (ds = 0) AS n_valid, count(*) FILTER (ds = 2) AS n_abnormal,
         min(minute) FILTER (ds = 0) AS first_minute
  FROM fst JOIN slots ON minute BETWEEN slot - INTERVAL {rolling - 1} MINUTE AND slot GROUP BY oid, slot),
linkwin AS (
  SELECT f.oid, slot, link_id, sum(volume) AS v, sum(speed * volume) AS sv, sum(occupancy) AS o, min(minute) AS link_first
  FROM fst f JOIN slots ON minute BETWEEN slot - INTERVAL {rolling - 1} MINUTE AND slot
  JOIN link l ON l.oid = f.oid AND l.t = f.first_t WHERE ds = 0 GROUP BY f.oid, slot, link_id),
rolled AS (
  SELECT w.oid, w.slot AS time, 0 AS status, link_id, round(v / n_valid * {rolling}, 6) AS volume,
         round(CASE WHEN v = 0 THEN 0 ELSE sv / v END, 6) AS speed, round(o / n_valid, 6) AS occupancy
  FROM win w JOIN linkwin l ON l.oid = w.oid AND l.slot = w.slot AND l.link_first = w.first_minute
  WHERE n_valid > 0),
empties AS (
  SELECT d.oid, s.slot AS time, CASE WHEN coalesce(n_abnormal, 0) = {rolling} THEN 2 ELSE 1 END AS status, tpl.first_t
  FROM (SELECT DISTINCT oid FROM fst) d CROSS JOIN slots s JOIN tpl ON tpl.oid = d.oid
  LEFT JOIN win w ON w.oid = d.oid AND w.slot = s.slot WHERE coalesce(n_valid, 0) = 0)"""
