"""Merge, quality, repair and window queries over the detector records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.functions import flow
from flowtables.functions.timecols import minute_instant, minute_of
from flowtables.operators import grid, merge, quality, repair, rolling
from flowtables.plans import traffic
from flowtables.workload.detectors import bounds, detector_sql, minutes_sql, records, windows_sql
from flowtables.workload.registry import ntz, query, r6

PCE = dict(m_pce=0.5, s_pce=1.0, l_pce=2.0, t_pce=3.0)
SQL_PCE = dict(m=0.5, s=1.0, l=2.0, t=3.0)
LINK_COLUMNS = "oid, time, status, link_id, volume, speed, occupancy"


def link_rows(flows: DataFrame) -> DataFrame:
    """Merged records as flat rows with the comparison names."""
    return merge.flatten_links(flows).select(
        F.col("VDID").alias("oid"), ntz("Time", "time"), F.col("DataStatus").alias("status"),
        F.col("LinkID").alias("link_id"), r6("Volume", "volume"), r6("Speed", "speed"), r6("Occupancy", "occupancy"))


def minute_rows(minutes: DataFrame) -> DataFrame:
    return link_rows(minutes.withColumn("Time", minute_instant(F.col("minute"))))


def range_query(spark, sf_dir, **arguments) -> DataFrame:
    sdate, edate = bounds(spark, sf_dir)
    return link_rows(traffic.time_range(records(spark, sf_dir), sdate, edate, **arguments))


def range_minutes(spark, sf_dir, **arguments) -> DataFrame:
    sdate, edate = bounds(spark, sf_dir)
    return traffic.range_minutes(records(spark, sf_dir), sdate, edate, **arguments)


_MERGED = """
SELECT l.oid, date_trunc('minute', l.t) AS time, r.data_status AS status, link_id,
       round(volume, 6) AS volume, round(speed, 6) AS speed, round(occupancy, 6) AS occupancy
FROM link l JOIN record r ON r.oid = l.oid AND r.t = l.t"""


@query("pce_weight", detector_sql() + """
SELECT vehicle_type, sum(volume) * CASE vehicle_type WHEN 'M' THEN 0.5 WHEN 'S' THEN 1.0 WHEN 'L' THEN 2.0
       WHEN 'T' THEN 3.0 ELSE 1.0 END::DOUBLE AS volume FROM vehicle GROUP BY vehicle_type""")
def pce_weight(spark, sf_dir):
    rows = merge.per_lane_per_vehicle(records(spark, sf_dir), **PCE)
    return rows.groupBy(F.col("VehicleType").alias("vehicle_type")).agg(F.sum("Volume").alias("volume"))


@query("lane_volume", detector_sql(**SQL_PCE) + "SELECT oid, t AS time, link_id, lane_index, volume FROM lane")
def lane_volume(spark, sf_dir):
    return merge.per_lane_sum_vehicles(records(spark, sf_dir), **PCE).select(
        F.col("VDID").alias("oid"), ntz("Time", "time"), F.col("LinkID").alias("link_id"),
        F.col("LaneIndex").cast("bigint").alias("lane_index"), F.col("Volume").alias("volume"))


@query("merge_slsv", detector_sql(**SQL_PCE) + _MERGED)
def merge_slsv(spark, sf_dir):
    return link_rows(merge.sum_lanes_sum_vehicles(records(spark, sf_dir), **PCE))


@query("one_record_slsv", detector_sql(**SQL_PCE) + _MERGED.replace("round(volume", "round(CASE WHEN r.data_status = 2 THEN -1 ELSE volume END").replace(
    "round(speed", "round(CASE WHEN r.data_status = 2 THEN -1 ELSE speed END").replace(
    "round(occupancy", "round(CASE WHEN r.data_status = 2 THEN -1 ELSE occupancy END") + """
JOIN (SELECT oid, max(t) AS t FROM record GROUP BY oid) latest ON latest.oid = l.oid AND latest.t = l.t""")
def one_record_slsv(spark, sf_dir):
    """Point read of every detector's latest record, merged with abnormal readings blanked."""
    from flowtables.operators.lookup import at_points

    table = records(spark, sf_dir)
    latest = table.groupBy("VDID").agg(F.max("DataCollectTime").alias("DataCollectTime"))
    return link_rows(traffic.one_record(at_points(table, traffic.DETECTOR, latest), error_process=2, **PCE))


@query("merge_slpv", detector_sql() + """
, kinds AS (
  SELECT v.oid, v.t, v.link_id, v.vehicle_type,
         sum(v.volume * f) AS volume, sum(l.speed * v.volume * f) AS moved
  FROM (SELECT *, CASE vehicle_type WHEN 'M' THEN 0.5 WHEN 'S' THEN 1.0 WHEN 'L' THEN 2.0 WHEN 'T' THEN 3.0 ELSE 1.0 END::DOUBLE AS f
        FROM vehicle) v
  JOIN lane l ON l.oid = v.oid AND l.t = v.t AND l.link_id = v.link_id AND l.lane_no = v.lane_no
  GROUP BY v.oid, v.t, v.link_id, v.vehicle_type)
SELECT k.oid, date_trunc('minute', k.t) AS time, r.data_status AS status, k.link_id, vehicle_type, round(k.volume, 6) AS volume,
       round(CASE WHEN k.volume > 0 THEN moved / k.volume ELSE moved END, 6) AS speed, round(occupancy, 6) AS occupancy
FROM kinds k JOIN record r ON r.oid = k.oid AND r.t = k.t
JOIN link ON link.oid = k.oid AND link.t = k.t AND link.link_id = k.link_id""")
def merge_slpv(spark, sf_dir):
    return merge.sum_lanes_per_vehicle(records(spark, sf_dir), **PCE).select(
        F.col("VDID").alias("oid"), ntz("Time", "time"), F.col("DataStatus").alias("status"),
        F.col("LinkID").alias("link_id"), F.col("VehicleType").alias("vehicle_type"),
        r6("Volume", "volume"), r6("Speed", "speed"), r6("Occupancy", "occupancy"))


@query("merge_plsv", detector_sql(**SQL_PCE) + """
SELECT l.oid, l.t AS time, r.data_status AS status, link_id, lane_index, volume, speed, occupancy
FROM lane l JOIN record r ON r.oid = l.oid AND r.t = l.t""")
def merge_plsv(spark, sf_dir):
    return merge.per_lane_sum_vehicles(records(spark, sf_dir), **PCE).select(
        F.col("VDID").alias("oid"), ntz("Time", "time"), F.col("DataStatus").alias("status"),
        F.col("LinkID").alias("link_id"), F.col("LaneIndex").cast("bigint").alias("lane_index"),
        F.col("Volume").alias("volume"), F.col("Speed").alias("speed"), F.col("Occupancy").alias("occupancy"))


@query("merge_plpv", detector_sql() + """
SELECT v.oid, v.t AS time, r.data_status AS status, v.link_id, lane_index, vehicle_type,
       v.volume * CASE vehicle_type WHEN 'M' THEN 0.5 WHEN 'S' THEN 1.0 WHEN 'L' THEN 2.0 WHEN 'T' THEN 3.0 ELSE 1.0 END::DOUBLE AS volume,
       l.speed, l.occupancy
FROM vehicle v JOIN record r ON r.oid = v.oid AND r.t = v.t
JOIN lane l ON l.oid = v.oid AND l.t = v.t AND l.link_id = v.link_id AND l.lane_no = v.lane_no""")
def merge_plpv(spark, sf_dir):
    return merge.per_lane_per_vehicle(records(spark, sf_dir), **PCE).select(
        F.col("VDID").alias("oid"), ntz("Time", "time"), F.col("DataStatus").alias("status"),
        F.col("LinkID").alias("link_id"), F.col("LaneIndex").cast("bigint").alias("lane_index"),
        F.col("VehicleType").alias("vehicle_type"),
        F.col("Volume").alias("volume"), F.col("Speed").alias("speed"), F.col("Occupancy").alias("occupancy"))


@query("flatten_raw", detector_sql() + """
SELECT v.oid, v.t AS time, v.status, v.link_id, lane_index, vehicle_type, v.volume, l.speed AS lane_speed, l.occupancy,
       CAST(CASE WHEN vehicle_type = 'X' THEN NULL ELSE 20 + v.min_part % 80 END AS DOUBLE) AS vehicle_speed
FROM vehicle v JOIN lane l ON l.oid = v.oid AND l.t = v.t AND l.link_id = v.link_id AND l.lane_no = v.lane_no""")
def flatten_raw(spark, sf_dir):
    return merge.flatten_raw(records(spark, sf_dir)).select(
        F.col("VDID").alias("oid"), ntz("DataCollectTime", "time"), F.col("Status").alias("status"),
        F.col("LinkID").alias("link_id"), F.col("LaneIndex").cast("bigint").alias("lane_index"),
        F.col("VehicleType").alias("vehicle_type"), F.col("Volume").alias("volume"),
        F.col("LaneSpeed").alias("lane_speed"), F.col("Occupancy").alias("occupancy"), F.col("Speed").alias("vehicle_speed"))


def _flag_query(name: str):
    @query(f"flag_{name}", detector_sql() + f"SELECT oid, t AS time, {name}_hit AS hit FROM record")
    def flag(spark, sf_dir):
        return quality.flags(records(spark, sf_dir)).select(
            F.col("VDID").alias("oid"), ntz("DataCollectTime", "time"), F.col(f"{name}_hit").alias("hit"))


for _rule in ("status", "volume", "speed", "occupancy"):
    _flag_query(_rule)


@query("data_status", detector_sql() + "SELECT oid, t AS time, data_status AS status FROM record")
def data_status(spark, sf_dir):
    return quality.flags(records(spark, sf_dir)).select(
        F.col("VDID").alias("oid"), ntz("DataCollectTime", "time"), F.col("DataStatus").alias("status"))


def _range_merged(blank: bool) -> str:
    value = "CASE WHEN data_status = 2 THEN -1.0 ELSE {0} END" if blank else "{0}"
    return f"""
SELECT l.oid, date_trunc('minute', l.t) AS time, data_status AS status, link_id,
       {', '.join(f'round({value.format(c)}, 6) AS {c}' for c in ('volume', 'speed', 'occupancy'))}
FROM link l JOIN record r ON r.oid = l.oid AND r.t = l.t CROSS JOIN p WHERE l.t BETWEEN sdate AND edate"""


@query("abnormal_keep", detector_sql(**SQL_PCE) + _range_merged(False))
def abnormal_keep(spark, sf_dir):
    return range_query(spark, sf_dir, error_process=0, **PCE)


@query("abnormal_drop", detector_sql(**SQL_PCE) + _range_merged(False) + " AND data_status = 0")
def abnormal_drop(spark, sf_dir):
    return range_query(spark, sf_dir, error_process=1, **PCE)


@query("abnormal_fill", detector_sql(**SQL_PCE) + _range_merged(True))
def abnormal_fill(spark, sf_dir):
    return range_query(spark, sf_dir, error_process=2, **PCE)


@query("first_per_minute", minutes_sql() + """
SELECT f.oid, minute AS time, ds AS status, link_id, round(volume, 6) AS volume, round(speed, 6) AS speed,
       round(occupancy, 6) AS occupancy FROM fst f JOIN link l ON l.oid = f.oid AND l.t = f.first_t""")
def first_per_minute(spark, sf_dir):
    sdate, edate = bounds(spark, sf_dir)
    return minute_rows(grid.first_per_minute(traffic.merged_range(records(spark, sf_dir), sdate, edate)))


@query("template_links", minutes_sql() + """
SELECT tpl.oid, link_id, -1.0::DOUBLE AS volume FROM tpl JOIN link l ON l.oid = tpl.oid AND l.t = tpl.first_t""")
def template_links(spark, sf_dir):
    return grid.templates(range_minutes(spark, sf_dir)).select("VDID", F.inline("Template")).select(
        F.col("VDID").alias("oid"), F.col("LinkID").alias("link_id"), F.col("Volume").alias("volume"))


@query("minute_grid", minutes_sql() + """
SELECT oid, unnest(generate_series(sdate, edate, INTERVAL 1 MINUTE)) AS time FROM (SELECT DISTINCT oid FROM fst) CROSS JOIN p""")
def minute_grid(spark, sf_dir):
    sdate, edate = bounds(spark, sf_dir)
    detectors = range_minutes(spark, sf_dir).select("VDID").distinct()
    return grid.minute_grid(detectors, minute_of(sdate), minute_of(edate)).select(
        F.col("VDID").alias("oid"), ntz(minute_instant(F.col("minute")), "time"))


_GAPFILL = """
, cells AS (SELECT oid, unnest(generate_series(sdate, edate, INTERVAL 1 MINUTE)) AS minute
            FROM (SELECT DISTINCT oid FROM fst) CROSS JOIN p)
SELECT c.oid, c.minute AS time, coalesce(ds, 1) AS status, link_id,
       round(CASE WHEN ds = 0 THEN volume ELSE -1 END, 6) AS volume, round(CASE WHEN ds = 0 THEN speed ELSE -1 END, 6) AS speed,
       round(CASE WHEN ds = 0 THEN occupancy ELSE -1 END, 6) AS occupancy
FROM cells c JOIN tpl ON tpl.oid = c.oid LEFT JOIN fst f ON f.oid = c.oid AND f.minute = c.minute
JOIN link l ON l.oid = c.oid AND l.t = coalesce(f.first_t, tpl.first_t)"""


@query("gapfill_minute", minutes_sql(**SQL_PCE) + _GAPFILL)
def gapfill_minute(spark, sf_dir):
    return range_query(spark, sf_dir, error_process=2, null_time=1, sort=1, **PCE)


@query("gapfill_minute_desc", minutes_sql(descending=True, **SQL_PCE) + _GAPFILL)
def gapfill_minute_desc(spark, sf_dir):
    """Descending order: the last record of a minute stands for it, the last record is the template."""
    return range_query(spark, sf_dir, error_process=2, null_time=1, sort=-1, **PCE)


@query("window_slots", windows_sql(7, 5) + "SELECT oid, slot AS time, n_valid, n_abnormal FROM win")
def window_slots(spark, sf_dir):
    sdate, edate = bounds(spark, sf_dir)
    rows = rolling.contributions(range_minutes(spark, sf_dir, time_rolling=7), count_abnormal=True)
    sums = rolling.window_sums(rows, start=minute_of(sdate), end=minute_of(edate), interval=5, rolling=7)
    return sums.where(~F.col("is_link")).select(
        F.col("VDID").alias("oid"), ntz(minute_instant(F.col("slot")), "time"),
        F.col("valid").alias("n_valid"), F.col("abnormal").alias("n_abnormal"))


@query("rolling_hop", windows_sql(15, 5, **SQL_PCE) + f"SELECT {LINK_COLUMNS} FROM rolled")
def rolling_hop(spark, sf_dir):
    return range_query(spark, sf_dir, time_interval=5, time_rolling=15, **PCE)


@query("rolling_long", windows_sql(31, 3, **SQL_PCE) + f"SELECT {LINK_COLUMNS} FROM rolled")
def rolling_long(spark, sf_dir):
    """Windows of 31 minutes every three: no bucket fits, so running sums make them up."""
    return range_query(spark, sf_dir, time_interval=3, time_rolling=31, **PCE)


def _rolling_part(column: str, select: str):
    @query(f"rolling_{column}", windows_sql(7, 3, **SQL_PCE) + f"SELECT DISTINCT oid, time, {select} FROM rolled")
    def part(spark, sf_dir):
        rows = range_query(spark, sf_dir, time_interval=3, time_rolling=7, **PCE)
        return rows.select("oid", "time", *select.split(", ")).distinct()


for _name, _columns in (("volume", "link_id, volume"), ("speed", "link_id, speed"),
                        ("occupancy", "link_id, occupancy"), ("status", "status")):
    _rolling_part(_name, _columns)

_EMPTY = f"""
SELECT {LINK_COLUMNS} FROM rolled UNION ALL
SELECT oid, time, status, NULL, NULL, NULL, NULL FROM empties"""
_EMPTY_FILLED = f"""
SELECT {LINK_COLUMNS} FROM rolled UNION ALL
SELECT e.oid, time, status, link_id, -1, -1, -1 FROM empties e JOIN link l ON l.oid = e.oid AND l.t = e.first_t"""


@query("rolling_empty", windows_sql(1, 1) + "SELECT oid, time, status FROM empties")
def rolling_empty(spark, sf_dir):
    """Only the windows without a usable record."""
    rows = range_query(spark, sf_dir, null_time=1)
    return rows.where(F.col("status").isin(flow.NODATA, flow.ABNORMAL)).select("oid", "time", "status")


@query("rolling_empty_fill", windows_sql(2, 2, 2, **SQL_PCE) + _EMPTY_FILLED)
def rolling_empty_fill(spark, sf_dir):
    return range_query(spark, sf_dir, error_process=2, null_time=1, time_interval=2, time_rolling=2, **PCE)


@query("rolling_hop_nulltime", windows_sql(2, 1, **SQL_PCE) + _EMPTY)
def rolling_hop_nulltime(spark, sf_dir):
    return range_query(spark, sf_dir, null_time=1, time_interval=1, time_rolling=2, **PCE)


@query("rolling_tumble", windows_sql(5, 5, 1, **SQL_PCE) + f"SELECT {LINK_COLUMNS} FROM rolled")
def rolling_tumble(spark, sf_dir):
    return range_query(spark, sf_dir, error_process=1, time_interval=5, time_rolling=5, **PCE)


@query("decimate", windows_sql(1, 4, **SQL_PCE) + f"SELECT {LINK_COLUMNS} FROM rolled")
def decimate(spark, sf_dir):
    return range_query(spark, sf_dir, time_interval=4, time_rolling=1, **PCE)


@query("time_range_slsv", windows_sql(6, 4, 2, **SQL_PCE) + f"""
SELECT {LINK_COLUMNS} FROM (SELECT * FROM rolled UNION ALL
SELECT e.oid, time, status, link_id, -1, -1, -1 FROM empties e JOIN link l ON l.oid = e.oid AND l.t = e.first_t)""")
def time_range_slsv(spark, sf_dir):
    """The whole time-range query: merge, flag, blank, first per minute, windows, empty windows, order."""
    return range_query(spark, sf_dir, error_process=2, null_time=1, time_interval=4, time_rolling=6, sort=1, **PCE)


_CELLS = """
, valid AS (SELECT f.oid, minute, link_id, volume, speed, occupancy FROM fst f JOIN link l ON l.oid = f.oid AND l.t = f.first_t WHERE ds = 0),
seen AS (SELECT DISTINCT f.oid, link_id FROM fst f JOIN link l ON l.oid = f.oid AND l.t = f.first_t),
cells AS (SELECT oid, link_id, unnest(generate_series(sdate, edate, INTERVAL 1 MINUTE)) AS minute FROM seen CROSS JOIN p),
around AS (
  SELECT c.oid, c.link_id, c.minute, v.volume, v.speed, v.occupancy, v.minute IS NOT NULL AS is_valid, ds,
         max(v.minute) OVER before AS m1, min(v.minute) OVER after AS m2
  FROM cells c LEFT JOIN valid v ON v.oid = c.oid AND v.link_id = c.link_id AND v.minute = c.minute
  LEFT JOIN fst f ON f.oid = c.oid AND f.minute = c.minute
  WINDOW before AS (PARTITION BY c.oid, c.link_id ORDER BY c.minute ROWS UNBOUNDED PRECEDING),
         after AS (PARTITION BY c.oid, c.link_id ORDER BY c.minute DESC ROWS UNBOUNDED PRECEDING))"""


@query("repair_linear", minutes_sql(**SQL_PCE) + _CELLS + f"""
SELECT a.oid, a.minute AS time, CASE WHEN is_valid THEN 0 WHEN m1 IS NOT NULL AND m2 IS NOT NULL THEN 3 WHEN ds = 2 THEN 2 ELSE 1 END AS status,
       a.link_id, {', '.join(f'''round(CASE WHEN is_valid THEN a.{c} WHEN m1 IS NULL OR m2 IS NULL THEN -1
         ELSE lo.{c} + (hi.{c} - lo.{c}) * (date_diff('minute', m1, a.minute) / date_diff('minute', m1, m2)) END, 6) AS {c}'''
                           for c in ('volume', 'speed', 'occupancy'))}
FROM around a
LEFT JOIN valid lo ON lo.oid = a.oid AND lo.link_id = a.link_id AND lo.minute = m1
LEFT JOIN valid hi ON hi.oid = a.oid AND hi.link_id = a.link_id AND hi.minute = m2
WHERE is_valid OR ds IS NULL OR ds = 2""")
def repair_linear(spark, sf_dir):
    sdate, edate = bounds(spark, sf_dir)
    minutes = range_minutes(spark, sf_dir, **PCE)
    return minute_rows_flat(repair.repair_report(minutes, minute_of(sdate), minute_of(edate)))


@query("time_range_repaired", windows_sql(1, 1, **SQL_PCE) + _CELLS + f"""
, fixed AS (
  SELECT a.oid, a.minute, a.link_id, {', '.join(f"lo.{c} + (hi.{c} - lo.{c}) * (date_diff('minute', m1, a.minute) / date_diff('minute', m1, m2)) AS {c}" for c in ('volume', 'speed', 'occupancy'))}
  FROM around a JOIN valid lo ON lo.oid = a.oid AND lo.link_id = a.link_id AND lo.minute = m1
  JOIN valid hi ON hi.oid = a.oid AND hi.link_id = a.link_id AND hi.minute = m2
  WHERE NOT is_valid AND (ds IS NULL OR ds = 2)),
every AS (SELECT oid, minute, link_id, volume, speed, occupancy, 0 AS status FROM valid
          UNION ALL SELECT oid, minute, link_id, volume, speed, occupancy, 3 FROM fixed),
whole AS (SELECT * FROM p CROSS JOIN (SELECT DISTINCT oid FROM fst)),
grid AS (SELECT oid, unnest(generate_series(sdate, edate, INTERVAL 1 MINUTE)) AS minute FROM whole)
SELECT g.oid, g.minute AS time, coalesce(e.status, CASE WHEN f.ds = 2 THEN 2 ELSE 1 END) AS status, e.link_id,
       round(e.volume, 6) AS volume,
       round(CASE WHEN e.volume = 0 THEN 0 ELSE e.speed END, 6) AS speed, round(e.occupancy, 6) AS occupancy
FROM grid g LEFT JOIN every e ON e.oid = g.oid AND e.minute = g.minute LEFT JOIN fst f ON f.oid = g.oid AND f.minute = g.minute""")
def time_range_repaired(spark, sf_dir):
    """Every minute of the range with abnormal and missing ones interpolated where a link's neighbours allow."""
    return range_query(spark, sf_dir, error_process=30, null_time=1, **PCE)


def minute_rows_flat(cells: DataFrame) -> DataFrame:
    return cells.select(
        F.col("VDID").alias("oid"), ntz(minute_instant(F.col("minute")), "time"), F.col("DataStatus").alias("status"),
        F.col("LinkID").alias("link_id"), r6("Volume", "volume"), r6("Speed", "speed"), r6("Occupancy", "occupancy"))


def _cubic_sql(column: str) -> str:
    at = "date_diff('minute', m1, a.minute)::DOUBLE"
    x = ["date_diff('minute', m1, q.m0)::DOUBLE", "0", "date_diff('minute', m1, q.n1)::DOUBLE", "date_diff('minute', m1, q.n2)::DOUBLE"]
    y = [f"q.{column}_{i}" for i in range(4)]
    terms = [y[i] + "".join(f" * ({at} - {x[j]}) / ({x[i]} - {x[j]})" for j in range(4) if j != i) for i in range(4)]
    linear = f"{y[1]} + ({y[2]} - {y[1]}) * ({at} / {x[2]})"
    return f"""round(CASE WHEN is_valid THEN a.{column} WHEN m1 IS NULL OR m2 IS NULL THEN -1
      WHEN q.m0 IS NULL OR q.n2 IS NULL THEN {linear} ELSE {' + '.join(terms)} END, 6) AS {column}"""


@query("repair_poly", minutes_sql(**SQL_PCE) + _CELLS + f"""
, q AS (
  SELECT oid, link_id, minute, lag(minute) OVER w AS m0, lead(minute) OVER w AS n1, lead(minute, 2) OVER w AS n2,
         {', '.join(f'lag({c}) OVER w AS {c}_0, {c} AS {c}_1, lead({c}) OVER w AS {c}_2, lead({c}, 2) OVER w AS {c}_3'
                    for c in ('volume', 'speed', 'occupancy'))}
  FROM valid WINDOW w AS (PARTITION BY oid, link_id ORDER BY minute))
SELECT a.oid, a.minute AS time, CASE WHEN is_valid THEN 0 WHEN m1 IS NOT NULL AND m2 IS NOT NULL THEN 3 WHEN ds = 2 THEN 2 ELSE 1 END AS status,
       a.link_id, {', '.join(map(_cubic_sql, ('volume', 'speed', 'occupancy')))}
FROM around a LEFT JOIN q ON q.oid = a.oid AND q.link_id = a.link_id AND q.minute = m1
WHERE is_valid OR ds IS NULL OR ds = 2""")
def repair_poly(spark, sf_dir):
    sdate, edate = bounds(spark, sf_dir)
    minutes = range_minutes(spark, sf_dir, **PCE)
    return minute_rows_flat(repair.repair_report(minutes, minute_of(sdate), minute_of(edate), method="polynomial"))
