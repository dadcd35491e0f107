"""Streaming queries: each writes its input to files, runs the stream over all of it, returns the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtables.functions.timecols import trunc_minute
from flowtables.sources import tables
from flowtables.sources.scratch import scratch_path
from flowtables.streaming import streams
from flowtables.workload.detectors import ORIGIN, detector_sql, records
from flowtables.workload.flows import PCE, SQL_PCE, link_rows
from flowtables.workload.history import events
from flowtables.workload.registry import ntz, query

ROLLING, INTERVAL, DELAY = 6, 4, 5


@query("stream_upsert", """
SELECT user_id, ts AS time, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events""")
def stream_upsert(spark, sf_dir):
    """Two streams of single records into one table: the second gives a new kind and, for errors, a null value."""
    root = scratch_path(spark, "stream-table")
    rows = events(spark, sf_dir)
    user = F.col("user_id").cast("string").alias("SectionID")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("DataCollectTime")
    first = F.to_json(F.struct(user, time, F.lit("new").alias("kind"), "value"))
    patch = F.concat(F.lit('{"SectionID":"'), user, F.lit('","DataCollectTime":"'), time, F.lit('","kind":"'), F.col("event_type"),
                     F.when(F.col("event_type") == "error", F.lit('","value":null}')).otherwise(F.lit('"}')))
    for part in (first, patch):
        folder = scratch_path(spark, "stream-lines")
        rows.select(part.alias("value")).write.text(folder)
        run = streams.start_upsert(streams.read_lines(spark, folder), spark, root, "THB", "LiveTraffic",
                                   checkpoint=scratch_path(spark, "stream-state"), trigger={"availableNow": True})
        run.awaitTermination()
    stored = tables.scan(spark, root, "THB", "LiveTraffic")
    return stored.select(F.col("SectionID").cast("bigint").alias("user_id"), ntz("DataCollectTime", "time"),
                         F.col("extra")["kind"].alias("event_type"), F.col("extra")["value"].try_cast("double").alias("value"))


def _detector_stream(spark, sf_dir):
    folder = scratch_path(spark, "stream-records")
    records(spark, sf_dir).select("VDID", "DataCollectTime", "Status", "LinkFlows").write.parquet(folder)
    return spark.readStream.schema(streams.DETECTOR_STREAM).parquet(folder)


@query("stream_dedup", detector_sql() + "SELECT DISTINCT oid, date_trunc('minute', t) AS minute FROM record")
def stream_dedup(spark, sf_dir):
    """One record per detector and minute, the first to arrive."""
    stream = _detector_stream(spark, sf_dir).select(
        "VDID", "DataCollectTime", trunc_minute(F.col("DataCollectTime")).alias("Minute"))
    unique = streams.first_of_key(stream, "VDID", "Minute", time="DataCollectTime", delay="10 minutes")
    kept = streams.run_to_table(unique, scratch_path(spark, "stream-dedup"), scratch_path(spark, "stream-state"))
    return kept.select(F.col("VDID").alias("oid"), ntz("Minute", "minute"))


@query("stream_rolling", detector_sql(**SQL_PCE) + f""",
fst AS (
  SELECT oid, date_trunc('minute', t) AS minute, arg_min(t, t) AS first_t, arg_min(data_status, t) AS ds
  FROM record GROUP BY oid, date_trunc('minute', t)),
slots AS (
  SELECT slot FROM (SELECT unnest(generate_series(min(minute), max(minute), INTERVAL 1 MINUTE)) AS slot FROM fst)
  WHERE (date_diff('minute', TIMESTAMP '2021-01-01', slot) + {ROLLING}) % {INTERVAL} = 0
    AND slot + INTERVAL 1 MINUTE <= (SELECT max(t) FROM record) - INTERVAL {DELAY} MINUTE),
win AS (
  SELECT oid, slot, count(*) AS n, min(minute) AS first_minute
  FROM fst JOIN slots ON minute BETWEEN slot - INTERVAL {ROLLING - 1} MINUTE AND slot WHERE ds = 0 GROUP BY oid, slot),
linkwin AS (
  SELECT f.oid, slot, link_id, sum(volume) AS v, sum(speed * volume) AS sv, sum(occupancy) AS o, min(minute) AS link_first
  FROM fst f JOIN slots ON minute BETWEEN slot - INTERVAL {ROLLING - 1} MINUTE AND slot
  JOIN link l ON l.oid = f.oid AND l.t = f.first_t WHERE ds = 0 GROUP BY f.oid, slot, link_id)
SELECT w.oid, w.slot AS time, 0 AS status, link_id, round(v / n * {ROLLING}, 6) AS volume,
       round(CASE WHEN v = 0 THEN 0 ELSE sv / v END, 6) AS speed, round(o / n, 6) AS occupancy
FROM win w JOIN linkwin l ON l.oid = w.oid AND l.slot = w.slot AND l.link_first = w.first_minute""")
def stream_rolling(spark, sf_dir):
    """Rolling windows over a stream; the windows closed by the watermark come out."""
    flows = streams.rolling_flows(_detector_stream(spark, sf_dir), start=ORIGIN, interval=INTERVAL, rolling=ROLLING,
                                  delay=f"{DELAY} minutes", **PCE)
    return link_rows(streams.run_to_table(flows, scratch_path(spark, "stream-rolling"), scratch_path(spark, "stream-state")))


@query("stream_rolling_nulltime", detector_sql(**SQL_PCE) + f""",
fst AS (
  SELECT oid, date_trunc('minute', t) AS minute, arg_min(t, t) AS first_t, arg_min(data_status, t) AS ds
  FROM record GROUP BY oid, date_trunc('minute', t)),
slots AS (
  SELECT slot FROM (SELECT unnest(generate_series(TIMESTAMP '2021-01-01', max(minute), INTERVAL 1 MINUTE)) AS slot FROM fst)
  WHERE (date_diff('minute', TIMESTAMP '2021-01-01', slot) + {ROLLING}) % {INTERVAL} = 0
    AND slot + INTERVAL 1 MINUTE <= (SELECT max(t) FROM record) - INTERVAL {DELAY} MINUTE),
win AS (
  SELECT d.oid, s.slot, count(*) FILTER (ds = 0) AS n, count(*) FILTER (ds = 2) AS bad, min(minute) FILTER (ds = 0) AS first_minute
  FROM (SELECT DISTINCT oid FROM fst) d CROSS JOIN slots s
  LEFT JOIN fst f ON f.oid = d.oid AND minute BETWEEN slot - INTERVAL {ROLLING - 1} MINUTE AND slot GROUP BY d.oid, s.slot),
linkwin AS (
  SELECT f.oid, slot, link_id, sum(volume) AS v, sum(speed * volume) AS sv, sum(occupancy) AS o, min(minute) AS link_first
  FROM fst f JOIN slots ON minute BETWEEN slot - INTERVAL {ROLLING - 1} MINUTE AND slot
  JOIN link l ON l.oid = f.oid AND l.t = f.first_t WHERE ds = 0 GROUP BY f.oid, slot, link_id)
SELECT w.oid, w.slot AS time, CASE WHEN n > 0 THEN 0 WHEN bad = {ROLLING} THEN 2 ELSE 1 END AS status, link_id,
       round(v / n * {ROLLING}, 6) AS volume, round(CASE WHEN v = 0 THEN 0 ELSE sv / v END, 6) AS speed, round(o / n, 6) AS occupancy
FROM win w LEFT JOIN linkwin l ON l.oid = w.oid AND l.slot = w.slot AND l.link_first = w.first_minute""")
def stream_rolling_nulltime(spark, sf_dir):
    """Rolling windows over a stream with those that no usable record is in: state by detector, woken by timers."""
    flows = streams.rolling_windows(_detector_stream(spark, sf_dir), start=ORIGIN, interval=INTERVAL, rolling=ROLLING,
                                    delay=f"{DELAY} minutes", **PCE)
    return link_rows(streams.run_to_table(flows, scratch_path(spark, "stream-windows"), scratch_path(spark, "stream-state")))
