"""Scans, point and range reads, sorting and time functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtables.catalog import AUTHORITIES, CLASSES
from flowtables.functions.timecols import iso_text, parse_iso, to_local, trunc_minute
from flowtables.operators import lookup, merge
from flowtables.sources import tables
from flowtables.sources.scratch import scratch_path
from flowtables.workload.detectors import bounds, detector_sql, records
from flowtables.workload.registry import ntz, query, table

LIVE, PAIR = CLASSES["VDLive"], CLASSES["AVIPair"]
_RAW = """
SELECT v.oid, v.t AS time, v.link_id, lane_index, vehicle_type, v.volume
FROM vehicle v JOIN lane l ON l.oid = v.oid AND l.t = v.t AND l.link_id = v.link_id AND l.lane_no = v.lane_no"""
_ISO = "strftime({0} + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00'"


def raw_rows(rows):
    return merge.flatten_raw(rows).select(
        F.col("VDID").alias("oid"), ntz("DataCollectTime", "time"), F.col("LinkID").alias("link_id"),
        F.col("LaneIndex").cast("bigint").alias("lane_index"), F.col("VehicleType").alias("vehicle_type"),
        F.col("Volume").alias("volume"))


def events(spark, sf_dir):
    """Events with the time as an instant."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def pairs(spark, sf_dir):
    """A static class from orders: one pair per customer, a record per order date."""
    return table(spark, sf_dir, "orders").select(
        F.format_string("AP-%d", "o_custkey").alias("AVIPairID"), F.col("o_orderdate").cast("timestamp").alias("UpdateTime"),
        F.col("o_orderkey"), F.col("o_orderpriority"))


@query("scan_class", detector_sql() + """
SELECT authority, 'VDLive' AS dataclass, oid, t AS time FROM record
UNION ALL
SELECT CASE WHEN o_orderpriority < '3' THEN 'NFB' ELSE 'TNN' END, 'AVIPair', 'AP-' || o_custkey, o_orderdate FROM orders""")
def scan_class(spark, sf_dir):
    """Two classes written to one partitioned table, then every (authority, class) read by its own scan."""
    root = scratch_path(spark, "classes")
    tables.write(records(spark, sf_dir), root, LIVE)
    authority = F.when(F.col("o_orderpriority") < "3", F.lit("NFB")).otherwise(F.lit("TNN"))
    tables.write(pairs(spark, sf_dir).withColumn("authority", authority).drop("o_orderkey", "o_orderpriority"), root, PAIR)
    read = None
    for cls in (LIVE, PAIR):
        for name in AUTHORITIES:
            part = tables.scan(spark, root, name, cls.name).select(
                F.lit(name).alias("authority"), F.lit(cls.name).alias("dataclass"),
                F.col(cls.id_field).alias("oid"), ntz(cls.time_field, "time"))
            read = part if read is None else read.unionByName(part)
    return read


@query("filter_oid", detector_sql() + _RAW + " WHERE v.oid IN ('VD-7', 'VD-31')")
def filter_oid(spark, sf_dir):
    return raw_rows(lookup.by_id(records(spark, sf_dir), LIVE, ["VD-7", "VD-31"]))


@query("point_live", detector_sql() + _RAW + " WHERE v.t = (SELECT edate FROM p)")
def point_live(spark, sf_dir):
    """Every detector's record of one instant."""
    _, edate = bounds(spark, sf_dir)
    return raw_rows(lookup.at_time(records(spark, sf_dir), LIVE, edate))


@query("point_static", """
SELECT 'AP-' || o_custkey AS oid, o_orderdate AS time, o_orderkey AS item FROM orders
WHERE (o_custkey, o_orderdate) IN (SELECT (o_custkey, max(o_orderdate)) FROM orders GROUP BY o_custkey)""")
def point_static(spark, sf_dir):
    """Point reads for a table of keys: each pair's latest version."""
    static = pairs(spark, sf_dir)
    latest = static.groupBy("AVIPairID").agg(F.max("UpdateTime").alias("UpdateTime"))
    return lookup.at_points(static, PAIR, latest).select(
        F.col("AVIPairID").alias("oid"), ntz("UpdateTime", "time"), F.col("o_orderkey").alias("item"))


@query("range_live", detector_sql() + _RAW + ", p WHERE v.t BETWEEN p.sdate AND p.edate")
def range_live(spark, sf_dir):
    return raw_rows(lookup.in_range(records(spark, sf_dir), LIVE, *bounds(spark, sf_dir)))


@query("range_static", """
SELECT 'AP-' || o_custkey AS oid, o_orderdate AS time, o_orderkey AS item FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'""")
def range_static(spark, sf_dir):
    rows = lookup.in_range(pairs(spark, sf_dir), PAIR, "1996-01-01T00:00:00", "1999-12-31T08:00:00+08:00")
    return rows.select(F.col("AVIPairID").alias("oid"), ntz("UpdateTime", "time"), F.col("o_orderkey").alias("item"))


@query("raw_point", detector_sql() + f"""
SELECT v.oid, {_ISO.format('v.t')} AS local_time, v.link_id, lane_index, vehicle_type, v.volume
FROM vehicle v JOIN lane l ON l.oid = v.oid AND l.t = v.t AND l.link_id = v.link_id AND l.lane_no = v.lane_no
JOIN (SELECT oid, max(t) AS t FROM record GROUP BY oid) latest ON latest.oid = v.oid AND latest.t = v.t""")
def raw_point(spark, sf_dir):
    """The raw point query for every detector's latest record, time shown in local ISO form."""
    rows = records(spark, sf_dir)
    latest = rows.groupBy("VDID").agg(F.max("DataCollectTime").alias("DataCollectTime"))
    found = merge.flatten_raw(lookup.at_points(rows, LIVE, latest))
    return found.select(
        F.col("VDID").alias("oid"), iso_text(F.col("DataCollectTime")).alias("local_time"), F.col("LinkID").alias("link_id"),
        F.col("LaneIndex").cast("bigint").alias("lane_index"), F.col("VehicleType").alias("vehicle_type"),
        F.col("Volume").alias("volume"))


@query("raw_range", detector_sql() + f"""
SELECT v.oid, {_ISO.format('v.t')} AS local_time, v.link_id, lane_index, vehicle_type, v.volume
FROM vehicle v JOIN lane l ON l.oid = v.oid AND l.t = v.t AND l.link_id = v.link_id AND l.lane_no = v.lane_no
CROSS JOIN p WHERE v.t BETWEEN sdate AND edate""")
def raw_range(spark, sf_dir):
    """The raw range query, newest first."""
    rows = lookup.sorted_by_time(lookup.in_range(records(spark, sf_dir), LIVE, *bounds(spark, sf_dir)), LIVE, -1)
    return merge.flatten_raw(rows).select(
        F.col("VDID").alias("oid"), iso_text(F.col("DataCollectTime")).alias("local_time"), F.col("LinkID").alias("link_id"),
        F.col("LaneIndex").cast("bigint").alias("lane_index"), F.col("VehicleType").alias("vehicle_type"),
        F.col("Volume").alias("volume"))


@query("project_public", detector_sql() + "SELECT oid, t AS time, count(DISTINCT link_id) AS n_links, count(*) AS n_lanes FROM lane GROUP BY oid, t")
def project_public(spark, sf_dir):
    """Internal fields dropped, also inside the nested lanes."""
    public = lookup.public(records(spark, sf_dir)).withColumn("LinkFlows", lookup.without_vehicles(F.col("LinkFlows")))
    lanes = F.aggregate("LinkFlows", F.lit(0), lambda acc, link: acc + F.size(link["Lanes"]))
    return public.select(F.col("VDID").alias("oid"), ntz("DataCollectTime", "time"),
                         F.size("LinkFlows").cast("bigint").alias("n_links"), lanes.cast("bigint").alias("n_lanes"))


def _sort_query(name: str, sort: int, direction: str):
    @query(name, detector_sql() + f"SELECT oid, t AS time, row_number() OVER (PARTITION BY oid ORDER BY t {direction}) AS pos FROM record")
    def ordered(spark, sf_dir):
        placed = lookup.position_per_id(records(spark, sf_dir).select("VDID", "DataCollectTime"), LIVE, sort)
        return lookup.sorted_by_time(placed, LIVE, sort).select(
            F.col("VDID").alias("oid"), ntz("DataCollectTime", "time"), F.col("pos").cast("bigint").alias("pos"))


_sort_query("sort_time_asc", 1, "ASC")
_sort_query("sort_time_desc", -1, "DESC")


@query("parse_iso_time", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN ts - INTERVAL 8 HOUR END AS time FROM events""")
def parse_iso_time(spark, sf_dir):
    """Offset-aware parsing; text that is no time becomes null."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+08:00"))
    written = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(text)
    return events(spark, sf_dir).select("event_id", ntz(parse_iso(written), "time"))


@query("to_local_time", "SELECT event_id, ts + INTERVAL 8 HOUR AS local_time FROM events")
def to_local_time(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", ntz(to_local(F.col("ts")), "local_time"))


@query("trunc_minute", "SELECT event_id, date_trunc('minute', ts) AS time FROM events")
def trunc_to_minute(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", ntz(trunc_minute(F.col("ts")), "time"))


@query("iso_format", f"""
SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN {_ISO.format('ts')}
       ELSE strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+08:00' END AS iso_micros,
       {_ISO.format("date_trunc('second', ts)")} AS iso_seconds FROM events""")
def iso_format(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id", iso_text(F.col("ts")).alias("iso_micros"), iso_text(F.date_trunc("second", "ts")).alias("iso_seconds"))


@query("to_json_rows", "SELECT event_id AS id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+08:00' AS time, value, event_type AS kind FROM events")
def to_json_rows(spark, sf_dir):
    """Rows as JSON text, checked by reading the text back."""
    written = tables.json_rows(events(spark, sf_dir), "ts")
    return written.select(F.from_json("json", "event_id bigint, ts string, value double, event_type string").alias("j")).select(
        F.col("j.event_id").alias("id"), F.col("j.ts").alias("time"), F.col("j.value").alias("value"), F.col("j.event_type").alias("kind"))


@query("to_xml_rows", "SELECT event_id AS id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+08:00' AS time, value, event_type AS kind FROM events")
def to_xml_rows(spark, sf_dir):
    """Rows as XML elements, checked by reading the text back."""
    written = tables.xml_rows(events(spark, sf_dir), "Event", "ts")
    schema = "event_id bigint, ts string, value double, event_type string"
    return written.select(F.from_xml("xml", schema, {"rowTag": "Event"}).alias("x")).select(
        F.col("x.event_id").alias("id"), F.col("x.ts").alias("time"), F.col("x.value").alias("value"), F.col("x.event_type").alias("kind"))
