"""JSON ingest, upsert and reject queries.

Events are live records keyed by (user, day); the event type decides which fields a record gives:
``value`` is absent for signup and purchase and an explicit null for error, ``props`` is absent for click.
Batches hold at most 64 events (or 50 cameras): rows of consecutive unique ids.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.catalog import CLASSES
from flowtables.functions import fieldtext
from flowtables.operators import upsert
from flowtables.sources import jsonrecords, tables
from flowtables.sources.scratch import scratch_path
from flowtables.workload.history import events
from flowtables.workload.registry import ntz, query, table

LIVE, STATIC = CLASSES["LiveTraffic"], CLASSES["CCTV"]
TARGET_TYPES = ("view", "signup")
BATCH_ROWS = 64
_DAY_TEXT = "date_format(date_trunc('DAY', ts), \"yyyy-MM-dd'T'HH:mm:ssXXX\")"


def event_fields(time_field: str = "DataCollectTime"):
    """The event as a field map with absent and null fields kept apart."""
    return F.expr(f"""map_from_entries(transform(filter(array(
        named_struct('k', '{LIVE.id_field}', 'v', cast(user_id AS string), 'given', true),
        named_struct('k', '{time_field}', 'v', {_DAY_TEXT}, 'given', true),
        named_struct('k', 'event_type', 'v', event_type, 'given', true),
        named_struct('k', 'props', 'v', props, 'given', event_type <> 'click'),
        named_struct('k', 'value', 'v', if(event_type = 'error', null, cast(value AS string)),
                     'given', event_type NOT IN ('signup', 'purchase'))
      ), x -> x.given), x -> struct(x.k, x.v)))""")


def keyed_events(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select(
        F.lit(None).cast("string").alias("header"), event_fields().alias("fields"),
        F.col("event_id").alias("seq"), "event_type")


def event_table(merged: DataFrame) -> DataFrame:
    fields = F.col("fields")
    return merged.select(
        F.col("id").cast("bigint").alias("user_id"), ntz("time", "day"), fields["event_type"].alias("event_type"),
        fieldtext.plain(fields["props"]).alias("props"), fieldtext.plain(fields["value"]).try_cast("double").alias("value"),
        F.map_contains_key(fields, "value").alias("has_value"))


def event_batches(rows: DataFrame) -> DataFrame:
    """Batch documents as JSON text: batch_no, text."""
    packed = rows.groupBy(F.expr(f"event_id DIV {BATCH_ROWS}").alias("batch_no")).agg(
        F.sort_array(F.collect_list(F.struct("event_id", F.map_entries(event_fields()).alias("f")))).alias("items"),
        F.max(F.expr(_DAY_TEXT)).alias("UpdateTime"))
    records = F.transform("items", lambda x: F.map_from_entries(x["f"])).alias(LIVE.container)
    return packed.select("batch_no", F.to_json(F.struct("UpdateTime", records)).alias("text"))


_EVENT_SQL = """
WITH e AS (SELECT user_id, date_trunc('day', ts) AS day, event_type, props, value,
                  CASE WHEN event_type IN ('view', 'signup') THEN 0 ELSE 1 END AS side, event_id
           FROM events),
s AS (SELECT *, {seq} AS seq FROM e)
SELECT user_id, day, arg_max_null(event_type, seq) AS event_type,
       arg_max_null(props, seq) FILTER (event_type <> 'click') AS props,
       arg_max_null(CASE WHEN event_type = 'error' THEN NULL ELSE value END, seq)
         FILTER (event_type NOT IN ('signup', 'purchase')) AS value,
       count(*) FILTER (event_type NOT IN ('signup', 'purchase')) > 0 AS has_value
FROM s GROUP BY user_id, day"""
_TARGET_FIRST = _EVENT_SQL.format(seq="side * 1000000000000 + event_id")
_BY_ARRIVAL = _EVENT_SQL.format(seq="event_id")


@query("upsert_field_merge", _TARGET_FIRST)
def upsert_field_merge(spark, sf_dir):
    """View and signup events are the stored table, the others one batch merged into it field by field."""
    keyed = keyed_events(spark, sf_dir)
    old = F.col("event_type").isin(*TARGET_TYPES)
    target = upsert.last_fields(upsert.key_live(keyed.where(old), LIVE))
    return event_table(upsert.merge_fields(target, upsert.key_live(keyed.where(~old), LIVE)))


@query("upsert_last_wins", _BY_ARRIVAL)
def upsert_last_wins(spark, sf_dir):
    """Repeated keys inside one batch: the later record's fields win."""
    return event_table(upsert.last_fields(upsert.key_live(keyed_events(spark, sf_dir), LIVE)))


@query("upsert_live_batch", _TARGET_FIRST)
def upsert_live_batch(spark, sf_dir):
    """The same merge with both sides read from batch documents; order is (batch, position)."""
    rows = events(spark, sf_dir)

    def side(old: bool) -> DataFrame:
        wanted = F.col("event_type").isin(*TARGET_TYPES)
        texts = event_batches(rows.where(wanted if old else ~wanted))
        return upsert.accepted(upsert.key_batch(jsonrecords.parse_batches(texts, "text", LIVE, order="batch_no"), LIVE))

    return event_table(upsert.merge_fields(upsert.last_fields(side(True)), side(False)))


@query("upsert_live_one", _BY_ARRIVAL)
def upsert_live_one(spark, sf_dir):
    """Single live records; purchases carry only an UpdateTime, which then is their key time."""
    rows = events(spark, sf_dir)
    purchase = F.col("event_type") == "purchase"
    own = F.when(purchase, event_fields("UpdateTime")).otherwise(event_fields())
    records = rows.select(F.lit(None).cast("string").alias("header"), own.alias("fields"), F.col("event_id").alias("seq"))
    return event_table(upsert.last_fields(upsert.key_live(records, LIVE)))


def camera_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("item"),
        F.create_map(F.lit("CCTVID"), F.concat(F.lit("CCTV-"), F.col("c_custkey")), F.lit("Name"), F.col("c_name"),
                     F.lit("Segment"), F.col("c_mktsegment")).alias("fields"))


def _camera_table(merged: DataFrame) -> DataFrame:
    return merged.select("id", ntz("time", "time"), F.col("fields")["Name"].alias("name"),
                         F.col("fields")["Segment"].alias("segment"),
                         F.col("fields")["UpdateTime"].alias("update_time"))


@query("upsert_static_batch", """
SELECT 'CCTV-' || c_custkey AS id, TIMESTAMP '2020-12-20 07:00:00' + to_hours(c_custkey // 50) AS time, c_name AS name,
       c_mktsegment AS segment,
       strftime(TIMESTAMP '2020-12-20 15:00:00' + to_hours(c_custkey // 50), '%Y-%m-%dT%H:%M:%S') || '+08:00' AS update_time
FROM customer""")
def upsert_static_batch(spark, sf_dir):
    """Records without a time take the batch's UpdateTime, as key and as field."""
    packed = camera_rows(spark, sf_dir).groupBy(F.expr("item DIV 50").alias("batch_no")).agg(
        F.sort_array(F.collect_list(F.struct("item", F.map_entries("fields").alias("e")))).alias("items"))
    header = F.expr("concat(date_format(timestamp'2020-12-20 15:00:00' + make_dt_interval(0, cast(batch_no AS int)), \"yyyy-MM-dd'T'HH:mm:ss\"), '+08:00')")
    records = F.transform("items", lambda x: F.map_from_entries(x["e"])).alias(STATIC.container)
    texts = packed.select("batch_no", F.to_json(F.struct(header.alias("UpdateTime"), records)).alias("text"))
    keyed = upsert.key_batch(jsonrecords.parse_batches(texts, "text", STATIC, order="batch_no"), STATIC)
    return _camera_table(upsert.last_fields(upsert.accepted(keyed)))


@query("upsert_static_one", """
SELECT 'CCTV-' || c_custkey AS id, TIMESTAMP '2020-12-20 07:00:00' AS time, c_name AS name, c_mktsegment AS segment,
       '2020-12-20T07:00:00.000000Z' AS update_time FROM customer""")
def upsert_static_one(spark, sf_dir):
    """Single static records keyed by the caller's date."""
    records = camera_rows(spark, sf_dir).select(F.lit(None).cast("string").alias("header"), "fields", F.col("item").alias("seq"))
    return _camera_table(upsert.last_fields(upsert.key_static(records, STATIC, "2020-12-20T15:00:00+08:00")))


@query("append_new_only", """
WITH e AS (SELECT user_id, date_trunc('day', ts) AS day, event_type, event_id FROM events)
SELECT user_id, day, arg_min(event_type, event_id) AS event_type FROM e
WHERE event_type NOT IN ('view', 'signup')
  AND (user_id, day) NOT IN (SELECT (user_id, day) FROM e WHERE event_type IN ('view', 'signup'))
GROUP BY user_id, day""")
def append_new_only(spark, sf_dir):
    """Insert-if-absent: only keys the table lacks, the first record of each."""
    keyed = keyed_events(spark, sf_dir)
    old = F.col("event_type").isin(*TARGET_TYPES)
    target = upsert.last_fields(upsert.key_live(keyed.where(old), LIVE))
    fresh = upsert.new_only(target, upsert.key_live(keyed.where(~old), LIVE))
    return event_table(fresh).select("user_id", "day", "event_type")


@query("key_violations", """
SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1""")
def key_violations(spark, sf_dir):
    """Keys that are not unique in the raw history."""
    rows = events(spark, sf_dir).select("user_id", F.date_trunc("minute", "ts").alias("at"))
    return upsert.key_violations(rows, "user_id", "at").select("user_id", ntz("at", "minute"), "n")


@query("reject_rows", """
SELECT event_id, CASE event_type WHEN 'signup' THEN 'no id' ELSE 'no time' END AS reason
FROM events WHERE event_type IN ('signup', 'error')""")
def reject_rows(spark, sf_dir):
    """Records without an id, or with a time that cannot be read, are set aside with the reason."""
    rows = events(spark, sf_dir)
    time = F.when(F.col("event_type") == "error", F.lit("yesterday")).otherwise(F.expr(_DAY_TEXT))
    user = F.when(F.col("event_type") != "signup", F.col("user_id").cast("string"))
    fields = F.create_map(F.lit(LIVE.id_field), user, F.lit("DataCollectTime"), time)
    records = rows.select(F.lit(None).cast("string").alias("header"), fields.alias("fields"), F.col("event_id").alias("seq"))
    return upsert.rejected(upsert.key_live(records, LIVE)).select(F.col("seq").alias("event_id"), "reason")


@query("ingest_json_batch", """
SELECT event_id // 64 AS batch_no, user_id, date_trunc('day', ts) AS day, event_type,
       CASE WHEN event_type IN ('error', 'signup', 'purchase') THEN NULL ELSE value END AS value,
       row_number() OVER (PARTITION BY event_id // 64 ORDER BY event_id) - 1 AS pos
FROM events""")
def ingest_json_batch(spark, sf_dir):
    """Batch documents written to files, one per line, and read by the batch source."""
    path = scratch_path(spark, "json-batches")
    texts = event_batches(events(spark, sf_dir))
    labelled = texts.select("batch_no", F.regexp_replace("text", '"UpdateTime":"[^"]*"', F.concat(
        F.lit('"UpdateTime":"'), F.col("batch_no").cast("string"), F.lit('"'))).alias("text"))
    labelled.select("text").write.text(path)
    read = jsonrecords.read_batches(spark, path, LIVE, multi_line=False)
    keyed = upsert.key_batch(read.withColumn("seq", F.struct("header", "seq")), LIVE)
    return keyed.select(
        F.col("seq.header").cast("bigint").alias("batch_no"), F.col("id").cast("bigint").alias("user_id"),
        ntz("time", "day"), F.col("fields")["event_type"].alias("event_type"),
        fieldtext.plain(F.col("fields")["value"]).try_cast("double").alias("value"), F.col("seq.seq._pos").cast("bigint").alias("pos"))


@query("ingest_json_lines", """
SELECT user_id, date_trunc('day', ts) AS day, event_type, CASE WHEN event_type <> 'click' THEN props END AS props,
       CASE WHEN event_type IN ('error', 'signup', 'purchase') THEN NULL ELSE value END AS value FROM events""")
def ingest_json_lines(spark, sf_dir):
    """Single-record documents, one per line."""
    path = scratch_path(spark, "json-lines")
    events(spark, sf_dir).select(F.to_json(event_fields())).write.text(path)
    return event_table(upsert.key_live(jsonrecords.read_records(spark, path), LIVE)).drop("has_value")


@query("upsert_table", """
WITH e AS (SELECT 'VD-' || user_id AS oid, date_trunc('day', ts) AS day, event_type, value, event_id,
                  CASE WHEN event_type IN ('view', 'signup') THEN 0 ELSE 1 END AS side FROM events),
s AS (SELECT *, side * 1000000000000 + event_id AS seq FROM e)
SELECT oid, day, arg_max_null(event_type, seq) AS status,
       arg_max_null(CASE WHEN event_type = 'error' THEN NULL ELSE value END, seq)
         FILTER (event_type NOT IN ('signup', 'purchase')) AS value
FROM s GROUP BY oid, day""")
def upsert_table(spark, sf_dir):
    """Two upserts into a stored columnar table, the second rewriting only the days it touches."""
    root = scratch_path(spark, "upserted")
    detector = CLASSES["VDLive"]
    named = events(spark, sf_dir)
    fields = F.transform_keys(event_fields(), lambda k, v: F.when(k == LIVE.id_field, F.lit("VDID")).when(
        k == "event_type", F.lit("Status")).otherwise(k))
    fields = F.transform_values(fields, lambda k, v: F.when(k == "VDID", F.concat(F.lit("VD-"), v)).otherwise(v))
    records = named.select(F.lit(None).cast("string").alias("header"), fields.alias("fields"),
                           F.col("event_id").alias("seq"), "event_type")
    old = F.col("event_type").isin(*TARGET_TYPES)
    for part in (records.where(old), records.where(~old)):
        tables.upsert_into(spark, root, "NFB", "VDLive", upsert.key_live(part, detector))
    return tables.scan(spark, root, "NFB", "VDLive").select(
        F.col("VDID").alias("oid"), ntz("DataCollectTime", "day"), F.col("Status").alias("status"),
        fieldtext.plain(F.col("extra")["value"]).try_cast("double").alias("value"))


def _detector_records(spark, sf_dir, types: tuple[str, ...], field: str) -> DataFrame:
    """Keyed records of the events of some types, which give the detector-day one field: the event's number."""
    fields = F.create_map(
        F.lit("VDID"), F.concat(F.lit("VD-"), F.col("user_id").cast("string")), F.lit("DataCollectTime"), F.expr(_DAY_TEXT),
        F.lit(field), F.col("event_id").cast("string"))
    rows = events(spark, sf_dir).where(F.col("event_type").isin(*types)).select(
        F.lit(None).cast("string").alias("header"), fields.alias("fields"), F.col("event_id").alias("seq"))
    return upsert.key_live(rows, CLASSES["VDLive"])


def _last_numbers(stored: DataFrame, *names: str) -> DataFrame:
    extra = [F.col("extra")[name].cast("bigint").alias(name) for name in names]
    return stored.select(F.col("VDID").alias("oid"), ntz("DataCollectTime", "day"), *extra)


_LAST_NUMBERS = """
SELECT 'VD-' || user_id AS oid, date_trunc('day', ts) AS day, max(event_id) FILTER (event_type IN ('view', 'signup')) AS seen,
       max(event_id) FILTER (event_type = 'click') AS clicked, max(event_id) FILTER (event_type IN ('purchase', 'error')) AS bought
FROM events GROUP BY ALL"""


@query("upsert_two_writers", _LAST_NUMBERS)
def upsert_two_writers(spark, sf_dir):
    """Two uploads to the same days at once, over a stored table: every field that either gives is there."""
    root = scratch_path(spark, "two-writers")

    def upload(types, field):
        tables.upsert_into(spark, root, "NFB", "VDLive", _detector_records(spark, sf_dir, types, field))

    upload(("view", "signup"), "seen")
    with ThreadPoolExecutor(2) as pool:
        for done in [pool.submit(upload, ("click",), "clicked"), pool.submit(upload, ("purchase", "error"), "bought")]:
            done.result()
    return _last_numbers(tables.scan(spark, root, "NFB", "VDLive"), "seen", "clicked", "bought")


@query("upsert_replay", _LAST_NUMBERS)
def upsert_replay(spark, sf_dir):
    """An upload that died after writing its files and before its commit has left the table as it was; done again, it counts once."""
    root = scratch_path(spark, "replayed")
    detector = CLASSES["VDLive"]
    log = tables.log_of(spark, root, "NFB", "VDLive")
    for types, field in ((("view", "signup"), "seen"), (("click",), "clicked"), (("purchase", "error"), "bought")):
        batch = _detector_records(spark, sf_dir, types, field)
        dead = upsert.last_fields(batch).withColumn("fields", F.transform_values("fields", lambda k, v: F.lit("-1")))
        tables.write_layer(dead, log, detector, "d", ("id", "time"))
        tables.upsert_into(spark, root, "NFB", "VDLive", batch)
    return _last_numbers(tables.scan(spark, root, "NFB", "VDLive"), "seen", "clicked", "bought")


@query("upsert_layers", _LAST_NUMBERS)
def upsert_layers(spark, sf_dir):
    """Small layers of given fields put over the stored records by the read itself, one of them after a compaction."""
    root = scratch_path(spark, "layers")
    for number, (types, field) in enumerate(((("view", "signup"), "seen"), (("click",), "clicked"), (("purchase", "error"), "bought"))):
        batch = _detector_records(spark, sf_dir, types, field)
        for _ in range(2):  # a replayed batch is known by its number
            tables.upsert_delta(spark, root, "NFB", "VDLive", batch, stream="events", batch_no=number)
        if number == 1:
            tables.compact(spark, root, "NFB", "VDLive")
    return _last_numbers(tables.scan(spark, root, "NFB", "VDLive"), "seen", "clicked", "bought")


@query("append_two_writers", """
SELECT 'VD-' || user_id AS oid, date_trunc('day', ts) AS day, count(*) AS n FROM (
  SELECT DISTINCT user_id, ts::DATE AS ts FROM events WHERE event_type IN ('click', 'purchase', 'error')) GROUP BY ALL""")
def append_two_writers(spark, sf_dir):
    """Two insert-if-absent uploads at once: a key that both bring is stored once."""
    root = scratch_path(spark, "two-appends")
    batches = [_detector_records(spark, sf_dir, types, "number") for types in (("click", "purchase"), ("click", "error"))]
    with ThreadPoolExecutor(2) as pool:
        for done in [pool.submit(tables.append_new, spark, root, "NFB", "VDLive", batch) for batch in batches]:
            done.result()
    return tables.scan(spark, root, "NFB", "VDLive").groupBy(F.col("VDID").alias("oid"), ntz("DataCollectTime", "day")).agg(
        F.count("*").alias("n"))


@query("scan_many_ids", """
SELECT 'VD-' || user_id AS oid, date_trunc('day', ts) AS day, max(event_id) AS seen FROM events
WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ALL""")
def scan_many_ids(spark, sf_dir):
    """All days of many detectors: the table's key index says which files hold them, and no other is opened."""
    root = scratch_path(spark, "many-ids")
    everything = ("view", "signup", "click", "purchase", "error")
    tables.upsert_into(spark, root, "NFB", "VDLive", _detector_records(spark, sf_dir, everything, "seen"))
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("VD-"), F.col("c_custkey").cast("string")).alias("id"))
    return _last_numbers(tables.scan_ids(spark, root, "NFB", "VDLive", wanted), "seen")


_WHOLE = """
SELECT 'CCTV' AS dataclass, 'C-' || c_custkey AS id, c_name AS name, c_mktsegment AS status, c_nationkey::VARCHAR AS nested FROM customer
UNION ALL SELECT 'News', 'N-' || p_partkey, p_name, p_brand, p_type FROM part
UNION ALL SELECT 'SectionLink', 'S-' || s_suppkey, s_name, s_nationkey::VARCHAR, s_name FROM supplier"""


@query("record_round_trip", _WHOLE)
def record_round_trip(spark, sf_dir):
    """Records of several classes uploaded as JSON and given back whole: declared, undeclared and nested fields under their own names."""
    root = scratch_path(spark, "round-trip")
    parts = []
    for name, source, key, mark, fields in (
            ("CCTV", "customer", "c_custkey", "C-", ("c_name", "c_mktsegment", "c_nationkey")),
            ("News", "part", "p_partkey", "N-", ("p_name", "p_brand", "p_type")),
            ("SectionLink", "supplier", "s_suppkey", "S-", ("s_name", "s_nationkey", "s_name"))):
        cls = CLASSES[name]
        label, status, nested = (F.col(f).cast("string") for f in fields)
        record = F.to_json(F.struct(
            F.concat(F.lit(mark), F.col(key).cast("string")).alias(cls.id_field), F.lit("2021-01-01T08:00:00+08:00").alias("UpdateTime"),
            label.alias("Name"), status.alias("SubAuthorityCode"), F.struct(F.array(F.struct(nested.alias("Value"))).alias("Items")).alias("More")))
        texts = table(spark, sf_dir, source).select(
            F.concat(F.lit(f'{{"UpdateTime":"2021-01-01T00:00:00Z","{cls.container}":['), record, F.lit("]}")).alias("value"))
        path = scratch_path(spark, "round-trip-json")
        texts.write.text(path)
        keyed = upsert.key_batch(jsonrecords.read_batches(spark, path, cls, multi_line=False), cls)
        tables.upsert_into(spark, root, "THB", name, keyed)
        shown = tables.json_rows(tables.scan(spark, root, "THB", name).drop("dt"), cls.time_field)
        value = lambda at: F.get_json_object("json", f"$.{at}")
        parts.append(shown.select(F.lit(name).alias("dataclass"), value(cls.id_field).alias("id"), value("Name").alias("name"),
                                  value("SubAuthorityCode").alias("status"), value("More.Items[0].Value").alias("nested")))
    return reduce(DataFrame.unionByName, parts)
