"""XML queries. Documents are written with plain text functions, so the reader is not checked against
its own writer. A document holds a detector's hour, at most 50 rows of consecutive unique ids, a nation's customers, or a year's
orders of a range of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtables.catalog import CLASSES, RecordClass
from flowtables.functions.timecols import iso_text
from flowtables.operators import merge, upsert
from flowtables.sources import jsonrecords, xmlrecords
from flowtables.sources.scratch import scratch_path
from flowtables.workload.detectors import detector_sql, records
from flowtables.workload.registry import ntz, query, table

BATCH_ROWS = 50
LIVE_KEYS = 150_000  # keys of a live document at most, of a year's orders
UPDATE_TIME = "2021-01-01T08:00:00+08:00"
NIL = 'xsi:nil="true"'


def tag(name: str, *content) -> Column:
    parts = [F.lit(c) if isinstance(c, str) else c.cast("string") for c in content]
    return F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))


def optional(name: str, value: Column) -> Column:
    """The element, or a nil element where the value is null."""
    return F.coalesce(tag(name, value), F.lit(f"<{name} {NIL}/>"))


def joined(items: Column, render) -> Column:
    return F.array_join(F.transform(items, render), "")


def documents(rows: DataFrame, cls: RecordClass, record: Column, *, batch: Column, order: Column) -> DataFrame:
    """batch_no, text: one XML document per batch with its records in order."""
    packed = rows.groupBy(batch.alias("batch_no")).agg(
        F.sort_array(F.collect_list(F.struct(order.alias("o"), tag(cls.name, record).alias("x")))).alias("items"))
    opening = (f'<?xml version="1.0" encoding="UTF-8"?><{cls.root} xmlns="http://example.org/traffic/" '
               f'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://example.org/traffic/ a.xsd">'
               f"<UpdateTime>{UPDATE_TIME}</UpdateTime>")
    return packed.select("batch_no", F.concat(
        F.lit(opening), tag(cls.container, joined(F.col("items"), lambda i: i["x"])),
        tag("Count", F.size("items")), F.lit(f"</{cls.root}>")).alias("text"))


def by_id(rows: DataFrame, cls: RecordClass, key: str, record: Column) -> DataFrame:
    return documents(rows, cls, record, batch=F.expr(f"{key} DIV {BATCH_ROWS}"), order=F.col(key))


def parsed(texts: DataFrame, cls: RecordClass) -> DataFrame:
    return xmlrecords.parse_batches(texts, "text", cls, order="batch_no")


def detector_documents(spark, sf_dir) -> DataFrame:
    def vehicle(v):
        return tag("Vehicle", tag("VehicleType", v["VehicleType"]), tag("Volume", v["Volume"]), optional("Speed", v["Speed"]))

    def lane(x):
        return tag("Lane", tag("Speed", x["Speed"]), tag("Occupancy", x["Occupancy"]), tag("Vehicles", joined(x["Vehicles"], vehicle)))

    links = joined(F.col("LinkFlows"), lambda k: tag("LinkFlow", tag("LinkID", k["LinkID"]), tag("Lanes", joined(k["Lanes"], lane))))
    record = F.concat(
        tag("VDID", F.col("VDID")), F.lit(f"<SubAuthorityCode {NIL}/>"), tag("LinkFlows", links), tag("Status", F.col("Status")),
        tag("DataCollectTime", iso_text(F.col("DataCollectTime"))))
    batch = F.struct("VDID", F.date_trunc("hour", "DataCollectTime"))
    return documents(records(spark, sf_dir), CLASSES["VDLive"], record, batch=batch, order=F.col("DataCollectTime"))


_VEHICLES = detector_sql() + """
SELECT v.oid, v.t AS time, v.status, v.link_id, lane_index, vehicle_type, v.volume, l.speed AS lane_speed, l.occupancy,
       CAST(CASE WHEN vehicle_type = 'X' THEN NULL ELSE 20 + v.min_part % 80 END AS DOUBLE) AS vehicle_speed
FROM vehicle v JOIN lane l ON l.oid = v.oid AND l.t = v.t AND l.link_id = v.link_id AND l.lane_no = v.lane_no"""


def _vehicle_rows(detectors: DataFrame) -> DataFrame:
    return merge.flatten_raw(detectors).select(
        F.col("VDID").alias("oid"), ntz("DataCollectTime", "time"), F.col("Status").alias("status"),
        F.col("LinkID").alias("link_id"), F.col("LaneIndex").cast("bigint").alias("lane_index"),
        F.col("VehicleType").alias("vehicle_type"), F.col("Volume").alias("volume"),
        F.col("LaneSpeed").alias("lane_speed"), F.col("Occupancy").alias("occupancy"), F.col("Speed").alias("vehicle_speed"))


@query("xml_vdlive", _VEHICLES)
def xml_vdlive(spark, sf_dir):
    """Detector documents in a text column to typed records."""
    return _vehicle_rows(xmlrecords.parse_detectors(detector_documents(spark, sf_dir), "text"))


@query("xml_ingest", _VEHICLES)
def xml_ingest(spark, sf_dir):
    """Detector documents in files, one per line, read by the XML source."""
    path = scratch_path(spark, "xml-detectors")
    detector_documents(spark, sf_dir).select("text").write.text(path)
    return _vehicle_rows(xmlrecords.read_detectors(spark, path, unit="line"))


@query("xml_ingest_split", _VEHICLES)
def xml_ingest_split(spark, sf_dir):
    """Documents with a record per line; the record is the unit of reading."""
    path = scratch_path(spark, "xml-records")
    lines = F.regexp_replace(F.regexp_replace("text", "<VDLive>", "\n<VDLive>"), "</VDLives>", "\n</VDLives>")
    detector_documents(spark, sf_dir).select(lines).write.text(path)
    return _vehicle_rows(xmlrecords.read_detectors(spark, path, unit="record"))


@query("xml_to_table_form", detector_sql() + """
SELECT oid, t AS time, count(*) AS n_vehicles, CAST(sum(volume) AS BIGINT) AS volume FROM vehicle GROUP BY oid, t""")
def xml_to_table_form(spark, sf_dir):
    """Detector documents through the generic path: field maps, keys, JSON lists, typed columns."""
    cls = CLASSES["VDLive"]
    keyed = upsert.key_batch(parsed(detector_documents(spark, sf_dir).withColumn("batch_no", F.col("batch_no").cast("string")), cls), cls)
    typed = upsert.merge_typed(spark.createDataFrame([], cls.schema), upsert.accepted(keyed), cls)
    counts = F.flatten(F.flatten(F.transform("LinkFlows", lambda k: F.transform(
        k["Lanes"], lambda x: F.transform(x["Vehicles"], lambda v: v["Volume"])))))
    return typed.select(
        F.col("VDID").alias("oid"), ntz("DataCollectTime", "time"), F.size(counts).cast("bigint").alias("n_vehicles"),
        F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, v: acc + v).alias("volume"))


@query("xml_generic", """
SELECT 'CCTV' AS dataclass, 'X-' || c_custkey AS id, c_name AS name, TIMESTAMP '2021-01-01' AS time FROM customer
UNION ALL SELECT 'SectionShape', 'X-' || p_partkey, p_name, TIMESTAMP '2021-01-01' FROM part
UNION ALL SELECT 'LiveTraffic', 'X-' || o_orderkey, o_orderpriority, o_orderdate FROM orders""")
def xml_generic(spark, sf_dir):
    """Classes without nested lists: every top-level element is kept."""
    parts = None
    for name, source, key, label, time in (("CCTV", "customer", "c_custkey", "c_name", None),
                                           ("SectionShape", "part", "p_partkey", "p_name", None),
                                           ("LiveTraffic", "orders", "o_orderkey", "o_orderpriority", "o_orderdate")):
        cls = CLASSES[name]
        own = [tag("DataCollectTime", iso_text(F.col(time).cast("timestamp")))] if time else []
        record = F.concat(tag(cls.id_field, "X-", F.col(key)), tag("Name", F.col(label)), *own)
        keyed = upsert.key_batch(parsed(by_id(table(spark, sf_dir, source), cls, key, record), cls), cls)
        rows = keyed.select(F.lit(name).alias("dataclass"), "id", F.col("fields")["Name"].alias("name"), ntz("time", "time"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def _customers(spark, sf_dir, cls: RecordClass, *elements: Column) -> DataFrame:
    record = F.concat(tag(cls.id_field, "X-", F.col("c_custkey")), *elements)
    return parsed(by_id(table(spark, sf_dir, "customer"), cls, "c_custkey", record), cls)


@query("xml_nil", """
SELECT 'X-' || c_custkey AS id, c_mktsegment <> 'BUILDING' AS has_code,
       CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS code FROM customer""")
def xml_nil(spark, sf_dir):
    """A nil SubAuthorityCode leaves no field behind."""
    code = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    rows = _customers(spark, sf_dir, CLASSES["CMS"], optional("SubAuthorityCode", code))
    return rows.select(F.col("fields")["CMSID"].alias("id"), F.map_contains_key("fields", "SubAuthorityCode").alias("has_code"),
                       F.col("fields")["SubAuthorityCode"].alias("code"))


def _item_rows(rows: DataFrame, cls: RecordClass, name: str) -> DataFrame:
    """id, pos, item (map) of a class's nested list."""
    return rows.select(F.col("fields")[cls.id_field].alias("id"), F.posexplode(
        F.from_json(F.col("fields")[name], "array<map<string,string>>")).alias("pos", "item")).withColumn("pos", F.col("pos").cast("bigint"))


@query("xml_vd", """
SELECT 'X-' || c_custkey AS id, 0::BIGINT AS pos, 'LK-' || c_nationkey AS link_id, c_mktsegment AS bearing FROM customer
UNION ALL SELECT 'X-' || c_custkey, 1, 'LK-' || (c_nationkey + 100), c_mktsegment FROM customer WHERE c_acctbal > 0""")
def xml_vd(spark, sf_dir):
    """Detection links: one or two elements, always a list."""
    def link(number):
        return tag("DetectionLink", tag("LinkID", "LK-", number), tag("Bearing", F.col("c_mktsegment")))

    second = F.when(F.col("c_acctbal") > 0, link(F.col("c_nationkey") + 100)).otherwise(F.lit(""))
    cls = CLASSES["VD"]
    items = _item_rows(_customers(spark, sf_dir, cls, tag("DetectionLinks", link(F.col("c_nationkey")), second)), cls, "DetectionLinks")
    return items.select("id", "pos", F.col("item")["LinkID"].alias("link_id"), F.col("item")["Bearing"].alias("bearing"))


@query("xml_flows", """
SELECT 'X-' || c_custkey AS id, 0::BIGINT AS pos, 'A' AS vehicle_type, c_nationkey AS volume FROM customer
UNION ALL SELECT 'X-' || c_custkey, 1, 'B', c_nationkey + 7 FROM customer WHERE c_acctbal > 0""")
def xml_flows(spark, sf_dir):
    """Tag-pair flows: a flat list for one flow and for several."""
    def flow(kind, volume):
        return tag("Flow", tag("VehicleType", kind), tag("Volume", volume))

    second = F.when(F.col("c_acctbal") > 0, flow("B", F.col("c_nationkey") + 7)).otherwise(F.lit(""))
    cls = CLASSES["ETagPairLive"]
    items = _item_rows(_customers(spark, sf_dir, cls, tag("Flows", flow("A", F.col("c_nationkey")), second)), cls, "Flows")
    return items.select("id", "pos", F.col("item")["VehicleType"].alias("vehicle_type"), F.col("item")["Volume"].cast("int").alias("volume"))


@query("xml_pair_links", """
SELECT 'AP-' || o_orderkey AS id, 0::BIGINT AS pos, 'LK-' || o_custkey AS link_id FROM orders
UNION ALL SELECT 'AP-' || o_orderkey, 1, 'LK-' || o_orderkey FROM orders WHERE o_orderstatus <> 'P'""")
def xml_pair_links(spark, sf_dir):
    """Pair links in both spellings: item elements, or bare ids (one or two)."""
    first, second = F.concat(F.lit("LK-"), F.col("o_custkey")), F.concat(F.lit("LK-"), F.col("o_orderkey"))
    items = F.concat(tag("LinkIDItem", tag("LinkID", first)), tag("LinkIDItem", tag("LinkID", second)))
    bare = F.concat(tag("LinkID", first), F.when(F.col("o_orderstatus") == "O", tag("LinkID", second)).otherwise(F.lit("")))
    cls = CLASSES["AVIPair"]
    record = F.concat(tag(cls.id_field, "AP-", F.col("o_orderkey")),
                      tag("LinkIDs", F.when(F.col("o_orderstatus") == "F", items).otherwise(bare)))
    rows = parsed(by_id(table(spark, sf_dir, "orders"), cls, "o_orderkey", record), cls)
    return _item_rows(rows, cls, "LinkIDs").select("id", "pos", F.col("item")["LinkID"].alias("link_id"))


@query("xml_levels", """
SELECT 'X-' || p_partkey AS id, 0::BIGINT AS pos, p_size > 25 AS has_top, CASE WHEN p_size > 25 THEN p_size END AS top, 1 AS level, p_type = 'SMALL' AS described FROM part
UNION ALL SELECT 'X-' || p_partkey, 1, true, p_size + 100, 2, p_type = 'SMALL' FROM part WHERE p_size > 10""")
def xml_levels(spark, sf_dir):
    """Levels in both spellings; nil limits and descriptions removed per record."""
    def levels(name):
        low = tag(name, optional("TopValue", F.when(F.col("p_size") > 25, F.col("p_size"))), tag("Level", "1"))
        high = tag(name, tag("TopValue", F.col("p_size") + 100), tag("Level", "2"))
        return F.concat(low, F.when(F.col("p_size") > 10, high).otherwise(F.lit("")))

    cls = CLASSES["CongestionLevel"]
    either = F.when(F.col("p_type") == "SMALL", levels("LevelItem")).otherwise(levels("Level"))
    record = F.concat(tag(cls.id_field, "X-", F.col("p_partkey")),
                      optional("Description", F.when(F.col("p_type") == "SMALL", F.col("p_name"))), tag("Levels", either))
    rows = parsed(by_id(table(spark, sf_dir, "part"), cls, "p_partkey", record), cls)
    flagged = _item_rows(rows, cls, "Levels").join(
        rows.select(F.col("fields")[cls.id_field].alias("id"), F.map_contains_key("fields", "Description").alias("described")), "id")
    return flagged.select("id", "pos", F.map_contains_key("item", "TopValue").alias("has_top"),
                          F.col("item")["TopValue"].cast("int").alias("top"), F.col("item")["Level"].cast("int").alias("level"), "described")


@query("xml_news", """
SELECT 'X-' || c_custkey AS id, c_mktsegment <> 'MACHINERY' AS has_department, c_acctbal > 0 AS has_url,
       CASE WHEN c_acctbal > 0 THEN 'http://example.org/' || c_custkey END AS url, false AS has_end,
       TIMESTAMP '2021-03-04 00:00:00' AS time FROM customer""")
def xml_news(spark, sf_dir):
    """News items keep their own UpdateTime; nil optional fields vanish."""
    cls = CLASSES["News"]
    url = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("http://example.org/"), F.col("c_custkey")))
    rows = _customers(
        spark, sf_dir, cls, optional("Department", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))),
        optional("NewsURL", url), F.lit(f"<EndTime {NIL}/>"), tag("UpdateTime", "2021-03-04T08:00:00+08:00"))
    keyed = upsert.key_batch(rows, cls)
    has = lambda name: F.map_contains_key("fields", name)
    return keyed.select("id", has("Department").alias("has_department"), has("NewsURL").alias("has_url"),
                        F.col("fields")["NewsURL"].alias("url"), has("EndTime").alias("has_end"), ntz("time", "time"))


@query("xml_to_json_job", detector_sql() + """
SELECT oid, date_trunc('hour', t) AS hour, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_vehicles, CAST(sum(v) AS BIGINT) AS volume
FROM (SELECT oid, t, count(*) AS n, sum(volume) AS v FROM vehicle GROUP BY oid, t) GROUP BY ALL""")
def xml_to_json_job(spark, sf_dir):
    """XML documents to JSON documents, checked by reading the JSON back with the typed schema."""
    cls = CLASSES["VDLive"]
    docs = xmlrecords.parse_documents(detector_documents(spark, sf_dir).select("text"), "text", cls)
    written = xmlrecords.document_json(docs, cls)
    lanes = "array<struct<Vehicles: array<struct<Volume: string>>>>"
    schema = f"VDLives array<struct<VDID: string, DataCollectTime: timestamp, LinkFlows: array<struct<Lanes: {lanes}>>>>"
    read = written.select(F.from_json("json", schema).alias("j")).select("j.VDLives")
    each = F.flatten(F.flatten(F.transform("VDLives", lambda r: F.flatten(F.transform(r["LinkFlows"], lambda k: F.transform(
        k["Lanes"], lambda x: F.transform(x["Vehicles"], lambda v: v["Volume"].cast("bigint"))))))))
    return read.select(
        F.col("VDLives")[0]["VDID"].alias("oid"), ntz(F.date_trunc("hour", F.col("VDLives")[0]["DataCollectTime"]), "hour"),
        F.size("VDLives").cast("bigint").alias("n_records"), F.size(each).cast("bigint").alias("n_vehicles"),
        F.aggregate(each, F.lit(0).cast("bigint"), lambda acc, v: acc + v).alias("volume"))


def _lines(texts: DataFrame) -> Column:
    """Documents as people write them: a record begins on a line of its own and goes over several."""
    return F.regexp_replace(F.regexp_replace("text", "<(CCTV|LiveTraffic)>", "\n    <$1>\n        "), "</(CCTV|LiveTraffic)>", "\n    </$1>")


def _files(texts: DataFrame, spark, label: str) -> str:
    """One document per file."""
    path = scratch_path(spark, label)
    texts.select("batch_no", _lines(texts).alias("text")).write.partitionBy("batch_no").text(path)
    return path


@query("xml_split_static", """
SELECT 'CCTV-' || c_custkey AS id, '  ' || c_name || ' > ' || c_mktsegment AS name, c_nationkey AS nation,
       lpad(c_custkey::VARCHAR, 9, '0') AS number, TIMESTAMP '2021-01-01' AS time FROM customer""")
def xml_split_static(spark, sf_dir):
    """Indented files of a static class, split at records: header time, texts with spaces and '>', numbers as written, attributes."""
    cls = CLASSES["CCTV"]
    rows = table(spark, sf_dir, "customer")
    number = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    record = F.concat(
        tag(cls.id_field, "CCTV-", F.col("c_custkey")), F.lit(f"<SubAuthorityCode {NIL}/>"), tag("Number", number),
        tag("Name", "  ", F.col("c_name"), " > ", F.col("c_mktsegment")), F.lit('<Place nation="'), F.col("c_nationkey").cast("string"),
        F.lit('">here</Place>'))
    texts = documents(rows, cls, record, batch=F.col("c_nationkey"), order=F.col("c_custkey"))
    keyed = upsert.key_batch(xmlrecords.read_batches(spark, _files(texts, spark, "xml-static"), cls), cls)
    fields = F.col("fields")
    return keyed.select(
        "id", fields["Name"].alias("name"), F.get_json_object(fields["Place"], "$.@nation").cast("bigint").alias("nation"),
        fields["Number"].alias("number"), ntz("time", "time"))


@query("xml_split_live", """
SELECT 'X-' || o_orderkey AS id, o_orderpriority AS name, o_orderdate::TIMESTAMP AS time FROM orders""")
def xml_split_live(spark, sf_dir):
    """Indented files of a live class, split at records, each with its own time."""
    cls = CLASSES["LiveTraffic"]
    record = F.concat(tag(cls.id_field, "X-", F.col("o_orderkey")), tag("Name", F.col("o_orderpriority")),
                      tag("DataCollectTime", iso_text(F.col("o_orderdate").cast("timestamp"))))
    batch = F.concat_ws("-", F.year("o_orderdate"), F.expr(f"o_orderkey DIV {LIVE_KEYS}"))  # bounded: a document is one row, made by one task
    texts = documents(table(spark, sf_dir, "orders"), cls, record, batch=batch, order=F.col("o_orderkey"))
    keyed = upsert.key_batch(xmlrecords.read_batches(spark, _files(texts, spark, "xml-live"), cls), cls)
    return keyed.select("id", F.col("fields")["Name"].alias("name"), ntz("time", "time"))


@query("reject_documents", """
SELECT kind, c_nationkey AS nation, reason FROM (SELECT DISTINCT c_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey)
JOIN (VALUES (0, 'cut off', 'no JSON'), (1, 'other document', 'no container'), (2, 'unreadable record', NULL)) AS f(r, xml, json) ON r = n_regionkey,
LATERAL (VALUES ('xml', xml), ('json', json)) AS v(kind, reason) WHERE reason IS NOT NULL""")
def reject_documents(spark, sf_dir):
    """Documents cut off, of another class, or with a broken record: each gives a row with its reason, and the others are read."""
    cls = CLASSES["CCTV"]
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    region = F.max("n_regionkey").alias("region")
    rows = rows.withColumn("last", F.expr("c_custkey = max(c_custkey) OVER (PARTITION BY c_nationkey)"))
    broken = F.when(F.col("last") & (F.col("n_regionkey") == 2), F.lit("<Name>")).otherwise("")
    texts = documents(rows, cls, F.concat(tag(cls.id_field, F.col("c_custkey")), broken), batch=F.col("c_nationkey"), order=F.col("c_custkey"))
    regions = rows.groupBy(F.col("c_nationkey").alias("batch_no")).agg(region)
    half = F.substring("text", F.lit(1), (F.length("text") / 2).cast("int"))
    xml = texts.join(regions, "batch_no").withColumn("text", F.when(F.col("region") == 0, half).when(
        F.col("region") == 1, F.regexp_replace("text", "CCTVList", "CMSList")).otherwise(F.col("text")))
    items = F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("CCTVID"))).alias("CCTVs")
    json = rows.groupBy(F.col("c_nationkey").alias("batch_no")).agg(F.to_json(F.struct(F.lit(UPDATE_TIME).alias("UpdateTime"), items)).alias("text"), region)
    json = json.withColumn("text", F.when(F.col("region") == 0, half).when(
        F.col("region") == 1, F.replace("text", F.lit("CCTVs"), F.lit("CMSs"))).otherwise(F.col("text")))
    path = scratch_path(spark, "json-rejects")
    json.select("batch_no", "text").write.partitionBy("batch_no").text(path)
    found = xmlrecords.unreadable(spark, _files(xml, spark, "xml-rejects"), cls).withColumn("kind", F.lit("xml")).unionByName(
        jsonrecords.unreadable(spark, path, cls).withColumn("kind", F.lit("json")))
    return found.select("kind", F.regexp_extract("file", "batch_no=(\\d+)", 1).cast("bigint").alias("nation"), "reason")
