"""Parsed documents are worked out once a row, whatever reads them."""

from pyspark.sql import functions as F

from flowtables.catalog import CLASSES
from flowtables.operators import merge, upsert
from flowtables.sources import jsonrecords, xmlrecords
from tests.test_xml import DETECTOR, document


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_detector_documents_are_parsed_once(spark):
    texts = spark.createDataFrame([(document("VDLive", DETECTOR.format(1), DETECTOR.format(2)),), ("<VDLiveList/>",), (None,)], "text string")
    rows = merge.flatten_raw(xmlrecords.parse_detectors(texts, "text"))
    assert optimized(rows).count("from_xml(") == 1 and optimized(rows).count("from_utc") == 0
    assert sorted(r.VDID for r in rows.collect()) == ["V1", "V2"]


def test_batches_are_parsed_once_and_nested_lists_are_not_made_again_at_each_level(spark):
    cls = CLASSES["VDLive"]
    texts = spark.createDataFrame([(1, document("VDLive", DETECTOR.format(1)))], "n int, text string")
    docs = xmlrecords.parse_documents(texts, "text", cls)
    assert optimized(docs).count("$.Vehicles.Vehicle") <= 3
    plan = optimized(upsert.accepted(upsert.key_batch(xmlrecords.parse_batches(texts, "text", cls, order="n"), cls)))
    assert plan.count("from_xml(") == 1 and plan.count("$.Vehicles.Vehicle") <= 3


def test_files_split_at_records_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.xml").write_text(document("CCTV", "<CCTVID>1</CCTVID>"))
    rows = xmlrecords.read_batches(spark, str(tmp_path), CLASSES["CCTV"])
    assert optimized(rows).count("from_xml(") == 1 and rows.first().fields["CCTVID"] == '"1"'


def test_json_batches_are_parsed_once(spark):
    cls = CLASSES["LiveTraffic"]
    record = {cls.id_field: "s", "DataCollectTime": "2021-01-01T08:00:00+08:00", "a": None}
    frame = spark.createDataFrame([(1, [record]), (2, []), (3, None)], f"n int, {cls.container} array<map<string,string>>")
    texts = frame.select("n", F.to_json(F.struct(cls.container), {"ignoreNullFields": "false"}).alias("text"))
    given = upsert.last_fields(upsert.accepted(upsert.key_batch(jsonrecords.parse_batches(texts, "text", cls, order="n"), cls)))
    assert optimized(given).count("from_json(structs") + optimized(given).count("from_json(StructField(UpdateTime") <= 1
    row, = given.collect()
    assert set(row.fields) == set(record) and row.fields["a"] is None
