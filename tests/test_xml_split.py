"""Large XML files in many tasks, texts unaltered, attributes, and what cannot be read."""

import json

import pytest
from pyspark.sql import functions as F

from flowtables.catalog import CLASSES
from flowtables.plans.history import TrafficHistory
from flowtables.sources import xmlrecords
from flowtables.workload import xmlflows
from tests.test_xml import NIL, converted, document

HEADER = "2021-01-01T08:00:00+08:00"


def indented(name, *bodies):
    return document(name, *(f"\n      {body}\n    " for body in bodies)).replace(f"<{name}>", f"\n    <{name}>").replace("<Count>", "\n <Count>")


def write(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}.xml").write_text(text)
    return str(folder)


def rows(frame):
    return [r.fields for r in frame.orderBy("seq").collect()]


@pytest.mark.parametrize("name", ["CCTV", "VDLive", "News", "AVIPairLive"])
def test_one_file_in_many_tasks_reads_like_whole_documents(spark, tmp_path, name):
    cls = CLASSES[name]
    time = "" if name == "CCTV" else f"<{cls.time_field}>2021-01-01T09:00:00+08:00</{cls.time_field}>"
    bodies = [f"<{cls.id_field}>X-{k}</{cls.id_field}><Name>  a &gt; b > {k:03d} </Name><SubAuthorityCode {NIL}/>{time}" for k in range(500)]
    path = write(tmp_path / "in", a=indented(name, *bodies))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        split = xmlrecords.read_batches(spark, path, cls)
        assert spark.read.option("lineSep", f"</{name}>").text(path).rdd.getNumPartitions() > 5
        found = rows(split)
        headers = {r.header for r in split.select("header").distinct().collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    text = spark.createDataFrame([(1, indented(name, *bodies))], "n int, text string")
    assert found == rows(xmlrecords.parse_batches(text, "text", cls, order="n")) and len(found) == 500
    assert headers == {HEADER} and found[7]["Name"] == "  a > b > 007 "
    assert xmlrecords.unreadable(spark, path, cls).count() == 0


def test_static_records_take_the_header_time(spark, tmp_path):
    path = write(tmp_path / "in", a=indented("CCTV", "<CCTVID>1</CCTVID>", "<CCTVID>2</CCTVID>"))
    history = TrafficHistory(spark, str(tmp_path / "table"))
    assert history.upload_batch_xml("NFB", "CCTV", path).count() == 0
    assert sorted((r.CCTVID, str(r.UpdateTime)) for r in history.table("NFB", "CCTV").collect()) == [
        ("1", "2021-01-01 00:00:00"), ("2", "2021-01-01 00:00:00")]


def test_texts_and_attributes_come_through(spark):
    body = ('<CCTVID lang="x">007</CCTVID><Msg>speed > 80</Msg><Lead>  two </Lead><P a="1">007</P><Q a="x > y"/><R><![CDATA[1 < 2 > 0]]></R>'
            "<S>a='b' c=\"d\"</S><T>12</T><U>1e5</U><V>true</V>")
    assert converted(spark, "CCTV", body)["CCTVs"] == [{
        "CCTVID": "007", "Msg": "speed > 80", "Lead": "  two ", "P": {"@a": "1", "#text": "007"}, "Q": {"@a": "x > y"}, "R": "1 < 2 > 0",
        "S": "a='b' c=\"d\"", "T": "12", "U": "1e5", "V": "true"}]


def test_what_cannot_be_read_is_rejected(spark, tmp_path):
    good = indented("CCTV", "<CCTVID>1</CCTVID>", "<CCTVID>2</CCTVID >")
    path = write(tmp_path / "in", good=good, cut=good[:good.index("<CCTVID>2") + 12], other=indented("CMS", "<CMSID>1</CMSID>"),
                 bad=indented("CCTV", "<CCTVID>3</CCTVID>", "<CCTVID>4</Other>"), spaced=good.replace("</CCTV>", "</CCTV >").replace("ID>1", "ID>5"),
                 nothing=indented("CCTV"))
    history = TrafficHistory(spark, str(tmp_path / "table"))
    rejected = {(r.file.split("/")[-1], r.reason) for r in history.upload_batch_xml("NFB", "CCTV", path).collect()}
    assert rejected == {("cut.xml", "cut off"), ("other.xml", "other document"), ("bad.xml", "unreadable record")}
    assert sorted(r.CCTVID for r in history.table("NFB", "CCTV").collect()) == ["1", "2", "3", "5"]


def test_json_that_cannot_be_read_is_rejected(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    good = json.dumps({"UpdateTime": HEADER, "CCTVs": [{"CCTVID": "1"}, {"Name": "no id"}]})
    for name, text in (("good", good), ("cut", good[:60]), ("other", good.replace("CCTVs", "CMSs"))):
        (folder / f"{name}.json").write_text(text)
    history = TrafficHistory(spark, str(tmp_path / "table"))
    rejected = history.upload_batch("NFB", "CCTV", str(folder)).collect()
    assert sorted((r.file.split("/")[-1] if r.file else None, r.reason) for r in rejected if r.file) == [("cut.json", "no JSON"), ("other.json", "no container")]
    assert [r.reason for r in rejected if not r.file] == ["no id"]
    assert [r.CCTVID for r in history.table("NFB", "CCTV").collect()] == ["1"]


def test_detectors_by_record_from_indented_files(spark, tmp_path):
    lanes = "<LinkFlows><LinkFlow><LinkID>A</LinkID><Lanes><Lane><Speed>50</Speed><Occupancy>1</Occupancy></Lane></Lanes></LinkFlow></LinkFlows>"
    body = f"<VDID>1</VDID><Status>0</Status><DataCollectTime>2021-01-01T08:00:00+08:00</DataCollectTime>{lanes}"
    path = write(tmp_path / "in", a=indented("VDLive", body, body.replace("<VDID>1", "<VDID>2")))
    by_record, by_file = (sorted(map(str, xmlrecords.read_detectors(spark, path, unit=unit).collect())) for unit in ("record", "file"))
    assert by_record == by_file and len(by_file) == 2


def test_marks_before_attributes_look_back_at_equal_signs_only(spark):
    text = """<?xml version="1.0" encoding='UTF-8' standalone="yes"?><a b="1" c ='2' subversion="3"><d>x="4" = "5"</d></a>"""
    row = spark.createDataFrame([(text,)], "t string").select(xmlrecords._marked(F.col("t")).alias("t"))
    mark = xmlrecords._MARK
    assert row.first().t == (f"""<?xml version="1.0" encoding='UTF-8' standalone="yes"?><a b="{mark}1" c ='{mark}2' subversion="3">"""
                             f"""<d>{mark}x="{mark}4" = "5"{mark}</d></a>""")
    plan = row._jdf.queryExecution().analyzed().toString()
    assert "=(?<!version=)" in plan and "(?<!version)" not in plan


def test_live_documents_are_bounded(spark, tmp_path, monkeypatch):
    spark.sql("SELECT id AS o_orderkey, '1-URGENT' AS o_orderpriority, DATE '1995-01-01' AS o_orderdate FROM range(1, 96)").write.parquet(
        str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(xmlflows, "LIVE_KEYS", 10)
    written, files = [], xmlflows._files

    def noted(texts, *rest):
        written.extend(r.text.count("<LiveTraffic>") for r in texts.collect())
        return files(texts, *rest)

    monkeypatch.setattr(xmlflows, "_files", noted)
    found = xmlflows.xml_split_live(spark, str(tmp_path))
    assert sorted(r.id for r in found.collect()) == sorted(f"X-{k}" for k in range(1, 96))
    assert max(written) <= 10 and sum(written) == 95
