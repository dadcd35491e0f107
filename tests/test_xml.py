"""XML normalization per class, with one child and with several, and the file readers."""

import json

import pytest
from pyspark.sql import functions as F

from flowtables.catalog import CLASSES
from flowtables.plans.history import TrafficHistory, xml_to_json
from flowtables.sources import xmlrecords

NIL = 'xsi:nil="true"'


def document(name, *bodies, time="2021-01-01T08:00:00+08:00"):
    cls = CLASSES[name]
    rows = "".join(f"<{name}>{body}</{name}>" for body in bodies)
    return (f'<?xml version="1.0"?>\n<{cls.root} xmlns="http://example.org/v2" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" '
            f'xsi:schemaLocation="x y"><UpdateTime>{time}</UpdateTime><{cls.container}>{rows}</{cls.container}>'
            f"<Count>{len(bodies)}</Count></{cls.root}>")


def converted(spark, name, *bodies):
    frame = spark.createDataFrame([(document(name, *bodies),)], "text string")
    docs = xmlrecords.parse_documents(frame, "text", CLASSES[name])
    return json.loads(xmlrecords.document_json(docs, CLASSES[name]).first().json)


@pytest.mark.parametrize("name", sorted(CLASSES))
def test_every_class_converts_one_record_and_two(spark, name):
    cls = CLASSES[name]
    body = f"<{cls.id_field}>a &amp; b</{cls.id_field}><Other>7</Other>"
    for count in (1, 2):
        result = converted(spark, name, *[body] * count)
        assert set(result) == {"UpdateTime", cls.container}
        assert result[cls.container] == [{cls.id_field: "a & b", "Other": "7"}] * count


def test_nil_fields(spark):
    dropped = converted(spark, "CCTV", f"<CCTVID>1</CCTVID><SubAuthorityCode {NIL}/>", "<CCTVID>2</CCTVID><SubAuthorityCode>N</SubAuthorityCode>")
    assert dropped["CCTVs"] == [{"CCTVID": "1"}, {"CCTVID": "2", "SubAuthorityCode": "N"}]
    news = converted(spark, "News", f"<NewsID>1</NewsID><Department {NIL}/><NewsURL {NIL}/><StartTime>t</StartTime><EndTime {NIL}/>")
    assert news["Newses"] == [{"NewsID": "1", "StartTime": "t"}]


@pytest.mark.parametrize("count", [1, 3])
def test_lists_are_always_lists(spark, count):
    link = "<DetectionLink><LinkID>L &lt; 1</LinkID><Bearing>N</Bearing></DetectionLink>"
    assert converted(spark, "VD", f"<VDID>1</VDID><DetectionLinks>{link * count}</DetectionLinks>")["VDs"][0]["DetectionLinks"] == [
        {"LinkID": "L < 1", "Bearing": "N"}] * count
    flow = "<Flow><VehicleType>1</VehicleType></Flow>"
    assert converted(spark, "ETagPairLive", f"<ETagPairID>1</ETagPairID><Flows>{flow * count}</Flows>")["ETagPairLives"][0]["Flows"] == [
        {"VehicleType": "1"}] * count
    for kind in ("AVIPair", "ETagPair"):
        container = CLASSES[kind].container
        bare = converted(spark, kind, f"<LinkIDs>{'<LinkID>abc</LinkID>' * count}</LinkIDs>")
        item = converted(spark, kind, f"<LinkIDs>{'<LinkIDItem><LinkID>abc</LinkID></LinkIDItem>' * count}</LinkIDs>")
        assert bare == item and bare[container] == [{"LinkIDs": [{"LinkID": "abc"}] * count}]
    for tag in ("LevelItem", "Level"):
        level = f"<{tag}><Level>1</Level><TopValue {NIL}/><LowValue>2</LowValue></{tag}>"
        record = converted(spark, "CongestionLevel", f"<Description {NIL}/><Levels>{level * count}</Levels>")["CongestionLevels"][0]
        assert record == {"Levels": [{"Level": "1", "LowValue": "2"}] * count}


VEHICLES = "<Vehicles><Vehicle><VehicleType>S</VehicleType><Volume>3</Volume><Speed {0}/></Vehicle></Vehicles>".format(NIL)
LANE = f"<Lane><LaneID>0</LaneID><Speed>50.5</Speed><Occupancy>7</Occupancy>{VEHICLES}</Lane>"
DETECTOR = ("<VDID>V{0}</VDID><LinkFlows><LinkFlow><LinkID>A</LinkID><Lanes>" + LANE + "</Lanes></LinkFlow></LinkFlows>"
            "<Status>0</Status><DataCollectTime>2021-01-01T08:0{0}:00+08:00</DataCollectTime>")


def test_detector_record(spark):
    result = converted(spark, "VDLive", DETECTOR.format(1))["VDLives"][0]
    assert result["LinkFlows"] == [{"LinkID": "A", "Lanes": [
        {"LaneID": "0", "Speed": "50.5", "Occupancy": "7", "Vehicles": [{"VehicleType": "S", "Volume": "3"}]}]}]
    assert result["VDID"] == "V1" and result["Status"] == "0"


def test_detector_files(spark, tmp_path):
    docs = [document("VDLive", DETECTOR.format(1), DETECTOR.format(2)), document("VDLive", DETECTOR.format(3))]
    files, lines, records = (tmp_path / n for n in ("files", "lines", "records"))
    for folder in (files, lines, records):
        folder.mkdir()
    for i, text in enumerate(docs):
        (files / f"{i}.xml").write_text(text)
        (records / f"{i}.xml").write_text(text.replace("<VDLive>", "\n<VDLive>").replace("</VDLives>", "\n</VDLives>"))
    (lines / "all.xml").write_text("\n".join(t.replace("\n", "") for t in docs))
    seen = []
    for folder, unit in ((files, "file"), (lines, "line"), (records, "record")):
        rows = xmlrecords.read_detectors(spark, str(folder), unit=unit).orderBy("VDID").collect()
        seen.append([(r.VDID, r.DataCollectTime, r.Status, r.LinkFlows) for r in rows])
    assert seen[0] == seen[1] == seen[2] and [r[0] for r in seen[0]] == ["V1", "V2", "V3"]
    assert seen[0][0][3][0].Lanes[0].Vehicles[0] == ("S", 3, None)

    history = TrafficHistory(spark, str(tmp_path / "table"))
    assert history.upload_batch_xml("NFB", "VDLive", str(files)).count() == 0
    stored = history.table("NFB", "VDLive").orderBy("VDID").collect()
    assert [(r.VDID, r.LinkFlows[0].Lanes[0].Speed, r.LinkFlows[0].Lanes[0].Vehicles[0].Volume) for r in stored] == [
        ("V1", 50.5, 3), ("V2", 50.5, 3), ("V3", 50.5, 3)]

    xml_to_json(spark, "VDLive", str(files), str(tmp_path / "json"))
    converted_docs = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert sorted(len(d["VDLives"]) for d in converted_docs) == [1, 2]
    again = TrafficHistory(spark, str(tmp_path / "again"))
    again.upload_batch("NFB", "VDLive", str(tmp_path / "json"), multi_line=False)
    assert again.table("NFB", "VDLive").orderBy("VDID").collect() == stored


def test_malformed_document_gives_no_records(spark):
    frame = spark.createDataFrame([("<VDList><VDs><VD>",)], "text string")
    docs = xmlrecords.parse_documents(frame, "text", CLASSES["VD"])
    assert docs.select(F.explode("records")).count() == 0
