"""Nested, repeated and undeclared elements come through parsing, storing and writing."""

import json

from flowtables.plans.history import TrafficHistory
from tests.test_xml import NIL, converted, document

POSITION = f'<Position kind="p1"><Lat>01.50</Lat><Near>1</Near><Near>2</Near><Far {NIL}/></Position>'


def test_nested_and_repeated_elements_of_generic_classes(spark):
    body = f"<CCTVID>007</CCTVID><Msg>one</Msg><Msg>two</Msg>{POSITION}<Note>[1]</Note>"
    assert converted(spark, "CCTV", body)["CCTVs"] == [{
        "CCTVID": "007", "Msg": ["one", "two"], "Note": "[1]",
        "Position": {"@kind": "p1", "Lat": "01.50", "Near": ["1", "2"], "Far": None}}]


def test_lists_keep_undeclared_elements(spark):
    item = "<LinkIDItem><LinkID>a</LinkID><Order>1</Order><Tag>x</Tag><Tag>y</Tag></LinkIDItem>"
    assert converted(spark, "AVIPair", f"<AVIPairID>1</AVIPairID><LinkIDs>{item}</LinkIDs>")["AVIPairs"][0]["LinkIDs"] == [
        {"LinkID": "a", "Order": "1", "Tag": ["x", "y"]}]


def test_undeclared_nested_fields_are_stored_and_written(spark, tmp_path):
    item = "<LinkIDItem><LinkID>a</LinkID><Order>1</Order></LinkIDItem>"
    body = f"<AVIPairID>1</AVIPairID><LinkIDs>{item}</LinkIDs><Msg>one</Msg><Msg>two &lt;</Msg>{POSITION}"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(document("AVIPair", body))
    history = TrafficHistory(spark, str(tmp_path / "table"))
    assert history.upload_batch_xml("NFB", "AVIPair", str(tmp_path / "in")).count() == 0
    row = history.table("NFB", "AVIPair").first()
    assert [x.LinkID for x in row.LinkIDs] == ["a"] and json.loads(row.extra["LinkIDs"]) == [{"LinkID": "a", "Order": "1"}]
    assert json.loads(row.extra["Msg"]) == ["one", "two <"]
    written = history.as_xml(history.table("NFB", "AVIPair"), "AVIPair").first().xml
    assert written.count("<LinkID>a</LinkID>") == 1 and "<Order>1</Order>" in written and "<Lat>01.50</Lat>" in written
    assert "<Msg>one</Msg>" in written and "<Msg>two &lt;</Msg>" in written and written.count("<AVIPairID>") == 1
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "b.xml").write_text(document("AVIPair", "<AVIPairID>1</AVIPairID><LinkIDs><LinkID>b</LinkID></LinkIDs>"))
    history.upload_batch_xml("NFB", "AVIPair", str(tmp_path / "again"))
    row = history.table("NFB", "AVIPair").first()
    assert [x.LinkID for x in row.LinkIDs] == ["b"] and "LinkIDs" not in row.extra and json.loads(row.extra["Msg"]) == ["one", "two <"]
