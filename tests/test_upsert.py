"""Keyed upsert: field rules, order, repetition, rejects, stored tables."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowtables.catalog import CLASSES
from flowtables.operators import upsert
from flowtables.plans.history import TrafficHistory
from flowtables.sources import jsonrecords

LIVE, CAMERA, NEWS = CLASSES["LiveTraffic"], CLASSES["CCTV"], CLASSES["News"]
T1, T2 = "2021-01-01T08:00:00+08:00", "2021-01-01T09:00:00+08:00"


def records(spark, *rows, header=None):
    data = [(header, {k: v for k, v in row.items()}, n) for n, row in enumerate(rows)]
    return spark.createDataFrame(data, "header string, fields map<string,string>, seq int")


def live(spark, *rows):
    return upsert.key_live(records(spark, *[{"SectionID": "s", "DataCollectTime": T1, **r} for r in rows]), LIVE)


def only(frame):
    (row,) = frame.collect()
    return row.fields


def test_given_fields_replace_and_absent_stay(spark):
    target = upsert.last_fields(live(spark, {"a": "1", "b": "2", "c": '{"x":1}'}))
    merged = only(upsert.merge_fields(target, live(spark, {"a": "9", "b": None})))
    assert merged["a"] == "9" and merged["b"] is None and "b" in merged and merged["c"] == '{"x":1}'


def test_last_record_of_a_batch_wins_per_field(spark):
    merged = only(upsert.last_fields(live(spark, {"a": "1", "b": "1"}, {"a": "2"}, {"a": None})))
    assert merged["a"] is None and merged["b"] == "1"


def test_upsert_twice_is_upsert_once(spark):
    target = upsert.last_fields(live(spark, {"a": "1"}))
    batch = live(spark, {"a": "2", "b": None}, {"c": "3"})
    once = upsert.merge_fields(target, batch)
    assert only(upsert.merge_fields(once, batch)) == only(once)


def test_key_rules(spark):
    timeless = upsert.key_batch(records(spark, {"CCTVID": "c"}, header=T1), CAMERA).first()
    assert timeless.time_field == "UpdateTime" and timeless.fields["UpdateTime"] == T1
    assert timeless.time == datetime(2021, 1, 1, 0, 0)
    own = upsert.key_batch(records(spark, {"NewsID": "n", "UpdateTime": T2}, header=T1), NEWS).first()
    assert own.time == datetime(2021, 1, 1, 1, 0)
    both = upsert.key_batch(records(spark, {"SectionID": "s", "UpdateTime": T1, "DataCollectTime": T2}, header=T1), LIVE).first()
    assert both.time_field == "DataCollectTime" and both.time == datetime(2021, 1, 1, 1, 0)
    static = upsert.key_static(records(spark, {"CCTVID": "c", "UpdateTime": T1}), CAMERA, T2).first()
    assert static.time == datetime(2021, 1, 1, 1, 0)


def test_rejects(spark):
    keyed = upsert.key_live(records(spark, {"SectionID": "s"}, {"SectionID": None, "DataCollectTime": T1},
                                    {"SectionID": "s", "DataCollectTime": "never"}, {"SectionID": "s", "DataCollectTime": T1}), LIVE)
    assert sorted((r.seq, r.reason) for r in upsert.rejected(keyed).collect()) == [(0, "no time"), (1, "no id"), (2, "no time")]
    assert upsert.accepted(keyed).count() == 1


def test_new_only_keeps_the_first(spark):
    target = upsert.last_fields(live(spark, {"a": "1"}))
    batch = live(spark, {"a": "2"}).unionByName(live(spark, {"DataCollectTime": T2, "a": "3"}, {"DataCollectTime": T2, "a": "4"}))
    assert only(upsert.new_only(target, batch))["a"] == "3"


def write(folder, name, *documents):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(d) for d in documents))
    return str(folder)


def vehicle_record(oid, time, count, **more):
    lanes = [{"Speed": "50", "Occupancy": "10", "Vehicles": [{"VehicleType": "S", "Volume": str(count)}]}]
    return {"VDID": oid, "DataCollectTime": time, "Status": "0", "LinkFlows": [{"LinkID": "A", "Lanes": lanes}], **more}


def test_stored_table_from_upload_to_query(spark, tmp_path):
    history = TrafficHistory(spark, str(tmp_path / "table"))
    first = write(tmp_path / "one", "a.json", {"UpdateTime": T1, "VDLives": [
        vehicle_record("VD-1", "2021-01-01T08:00:20+08:00", 4, Extra={"k": 1}), vehicle_record("VD-1", "2021-01-02T08:00:20+08:00", 5),
        vehicle_record("VD-2", "2021-01-01T08:00:20+08:00", 6), {"VDID": "VD-3", "DataCollectTime": "bad"}]})
    rejected = history.upload_batch("NFB", "VDLive", first)
    assert [r.reason for r in rejected.collect()] == ["no time"]

    second = write(tmp_path / "two", "b.json", {"VDID": "VD-1", "DataCollectTime": "2021-01-01T00:00:20Z", "Status": "1"})
    history.upload_live("NFB", "VDLive", second)
    history.upload_live("NFB", "VDLive", second)

    stored = history.table("NFB", "VDLive")
    assert stored.count() == 3
    assert upsert.key_violations(stored, "VDID", "DataCollectTime").count() == 0
    row = history.record("NFB", "VDLive", "VD-1", "2021-01-01T08:00:20+08:00").first()
    assert row.Status == "1" and row.LinkFlows[0].Lanes[0].Vehicles[0].Volume == 4 and json.loads(row.extra["Extra"]) == {"k": 1}
    assert history.record("THB", "VDLive", "VD-1", "2021-01-01T08:00:20+08:00").count() == 0

    flows = history.range_sum_lanes_sum_vehicles("NFB", None, "2021-01-01T08:00:00+08:00", "2021-01-02T09:00:00+08:00", error_process=1)
    assert sorted((r.VDID, r.LinkFlows[0].Volume) for r in flows.collect()) == [("VD-1", 5.0), ("VD-2", 6.0)]
    assert history.record_sum_lanes_sum_vehicles("NFB", "VD-1", "2021-01-01T08:00:20+08:00", error_process=2).first().LinkFlows[0].Volume == -1.0
    newest = history.records("NFB", "VDLive", ["VD-1"], "2021-01-01T00:00:00Z", "2021-01-03T00:00:00Z", sort=-1).collect()
    assert [r.DataCollectTime.day for r in newest] == [2, 1]
    shown = json.loads(history.as_json(history.record("NFB", "VDLive", "VD-2", "2021-01-01T08:00:20+08:00")).first().json)
    assert shown["DataCollectTime"] == "2021-01-01T08:00:20+08:00" and shown["Status"] == "0" and "extra" not in shown


def test_a_record_comes_back_whole(spark, tmp_path):
    history = TrafficHistory(spark, str(tmp_path / "table"))
    record = {"CCTVID": "c \"1\"", "SubAuthorityCode": "S", "Name": "a, b", "None": None, "Empty": "", "Place": {"Lat": 1.50, "Near": ["x", {"y": [1, 2]}]},
              "Tags": ["t1", "t2"], "Text": "[no list", "UpdateTime": T1}
    history.upload_batch("NFB", "CCTV", write(tmp_path / "a", "a.json", {"UpdateTime": T2, "CCTVs": [record]}))
    assert json.loads(history.as_json(history.table("NFB", "CCTV")).first().json) == record
    live = vehicle_record("VD-1", T1, 4, SubAuthorityCode="N", Lane={"LaneID": "1"})
    live["LinkFlows"][0]["Lanes"][0]["LaneID"] = "0"  # undeclared, so the list is kept as it came
    history.upload_batch("NFB", "VDLive", write(tmp_path / "b", "b.json", {"UpdateTime": T2, "VDLives": [live]}))
    assert json.loads(history.as_json(history.table("NFB", "VDLive")).first().json) == live


def test_upsert_leaves_other_periods_alone(spark, tmp_path):
    import os

    history = TrafficHistory(spark, str(tmp_path / "table"))
    days = [vehicle_record("VD-1", f"2021-01-0{d}T08:00:00+08:00", d) for d in (1, 2, 3)]
    history.upload_batch("NFB", "VDLive", write(tmp_path / "a", "a.json", {"UpdateTime": T1, "VDLives": days}))

    def files():
        return {(folder, name) for folder, _, names in os.walk(tmp_path / "table") for name in names if name.endswith(".parquet")}

    before = files()
    history.upload_batch("NFB", "VDLive", write(tmp_path / "b", "b.json", {"UpdateTime": T1, "VDLives": [
        vehicle_record("VD-1", "2021-01-02T08:00:00+08:00", 20)]}))
    changed = {folder for folder, _ in before ^ files() if not folder.endswith("_keys")}  # the new layer has its index of ids too
    assert len(changed) == 1 and "dt=2021-01-02" in changed.pop()
    assert history.table("NFB", "VDLive").count() == 3


def test_static_and_append(spark, tmp_path):
    history = TrafficHistory(spark, str(tmp_path / "table"))
    history.upload_static("TNN", "CCTV", "2020-12-20T15:00:00+08:00", write(tmp_path / "c", "c.json", {"CCTVID": "c1", "Name": "x"}))
    batch = write(tmp_path / "d", "d.json", {"UpdateTime": "2020-12-20T15:00:00+08:00", "CCTVs": [
        {"CCTVID": "c1", "Name": "changed"}, {"CCTVID": "c2", "Name": "new"}, {"CCTVID": "c2", "Name": "again"}]})
    history.append_batch("TNN", "CCTV", batch)
    history.append_batch("TNN", "CCTV", batch)
    assert sorted((r.CCTVID, r.extra["Name"]) for r in history.table("TNN", "CCTV").collect()) == [("c1", "x"), ("c2", "new")]
    for call in (lambda: history.upload_static("TNN", "VDLive", T1, "x"), lambda: history.upload_live("TNN", "CCTV", "x"),
                 lambda: history.upload_batch("XXX", "CCTV", batch)):
        with pytest.raises(ValueError):
            call()


def test_lines_keep_file_order(spark, tmp_path):
    folder = write(tmp_path / "lines", "a.json", *[{"SectionID": "s", "DataCollectTime": T1, "n": i} for i in range(200)])
    assert only(upsert.last_fields(upsert.key_live(jsonrecords.read_records(spark, folder), LIVE)))["n"] == "199"
    seqs = [r.n for r in jsonrecords.read_records(spark, folder).orderBy("seq").select(F.col("fields")["n"].cast("int").alias("n")).collect()]
    assert seqs == list(range(200))


def test_numbers_come_back_as_numbers_and_texts_as_texts(spark, tmp_path):
    history = TrafficHistory(spark, str(tmp_path / "table"))
    record = {"VDID": "7", "DataCollectTime": T1, "Status": 0, "N": 5, "Share": 1.25, "On": True, "Text": "5", "Yes": "true",
              "Quoted": '"x"', "Null": None, "Word": "null", "List": [1, "1"], "Broken": "{x"}
    history.upload_live("NFB", "VDLive", write(tmp_path / "a", "a.json", record))
    row = history.record("NFB", "VDLive", "7", T1)
    shown = json.loads(history.as_json(row).first().json)
    shown["DataCollectTime"] = T1
    assert shown == record and row.first().Status == "0"
    history.upload_live("NFB", "VDLive", write(tmp_path / "b", "b.json", {"VDID": 7, "DataCollectTime": T1, "Status": "1", "N": "5"}))
    shown = json.loads(history.as_json(history.record("NFB", "VDLive", "7", T1)).first().json)
    assert history.table("NFB", "VDLive").count() == 1 and (shown["VDID"], shown["Status"], shown["N"], shown["Text"]) == (7, "1", "5", "5")
