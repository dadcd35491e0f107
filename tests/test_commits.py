"""The commit log: crashes, concurrent writers, layers of given fields, compaction, pruned reads."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from flowtables.catalog import CLASSES
from flowtables.operators import upsert
from flowtables.plans.history import TrafficHistory
from flowtables.sources import commits, tables

DETECTOR = CLASSES["VDLive"]
DAY = "2021-01-01T08:00:00+08:00"


def keyed(spark, *rows):
    data = [(None, {"VDID": "VD-1", "DataCollectTime": DAY, **row}, n) for n, row in enumerate(rows)]
    return upsert.key_live(spark.createDataFrame(data, "header string, fields map<string,string>, seq int"), DETECTOR)


def put(spark, root, *rows, how=tables.upsert_into, **options):
    how(spark, root, "NFB", "VDLive", keyed(spark, *rows), **options)


def stored(spark, root, **times):
    found = tables.scan(spark, root, "NFB", "VDLive", **times).collect()
    return {(r.VDID, str(r.DataCollectTime)): {"Status": r.Status, **(r.extra or {})} for r in found}


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "table")


def test_a_writer_that_dies_before_its_commit_changes_nothing(spark, root, monkeypatch):
    put(spark, root, {"Status": "0", "a": "1"})
    before = stored(spark, root)
    with monkeypatch.context() as dead:
        dead.setattr(commits.CommitLog, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        for how in (tables.upsert_into, tables.upsert_delta, tables.append_new):
            with pytest.raises(KeyboardInterrupt):
                put(spark, root, {"a": "2"}, {"VDID": "VD-2"}, how=how)
    assert stored(spark, root) == before
    put(spark, root, {"a": "2"})
    assert [row["a"] for row in stored(spark, root).values()] == ["2"]


def test_two_uploads_to_one_day_keep_both(spark, root):
    put(spark, root, {"Status": "0"})
    failed = []

    def upload(name):
        try:
            put(spark, root, {name: name}, {"VDID": f"VD-{name}"})
        except Exception as error:  # reported below
            failed.append(error)

    threads = [threading.Thread(target=upload, args=(name,)) for name in "abc"]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert not failed
    found = stored(spark, root)
    assert found[("VD-1", "2021-01-01 00:00:00")] == {"Status": "0", "a": "a", "b": "b", "c": "c"}
    assert {oid for oid, _ in found} == {"VD-1", "VD-a", "VD-b", "VD-c"}
    assert upsert.key_violations(tables.scan(spark, root, "NFB", "VDLive"), *DETECTOR.key).count() == 0


def test_a_merge_is_done_again_over_what_another_writer_left(spark, root, monkeypatch):
    put(spark, root, {"Status": "0"})
    plain, calls = tables.write_layer, []

    def slow(*args):
        out = plain(*args)
        calls.append(1)
        if len(calls) == 1:  # another writer comes between this one's read and its commit
            put(spark, root, {"b": "other"})
        return out

    monkeypatch.setattr(tables, "write_layer", slow)
    put(spark, root, {"a": "mine"})
    assert len(calls) == 3
    assert list(stored(spark, root).values()) == [{"Status": "0", "a": "mine", "b": "other"}]


def test_append_refuses_a_key_that_another_writer_added_meanwhile(spark, root, monkeypatch):
    plain, calls = tables.write_layer, []

    def slow(*args):
        out = plain(*args)
        calls.append(1)
        if len(calls) == 1:
            put(spark, root, {"Status": "first"}, how=tables.append_new)
        return out

    monkeypatch.setattr(tables, "write_layer", slow)
    put(spark, root, {"Status": "second"}, {"VDID": "VD-2", "Status": "new"}, how=tables.append_new)
    assert sorted(row["Status"] for row in stored(spark, root).values()) == ["first", "new"]


def test_only_one_commit_of_a_version_is_made(spark, root):
    log = tables.log_of(spark, root, "NFB", "VDLive")
    assert log._put(commits.Manifest(1, {"2021-01-01": ["v-a"]}))
    assert not log._put(commits.Manifest(1, {"2021-01-01": ["v-b"]}))
    assert log.latest().periods == {"2021-01-01": ["v-a"]}
    assert not [name for name in log.names("_log") if "draft" in name]


def test_layers_of_given_fields_read_like_upserts(spark, root, tmp_path):
    other = str(tmp_path / "other")
    batches = [[{"Status": "0", "a": "1"}, {"VDID": "VD-2", "Status": "1"}], [{"a": None}, {"VDID": "VD-3", "a": "x"}],
               [{"Status": "2", "LinkFlows": '[{"LinkID":"A","Lanes":[{"Speed":"7","LaneID":"1"}]}]'}, {"VDID": "VD-2", "DataCollectTime": "2021-01-02T08:00:00Z"}]]
    for k, batch in enumerate(batches):
        put(spark, other, *batch)
        put(spark, root, *batch, how=tables.upsert_delta)
        assert stored(spark, root) == stored(spark, other)
        if k == 1:
            assert tables.compact(spark, root, "NFB", "VDLive") == ["2021-01-01"]
            assert stored(spark, root) == stored(spark, other)
    links = [r.LinkFlows for r in tables.scan(spark, root, "NFB", "VDLive").where("VDID = 'VD-1'").collect()]
    assert links[0][0].Lanes[0].Speed == 7.0
    tables.compact(spark, root, "NFB", "VDLive")
    assert stored(spark, root) == stored(spark, other)
    assert all(len(layers) == 1 for layers in tables.log_of(spark, root, "NFB", "VDLive").latest().periods.values())


def test_fields_given_while_a_period_is_compacted_stay(spark, root, monkeypatch):
    put(spark, root, {"Status": "0"})
    put(spark, root, {"a": "1"}, how=tables.upsert_delta)
    plain, calls = tables.write_layer, []

    def slow(*args):
        out = plain(*args)
        calls.append(1)
        if len(calls) == 1:
            put(spark, root, {"a": "2"}, how=tables.upsert_delta)
        return out

    monkeypatch.setattr(tables, "write_layer", slow)
    tables.compact(spark, root, "NFB", "VDLive")
    assert len(calls) == 2  # the compaction itself and the other writer: nothing was done twice
    assert list(stored(spark, root).values()) == [{"Status": "0", "a": "2"}]


def test_a_replayed_batch_does_not_undo_a_later_writer(spark, root):
    put(spark, root, {"a": "1"}, how=tables.upsert_delta, stream="s", batch_no=0)
    put(spark, root, {"a": "2"})
    put(spark, root, {"a": "1"}, how=tables.upsert_delta, stream="s", batch_no=0)
    assert [row["a"] for row in stored(spark, root).values()] == ["2"]


def test_a_small_batch_writes_little(spark, root):
    many = [{"VDID": f"VD-{k}", "Status": "0"} for k in range(2000)]
    put(spark, root, *many)
    put(spark, root, {"VDID": "VD-7", "Status": "1"}, how=tables.upsert_delta)
    log = tables.log_of(spark, root, "NFB", "VDLive")
    base, delta = log.latest().periods["2021-01-01"]
    assert (base[0], delta[0]) == ("v", "d")
    assert spark.read.parquet(log.layer_path(delta)).count() == 1
    found = stored(spark, root)
    assert len(found) == 2000 and found[("VD-7", "2021-01-01 00:00:00")]["Status"] == "1"


def test_reads_list_their_periods_only_and_push_filters_through_layers(spark, root):
    days = [{"DataCollectTime": f"2021-01-0{k}T08:00:00Z", "Status": "0"} for k in range(1, 6)]
    put(spark, root, *days)
    put(spark, root, {"DataCollectTime": "2021-01-03T08:00:00Z", "a": "1"}, how=tables.upsert_delta)
    some = tables.scan(spark, root, "NFB", "VDLive", since="2021-01-02T00:00:00Z", until="2021-01-03T23:00:00Z")
    assert {name.split("dt=")[1][:10] for name in some.inputFiles()} == {"2021-01-02", "2021-01-03"}
    assert some.count() == 2
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = some.where("VDID = 'VD-9'")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("FileScan")[1:]
    assert len(pushed) == 3 and all("VD-9" in scan.split("PushedFilters")[1].split("ReadSchema")[0] for scan in pushed)


def test_vacuum_takes_what_no_recent_manifest_names(spark, root):
    for k in range(4):
        put(spark, root, {"a": str(k)})
    assert tables.vacuum(spark, root, "NFB", "VDLive") == []
    gone = tables.vacuum(spark, root, "NFB", "VDLive", keep_versions=1, older_than_hours=-1)
    assert len(gone) == 3
    assert [row["a"] for row in stored(spark, root).values()] == ["3"]
    log = tables.log_of(spark, root, "NFB", "VDLive")
    assert len(log.versions()) == 1 and len([name for name in os.listdir(log.folder) if name.startswith("layer=")]) == 1
    put(spark, root, {"a": "5"})
    assert [row["a"] for row in stored(spark, root).values()] == ["5"]


def test_many_ids_open_only_files_that_hold_them(spark, root):
    rows = [{"VDID": f"VD-{k:04d}", "DataCollectTime": f"2021-01-{day:02d}T08:00:00Z", "Status": "0"} for k in range(400) for day in (1, 2, 3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    put(spark, root, *rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    put(spark, root, {"VDID": "VD-0007", "DataCollectTime": "2021-01-02T08:00:00Z", "a": "1"}, how=tables.upsert_delta)
    every = tables.scan(spark, root, "NFB", "VDLive")
    assert len([name for name in every.inputFiles() if "layer=v" in name]) > 9
    ids = spark.createDataFrame([("VD-0007",), ("VD-0008",), ("VD-9999",)], "id string")
    some = tables.scan_ids(spark, root, "NFB", "VDLive", ids)
    assert {r.VDID for r in some.collect()} == {"VD-0007", "VD-0008"} and some.count() == 6
    opened = [name for name in some.inputFiles() if "layer=v" in name]
    assert 3 <= len(opened) <= 6
    assert tables.scan_ids(spark, root, "NFB", "VDLive", ids, since="2021-01-03T00:00:00Z").count() == 2
    assert tables.scan_ids(spark, root, "NFB", "VDLive", ids.where("id = 'VD-9999'")).count() == 0
