"""Golden records for merging, quality rules and time functions."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from flowtables import catalog
from flowtables.functions import timecols
from flowtables.operators import lookup, merge, quality
from flowtables.plans import traffic
from tests.model import DETECTOR_SCHEMA

T = datetime(2021, 1, 1, 7, 0, 40, tzinfo=timezone.utc)


def detector(spark, links, status="0"):
    return spark.createDataFrame([("VD-1", T, status, links)], DETECTOR_SCHEMA)


def lane(*vehicles, speed=50.0, occupancy=10.0):
    return (speed, occupancy, [(kind, count, None) for kind, count in vehicles])


def status_of(frame):
    return quality.flags(frame).first()


@pytest.mark.parametrize("links, status, volume, speed, occupancy", [
    ([], "0", None, None, None),
    ([("A", [])], "0", 0.0, 0.0, 0.0),
    ([("A", [lane()])], "0", 0.0, 0.0, 10.0),
    ([("A", [lane(("S", 0)), lane(("S", 0), speed=90.0)])], "0", 0.0, 0.0, 10.0),
    ([("A", [lane(("M", 2), ("T", 1)), lane(("X", 4), speed=100.0, occupancy=20.0)])], "0", 8.0, 75.0, 15.0),
    ([("A", [lane(("S", -2), speed=60.0)])], "0", -2.0, -120.0, 10.0),
])
def test_link_readings(spark, links, status, volume, speed, occupancy):
    row = merge.sum_lanes_sum_vehicles(detector(spark, links, status), m_pce=0.5, t_pce=3.0).first()
    assert row.Time == datetime(2021, 1, 1, 7, 0)
    if volume is None:
        assert row.LinkFlows == []
    else:
        assert tuple(row.LinkFlows[0]) == ("A", volume, speed, occupancy)


@pytest.mark.parametrize("count, hit", [(-1, True), (0, False), (311, False), (312, True), (None, True)])
def test_volume_rule(spark, count, hit):
    assert status_of(detector(spark, [("A", [lane(("S", count))])])).volume_hit is hit


@pytest.mark.parametrize("speed, hit", [(-0.1, True), (0.0, False), (150.0, False), (150.1, True), (None, True)])
def test_speed_rule(spark, speed, hit):
    assert status_of(detector(spark, [("A", [lane(speed=speed)])])).speed_hit is hit


@pytest.mark.parametrize("occupancy, hit", [(-0.1, True), (0.0, False), (100.0, False), (100.1, True), (None, True)])
def test_occupancy_rule(spark, occupancy, hit):
    assert status_of(detector(spark, [("A", [lane(occupancy=occupancy)])])).occupancy_hit is hit


@pytest.mark.parametrize("status, hit", [("0", False), ("1", True), ("", True), (None, True)])
def test_status_rule(spark, status, hit):
    row = status_of(detector(spark, [("A", [lane(("S", 1))])], status))
    assert row.status_hit is hit and row.DataStatus == (2 if hit else 0)


def test_text_readings(spark):
    """Untyped records: text that is no number is abnormal and counts nothing; an integer status works."""
    schema = ("VDID string, DataCollectTime timestamp, Status int, LinkFlows array<struct<LinkID: string, Lanes: array<struct<"
              "Speed: string, Occupancy: string, Vehicles: array<struct<VehicleType: string, Volume: string, Speed: string>>>>>>")

    def one(count, speed="50"):
        frame = spark.createDataFrame([("VD-1", T, 0, [("A", [(speed, "10", [("S", count, None), ("S", "5", None)])])])], schema)
        row = merge.sum_lanes_sum_vehicles(frame).first()
        return row.DataStatus, row.LinkFlows[0].Volume, row.LinkFlows[0].Speed

    assert one("3") == (0, 8.0, 50.0)
    assert one("3.7") == (2, 5.0, 50.0)
    assert one("x") == (2, 5.0, 50.0)
    assert one("3", speed="fast") == (2, 8.0, 0.0)


def test_one_bad_lane_marks_the_whole_record(spark):
    links = [("A", [lane(("S", 5))]), ("B", [lane(("S", 400))])]
    flows = merge.sum_lanes_sum_vehicles(detector(spark, links))
    assert flows.first().DataStatus == 2
    assert quality.drop_abnormal(flows).count() == 0
    assert [tuple(k) for k in quality.fill_abnormal(flows).first().LinkFlows] == [("A", -1.0, -1.0, -1.0), ("B", -1.0, -1.0, -1.0)]


def test_one_record_error_process(spark):
    good, bad = detector(spark, [("A", [lane(("S", 5))])]), detector(spark, [("A", [lane(("S", 400))])])
    assert traffic.one_record(good, error_process=1).count() == 1
    assert traffic.one_record(bad, error_process=1).count() == 0
    assert traffic.one_record(bad, error_process=0).first().LinkFlows[0].Volume == 400.0
    assert traffic.one_record(bad, error_process=2).first().LinkFlows[0].Volume == -1.0


def test_per_vehicle_and_per_lane(spark):
    frame = detector(spark, [("A", [lane(("M", 2), ("S", 3)), lane(("S", 1), speed=90.0, occupancy=30.0)])])
    types = {r.VehicleType: (r.Volume, r.Speed, r.Occupancy) for r in merge.sum_lanes_per_vehicle(frame, m_pce=0.5).collect()}
    assert types == {"M": (1.0, 50.0, 20.0), "S": (4.0, 60.0, 20.0)}
    lanes = merge.per_lane_sum_vehicles(frame, m_pce=0.5).orderBy("LaneIndex").collect()
    assert [(r.LaneIndex, r.Volume, r.Speed) for r in lanes] == [(0, 4.0, 50.0), (1, 1.0, 90.0)]
    assert lanes[0].Time == T.replace(tzinfo=None)
    entries = merge.per_lane_per_vehicle(frame, m_pce=0.5).collect()
    assert sorted((r.LaneIndex, r.VehicleType, r.Volume) for r in entries) == [(0, "M", 1.0), (0, "S", 3.0), (1, "S", 1.0)]


def test_catalog():
    assert len(catalog.CLASSES) == 19
    assert catalog.record_class("AVIPairLive").key == ("AVIPairID", "DataCollectTime")
    assert catalog.record_class("AVIPairLive").container == "AVIPairs"
    assert catalog.record_class("ETag").key == ("ETagGantryID", "UpdateTime")
    assert set(catalog.LIVE_UPLOAD) & set(catalog.STATIC_UPLOAD) == set()
    assert len(catalog.LIVE_UPLOAD) == 8 and "News" in catalog.LIVE_UPLOAD
    for call in (lambda: catalog.record_class("Nope"), lambda: catalog.authority("XXX"),
                 lambda: catalog.record_class("VD", catalog.LIVE_UPLOAD)):
        with pytest.raises(ValueError):
            call()


def test_time_functions(spark):
    texts = ["2021-01-01T15:00:00+08:00", "2021-01-01T15:00:00.250+08:00", "2021-01-01T07:00:59Z", "soon", None, "12:30", "T01:02", "2021"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(timecols.parse_iso(F.col("t")).alias("t"))
    rows = frame.select(timecols.iso_text(F.col("t")).alias("iso"), timecols.epoch_minute(F.col("t")).alias("m"),
                        timecols.trunc_minute(F.col("t")).alias("minute")).collect()
    assert [r.iso for r in rows] == ["2021-01-01T15:00:00+08:00", "2021-01-01T15:00:00.250000+08:00", "2021-01-01T15:00:59+08:00"] + [None] * 5
    assert rows[0].m == rows[1].m == rows[2].m == timecols.minute_of("2021-01-01T15:00:00+08:00")
    assert rows[2].minute == datetime(2021, 1, 1, 7, 0)
    before = spark.sql("SELECT timestamp'1969-12-31 23:59:30' AS t").select(timecols.epoch_minute(F.col("t")).alias("m"))
    assert before.first().m == -1


def test_positions_equal_a_global_sort(spark):
    rows = [(f"VD-{i % 2}", datetime(2021, 1, 1 + i % 5, i % 24, i, tzinfo=timezone.utc)) for i in range(50)]
    frame = spark.createDataFrame(rows, "VDID string, DataCollectTime timestamp")
    for sort in (1, -1):
        got = {(r.VDID, r.DataCollectTime): r.pos for r in lookup.position_per_id(frame, catalog.CLASSES["VDLive"], sort).collect()}
        for oid in ("VD-0", "VD-1"):
            mine = sorted((t.replace(tzinfo=None) for o, t in rows if o == oid), reverse=sort == -1)
            assert [got[oid, t] for t in mine] == list(range(1, len(mine) + 1))
