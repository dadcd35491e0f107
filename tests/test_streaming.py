"""Streams give what the batch operators give, also when replayed or late."""

import json
import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from flowtables.functions.timecols import minute_of
from flowtables.operators import upsert
from flowtables.plans.history import TrafficHistory
from flowtables.plans import traffic
from flowtables.streaming import streams
from tests import model
from tests.test_time_range import collected

START = minute_of("2021-01-01T00:00:00+00:00")


def at(second):
    return datetime.fromtimestamp(second, timezone.utc)


def frame_of(spark, records):
    return spark.createDataFrame([(o, at(s), status, links) for o, s, status, links in records], model.DETECTOR_SCHEMA)


@pytest.mark.parametrize("interval, rolling", [(5, 5), (2, 6), (1, 3)])
def test_rolling_equals_batch_on_closed_windows(spark, tmp_path, interval, rolling):
    records = list({(r[0], r[1]): r for r in model.random_records(random.Random(4), 3, 40, START)}.values())
    early = [r for r in records if r[1] < (START + 20) * 60]
    folder = str(tmp_path / "in")
    frame_of(spark, early).coalesce(1).write.parquet(folder)
    source = spark.readStream.schema(streams.DETECTOR_STREAM).parquet(folder)
    flows = streams.rolling_flows(source, start=at(START * 60), interval=interval, rolling=rolling, delay="2 minutes")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    streams.run_to_table(flows, out, state)
    frame_of(spark, [r for r in records if r not in early]).coalesce(1).write.mode("append").parquet(folder)
    mine = collected(streams.run_to_table(flows, out, state))

    last = max(r[1] for r in records)
    closed = [m for m in range(START - 60, START + 60) if (m + 1) * 60 <= last - 120]
    wanted = traffic.time_range(frame_of(spark, records), at((START - 4 * rolling * interval) * 60), at(closed[-1] * 60 + 59),
                                time_interval=interval, time_rolling=rolling)
    assert model.flat(mine) == model.flat(collected(wanted))


def test_a_hop_longer_than_the_window_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        streams.rolling_flows(frame_of(spark, []), start=at(0), interval=5, rolling=3, delay="1 minute")


def test_late_record_is_left_out(spark, tmp_path):
    def record(minute):
        return ("VD-0", (START + minute) * 60, "0", [("A", [(50.0, 1.0, [("S", 5, None)])])])

    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    frame_of(spark, [record(0), record(30)]).coalesce(1).write.parquet(folder)
    source = spark.readStream.schema(streams.DETECTOR_STREAM).parquet(folder)
    flows = streams.rolling_flows(source, start=at(START * 60), interval=5, rolling=5, delay="2 minutes")
    before = collected(streams.run_to_table(flows, out, state))
    frame_of(spark, [record(1), record(60)]).coalesce(1).write.mode("append").parquet(folder)
    after = collected(streams.run_to_table(flows, out, state))
    first_window = [r for r in after if r[1] == min(b[1] for b in before)]
    assert len(first_window) == 1 and first_window[0][3][0][1] == 25.0


def test_dedup_keeps_one_per_key(spark, tmp_path):
    rows = [("a", at(60)), ("a", at(60)), ("b", at(60)), ("a", at(120))]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "id string, t timestamp").write.parquet(folder)
    unique = streams.first_of_key(spark.readStream.schema("id string, t timestamp").parquet(folder), "id", "t", time="t", delay="1 minute")
    assert streams.run_to_table(unique, str(tmp_path / "out"), str(tmp_path / "state")).count() == 3


def test_stream_upsert_equals_batch_and_survives_replay(spark, tmp_path):
    rng = random.Random(1)
    lines = [json.dumps({"SectionID": f"s{rng.randrange(3)}", "DataCollectTime": f"2021-01-0{rng.randrange(1, 4)}T08:00:00+08:00",
                         rng.choice("abc"): rng.choice([None, 1, "x", [1, 2]])}) for _ in range(60)]
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.json").write_text("\n".join(lines[20 * n:20 * n + 20]))
        os.utime(folder / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    root = str(tmp_path / "streamed")
    for state in ("one", "two"):
        streams.start_upsert(streams.read_lines(spark, str(folder), maxFilesPerTrigger=1), spark, root, "NFB", "LiveTraffic",
                             checkpoint=str(tmp_path / state), trigger={"availableNow": True}).awaitTermination()
    batch = TrafficHistory(spark, str(tmp_path / "batch"))
    batch.upload_live("NFB", "LiveTraffic", str(folder))
    order = ["SectionID", "DataCollectTime"]
    streamed = TrafficHistory(spark, root).table("NFB", "LiveTraffic").orderBy(*order).collect()
    assert streamed == batch.table("NFB", "LiveTraffic").orderBy(*order).collect()
    assert upsert.key_violations(TrafficHistory(spark, root).table("NFB", "LiveTraffic"), *order).count() == 0
    with pytest.raises(ValueError):
        streams.start_upsert(spark.readStream.text(str(folder)), spark, root, "NFB", "CCTV", checkpoint="x", trigger={})


@pytest.mark.parametrize("interval, rolling", [(5, 5), (2, 6), (1, 3), (5, 3)])
def test_windows_by_timers_equal_batch_with_empty_ones(spark, tmp_path, interval, rolling):
    records = list({(r[0], r[1]): r for r in model.random_records(random.Random(4), 3, 60, START)}.values())
    records = [r for r in records if r[0] != "VD-1" or not START + 15 <= r[1] // 60 < START + 45]  # one is silent for half an hour
    early = [r for r in records if r[1] < (START + 20) * 60]
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    frame_of(spark, early).coalesce(1).write.parquet(folder)
    source = spark.readStream.schema(streams.DETECTOR_STREAM).parquet(folder)
    windows = streams.rolling_windows(source, start=at(START * 60), interval=interval, rolling=rolling, delay="2 minutes")
    streams.run_to_table(windows, out, state)
    frame_of(spark, [r for r in records if r not in early]).coalesce(1).write.mode("append").parquet(folder)
    mine = collected(streams.run_to_table(windows, out, state))
    closed = (max(r[1] for r in records) - 120) // 60 - 1
    wanted = traffic.time_range(frame_of(spark, records), at(START * 60), at(closed * 60 + 59), null_time=1,
                                time_interval=interval, time_rolling=rolling)
    assert model.flat(mine) == model.flat(collected(wanted))


def test_state_does_not_grow_with_lanes():
    def held(lanes):
        detector = streams._Detector(0)
        for minute in range(10):
            detector.add(minute * 60_000_000, 0, [{"LinkID": "A", "Volume": 1.0 * lanes, "Speed": 2.0, "Occupancy": 3.0}], 0)
        return len(streams.pickle.dumps(detector.minutes))

    assert held(1) == held(500)


def test_a_step_of_the_window_looks_only_at_the_minutes_it_passes():
    class Counted(dict):
        seen = 0

        def __iter__(self):
            for key in super().__iter__():
                Counted.seen += 1
                yield key

    minutes = Counted({m: (m * 60_000_000, 0, []) for m in range(-5, 600)})
    detector = streams._Detector(7, minutes)
    given = list(detector.windows(500, 4, 6))
    assert len(given) == 124 and all(status == 0 for _, status, _ in given)
    assert min(detector.minutes) == detector.slot - 5 and Counted.seen < 2_000
