"""The time-range query against the row-at-a-time model."""

import itertools
import random
from datetime import datetime, timezone

import pytest

from flowtables.functions.timecols import minute_of
from flowtables.plans import traffic
from tests import model

START = minute_of("2021-01-01T00:00:00+00:00")
PCE = {"M": 0.5, "S": 1.0, "L": 2.0, "T": 3.0}
ARGUMENTS = dict(m_pce=0.5, s_pce=1.0, l_pce=2.0, t_pce=3.0)


def at(second):
    return datetime.fromtimestamp(second, timezone.utc)


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    rng = random.Random(7)
    records = list(model.random_records(rng, 5, 40, START))
    unique = list({(r[0], r[1]): r for r in records}.values())
    path = str(tmp_path_factory.mktemp("history"))
    rows = [(oid, at(second), status, links) for oid, second, status, links in unique]
    spark.createDataFrame(rows, model.DETECTOR_SCHEMA).write.mode("overwrite").parquet(path)
    return unique, spark.read.parquet(path)


def collected(frame):
    return [(r.VDID, int(r.Time.replace(tzinfo=timezone.utc).timestamp()) // 60, r.DataStatus,
             None if r.LinkFlows is None else [tuple(k) for k in r.LinkFlows]) for r in frame.collect()]


CASES = [
    dict(error_process=e, null_time=n, time_interval=i, time_rolling=r)
    for e, n, (i, r) in itertools.product((0, 1, 2), (0, 1), ((1, 1), (5, 5), (2, 6), (3, 2), (5, 3), (1, 4)))
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: "-".join(map(str, c.values())))
def test_equals_model(history, case):
    records, frame = history
    first, last = START + 5, START + 36
    mine = traffic.time_range(frame, at(first * 60), at(last * 60), **case, **ARGUMENTS)
    expected = model.time_range(records, first, last, pce=PCE, **case)
    assert model.flat(collected(mine)) == model.flat(expected)


@pytest.mark.parametrize("case", [
    dict(error_process=2, null_time=1, time_interval=1, time_rolling=1),
    dict(error_process=2, null_time=1, time_interval=2, time_rolling=4),
    dict(error_process=0, null_time=0, time_interval=1, time_rolling=1),
])
def test_descending(history, case):
    records, frame = history
    first, last = START + 5, START + 36
    mine = collected(traffic.time_range(frame, at(first * 60), at(last * 60), sort=-1, **case, **ARGUMENTS))
    assert model.flat(mine) == model.flat(model.time_range(records, first, last, pce=PCE, sort=-1, **case))
    assert [r[1] for r in mine] == sorted((r[1] for r in mine), reverse=True)


def test_phase_of_slots_for_many_pairs(history):
    """The slot formula against the index rule, for every detector minute, with buckets and without."""
    records, frame = history
    first, last = START + 3, START + 38
    for rolling, interval in itertools.product((4, 6, 10), (1, 4, 10)):
        case = dict(error_process=0, null_time=1, time_interval=interval, time_rolling=rolling)
        mine = traffic.time_range(frame, at(first * 60), at(last * 60), **case)
        assert model.flat(collected(mine)) == model.flat(model.time_range(records, first, last, pce={}, **case)), case


def test_long_grids_are_cut_into_pieces(spark, history, monkeypatch):
    from flowtables.operators import grid

    monkeypatch.setattr(grid, "GRID_PIECE", 7)
    records, frame = history
    first, last = START + 5, START + 36
    for case in (dict(error_process=2, null_time=1, time_interval=1, time_rolling=1),
                 dict(error_process=2, null_time=1, time_interval=3, time_rolling=2)):
        mine = traffic.time_range(frame, at(first * 60), at(last * 60), **case)
        assert model.flat(collected(mine)) == model.flat(model.time_range(records, first, last, pce={}, **case))


def test_all_abnormal_and_dropped_gives_nothing(spark):
    rows = [("VD-1", at(START * 60), "1", [("A", [(50.0, 1.0, [("S", 3, None)])])])]
    frame = spark.createDataFrame(rows, model.DETECTOR_SCHEMA)
    query = traffic.time_range(frame, at(START * 60), at(START * 60 + 600), error_process=1, null_time=1, time_interval=2, time_rolling=2)
    assert query.collect() == []


def test_equal_weights_scale_volume_and_keep_speed(spark):
    rows = [("VD-1", at(START * 60), "0", [("A", [(50.0, 1.0, [("S", 3, None), ("M", 4, None)]), (80.0, 3.0, [("T", 5, None)])])])]
    frame = spark.createDataFrame(rows, model.DETECTOR_SCHEMA)
    args = (at(START * 60), at(START * 60 + 60))
    (one,), (two,) = (collected(traffic.time_range(frame, *args, m_pce=w, s_pce=w, l_pce=w, t_pce=w)) for w in (1, 2))
    (_, volume, speed, occupancy), = one[3]
    assert two[3] == [("A", 2 * volume, speed, occupancy)]


def test_arguments_are_checked(history):
    _, frame = history
    for wrong in (dict(error_check=2), dict(error_process=32), dict(null_time=2), dict(time_interval=0), dict(sort=5)):
        with pytest.raises(ValueError):
            traffic.time_range(frame, at(0), at(60), **wrong)
    with pytest.raises(ValueError):
        traffic.one_record(frame, error_process=30)
