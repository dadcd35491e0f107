"""Windows and gaps much longer than the hop: right, and in work that does not follow their length."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from flowtables.operators import repair, rolling
from flowtables.plans import traffic
from tests import model
from tests.test_time_range import ARGUMENTS, PCE, START, at, collected


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(21)
    records = list({(r[0], r[1]): r for r in model.random_records(rng, 3, 90, START)}.values())
    return records, spark.createDataFrame([(oid, at(second), status, links) for oid, second, status, links in records], model.DETECTOR_SCHEMA).cache()


@pytest.mark.parametrize("case", [
    dict(error_process=e, null_time=n, time_interval=i, time_rolling=r)
    for (e, n), (i, r) in itertools.product(((0, 0), (2, 1), (1, 0)), ((1, 9), (1, 60), (2, 27), (7, 40), (2, 18), (5, 45), (13, 27)))],
    ids=lambda c: "-".join(map(str, c.values())))
def test_running_sums_equal_the_model(history, case):
    records, frame = history
    first, last = START + 20, START + 85
    mine = traffic.time_range(frame, at(first * 60), at(last * 60), **case, **ARGUMENTS)
    assert model.flat(collected(mine)) == model.flat(model.time_range(records, first, last, pce=PCE, **case))


def test_rows_moved_do_not_grow_with_the_window(spark):
    """A minute is in 1,440 windows of a day each; it must not become 1,440 rows."""
    minutes = spark.range(3 * 1440).select(
        F.lit("VD-1").alias("VDID"), F.col("id").alias("minute"), F.lit(0).alias("DataStatus"),
        F.expr("array(named_struct('LinkID', 'A', 'Volume', 1d, 'Speed', 2d, 'Occupancy', 3d))").alias("LinkFlows"))
    rows = rolling.contributions(minutes, count_abnormal=False).cache()
    given = rows.count()
    for window in (60, 1440):
        moved = rolling.slot_rows(rows, start=0, end=3 * 1440 - 1, interval=1, rolling=window)
        assert moved.count() <= 2 * given
    windows = rolling.roll(minutes, start=0, end=3 * 1440 - 1, interval=1, rolling=1440)
    full = windows.where("minute >= 1439")
    assert full.select("LinkFlows").distinct().collect()[0].LinkFlows[0].asDict() == {"LinkID": "A", "Volume": 1440.0, "Speed": 2.0, "Occupancy": 3.0}
    assert full.select("LinkFlows").distinct().count() == 1 and windows.count() == 3 * 1440


def test_no_volume_in_a_window_is_exactly_none(spark):
    """Weighted volumes that have no exact double: a later window of zeros must not show what sums of them leave behind."""
    minutes = spark.range(200).select(
        F.lit("VD-1").alias("VDID"), F.col("id").alias("minute"), F.lit(0).alias("DataStatus"),
        F.transform(F.array(F.when(F.col("id") < 100, F.lit(0.1) * F.col("id")).otherwise(0.0)), lambda v: F.struct(
            F.lit("A").alias("LinkID"), v.alias("Volume"), F.lit(50.0).alias("Speed"), F.lit(1.0).alias("Occupancy"))).alias("LinkFlows"))
    windows = rolling.roll(minutes, start=0, end=199, interval=1, rolling=31)
    late = {(r.LinkFlows[0].Volume, r.LinkFlows[0].Speed) for r in windows.where("minute >= 130").collect()}
    assert late == {(0.0, 0.0)}


def test_a_long_gap_is_repaired_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", 50)
    ends = spark.createDataFrame([("VD-1", 0, 0, [("A", 0.0, 10.0, 0.0)]), ("VD-1", 1000, 0, [("A", 100.0, 20.0, 50.0)])],
                                 "VDID string, minute long, DataStatus int, LinkFlows array<struct<LinkID:string,Volume:double,Speed:double,Occupancy:double>>")
    fixed = repair.repaired_cells(ends).orderBy("minute").collect()
    assert [r.minute for r in fixed] == list(range(1, 1000))
    assert all(abs(r.Volume - r.minute / 10) < 1e-9 and abs(r.Speed - 10 - r.minute / 100) < 1e-9 for r in fixed)
