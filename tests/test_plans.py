"""Plan shapes: what must not appear, what must be pushed down, what must be shared."""

import random
import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from flowtables.catalog import CLASSES
from flowtables.functions.timecols import minute_of
from flowtables.plans import traffic
from flowtables.plans.history import TrafficHistory
from flowtables.sources import tables
from flowtables.workload import QUERIES
from tests import model

START = minute_of("2021-01-01T00:00:00+00:00")
SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    records = list({(r[0], r[1]): r for r in model.random_records(random.Random(2), 4, 3000, START)}.values())
    rows = [(o, datetime.fromtimestamp(s, timezone.utc), status, links) for o, s, status, links in records]
    frame = spark.createDataFrame(rows, model.DETECTOR_SCHEMA).withColumn("authority", F.lit("NFB"))
    root = str(tmp_path_factory.mktemp("plans"))
    tables.write(frame, root, CLASSES["VDLive"])
    return TrafficHistory(spark, root)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("stream", "upsert_table", "scan_class", "ingest", "xml_ingest"))))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for node in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text, node


def test_point_read_prunes_partitions_and_pushes_filters(spark, history):
    frame = history.record("NFB", "VDLive", "VD-1", "2021-01-01T08:00:00+08:00")
    text = spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    assert "authority=NFB/dataclass=VDLive" in re.search(r"Location: .*", text).group(0)
    assert "dt" in re.search(r"PartitionFilters: .*", text).group(0)
    pushed = re.search(r"PushedFilters: .*", text).group(0)
    assert "EqualTo(DataCollectTime" in pushed and "EqualTo(VDID" in pushed


def test_a_range_reads_only_its_days(history):
    query = history.records("NFB", "VDLive", None, "2021-01-02T01:00:00Z", "2021-01-02T02:00:00Z")
    assert query.inputFiles() and query.count() > 0
    read = [p for p in query.select(F.input_file_name()).distinct().collect()]
    assert all("dt=2021-01-02" in r[0] for r in read)


def test_a_range_query_reads_only_needed_columns(history):
    text = plan(history.range_sum_lanes_sum_vehicles("NFB", None, "2021-01-01T00:00:00Z", "2021-01-01T05:00:00Z", time_interval=5, time_rolling=15))
    assert "extra" not in re.search(r"ReadSchema: (.*)", text).group(1)
    assert "SubAuthorityCode" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_windows_share_the_first_per_minute_shuffle(history):
    for case in (dict(error_process=2, null_time=1, time_interval=4, time_rolling=6), dict(error_process=2, null_time=1)):
        frame = history.range_sum_lanes_sum_vehicles("NFB", None, "2021-01-01T00:00:00Z", "2021-01-02T05:00:00Z", **case)
        frame.collect()
        final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ReusedExchange" in final
        assert len(re.findall("FileScan", final)) == 1


def test_merging_does_not_shuffle(history):
    flows = history.record_sum_lanes_sum_vehicles("NFB", None, "2021-01-01T00:00:00Z")
    assert "Exchange" not in plan(flows)
    assert "Exchange" not in plan(history.record_sum_lanes_per_vehicle("NFB", None, "2021-01-01T00:00:00Z"))


def test_long_windows_are_bucketed(history):
    """A 60-minute window every 15 minutes hops over quarter-hour buckets: two keyed sums, not one per record and slot."""
    frame = history.range_sum_lanes_sum_vehicles("NFB", None, "2021-01-01T00:00:00Z", "2021-01-02T00:00:00Z", time_interval=15, time_rolling=60)
    assert len(re.findall(r"Exchange hashpartitioning\(VDID[^,]*, lo", frame._jdf.queryExecution().executedPlan().toString())) == 1


def test_one_hot_detector(spark):
    """A detector with far more records than all others: same answer as alone."""
    rng = random.Random(11)
    hot = [(o.replace("VD-0", "VD-hot"), s, st, links) for o, s, st, links in model.random_records(rng, 1, 600, START)]
    cold = list(model.random_records(rng, 3, 20, START))
    rows = {(r[0], r[1]): r for r in hot + cold}.values()
    frame = spark.createDataFrame([(o, datetime.fromtimestamp(s, timezone.utc), st, links) for o, s, st, links in rows], model.DETECTOR_SCHEMA)
    from tests.test_time_range import collected

    ends = (datetime.fromtimestamp(START * 60, timezone.utc), datetime.fromtimestamp((START + 599) * 60, timezone.utc))
    got = traffic.time_range(frame, *ends, error_process=2, null_time=1, time_interval=10, time_rolling=30)
    want = model.time_range(list(rows), START, START + 599, pce={}, error_process=2, null_time=1, time_interval=10, time_rolling=30)
    assert model.flat(collected(got)) == model.flat(want)
