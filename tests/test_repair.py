"""Interpolation against a plain loop, with tiny pieces so that neighbours cross them."""

import random

import pytest
from pyspark.sql import functions as F

from flowtables.operators import repair

SCHEMA = "VDID string, minute bigint, DataStatus int, LinkFlows array<struct<LinkID: string, Volume: double, Speed: double, Occupancy: double>>"


def history(seed):
    rng = random.Random(seed)
    rows = []
    for oid in ("VD-1", "VD-2"):
        for minute in range(60):
            if rng.random() < 0.35:
                continue
            status = 2 if rng.random() < 0.3 else 0
            links = [(k, float(rng.randrange(50)), float(rng.randrange(90)), float(rng.randrange(30)))
                     for k in rng.sample(["A", "B"], rng.choice([1, 2, 2]))]
            rows.append((oid, minute, status, links if status == 0 else [(k, -1.0, -1.0, -1.0) for k, *_ in links]))
    return rows


def expected(rows, method):
    out = {}
    for oid in {r[0] for r in rows}:
        status = {r[1]: r[2] for r in rows if r[0] == oid}
        for link in "AB":
            points = [(r[1], k[1]) for r in rows if r[0] == oid and r[2] == 0 for k in r[3] if k[0] == link]
            for i in range(len(points) - 1):
                (x1, y1), (x2, y2) = points[i], points[i + 1]
                for x in range(x1 + 1, x2):
                    if status.get(x) == 0:
                        continue
                    if method == "polynomial" and 0 < i < len(points) - 2:
                        known = points[i - 1:i + 3]
                        y = 0.0
                        for a, (xa, ya) in enumerate(known):
                            term = ya
                            for b, (xb, _) in enumerate(known):
                                if a != b:
                                    term = term * (x - xb) / (xa - xb)
                            y += term
                    else:
                        y = y1 + (y2 - y1) * (x - x1) / (x2 - x1)
                    out[oid, x, link] = y
    return out


@pytest.mark.parametrize("method", ["linear", "polynomial"])
@pytest.mark.parametrize("piece", [1, 3, 7, 1440])
def test_cells(spark, monkeypatch, method, piece):
    rows = history(3)
    monkeypatch.setitem(repair.neighbours.__kwdefaults__, "piece", piece)
    cells = repair.repaired_cells(spark.createDataFrame(rows, SCHEMA), method=method).collect()
    assert {(r.VDID, r.minute, r.LinkID): pytest.approx(r.Volume, abs=1e-7) for r in cells} == expected(rows, method)
    assert len(cells) == len(expected(rows, method))


def test_repaired_minutes_and_missing_option(spark):
    rows = history(5)
    frame = spark.createDataFrame(rows, SCHEMA)
    cells = expected(rows, "linear")
    fixed = {(r.VDID, r.minute): r for r in repair.repair_minutes(frame).collect()}
    assert {k for k, r in fixed.items() if r.DataStatus == 3} == {(o, m) for o, m, _ in cells}
    present = {(r[0], r[1]): r[2] for r in rows}
    only_abnormal = {(r.VDID, r.minute): r.DataStatus for r in repair.repair_minutes(frame, missing=False).collect()}
    assert set(only_abnormal) == set(present)
    assert all(s == 3 for k, s in only_abnormal.items() if present[k] == 2 and any((*k, link) in cells for link in "AB"))


def test_report_covers_every_cell_once(spark):
    rows = history(9)
    report = repair.repair_report(spark.createDataFrame(rows, SCHEMA), 0, 59).withColumn(
        "key", F.struct("VDID", "minute", "LinkID"))
    assert report.count() == report.select("key").distinct().count()
    status = {(r[0], r[1]): r[2] for r in rows}
    absent = sum(1 for (o, m), s in status.items() if s == 0 for k in "AB"
                 if k not in [x[0] for r in rows if (r[0], r[1]) == (o, m) for x in r[3]])
    assert report.count() == 2 * 60 * 2 - absent
