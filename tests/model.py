"""A plain, row-at-a-time model of the time-range query, written from its rules: the tests' brute force."""

from __future__ import annotations

import random
from fractions import Fraction

DETECTOR_SCHEMA = (
    "VDID string, DataCollectTime timestamp, Status string, LinkFlows array<struct<LinkID: string, "
    "Lanes: array<struct<Speed: double, Occupancy: double, "
    "Vehicles: array<struct<VehicleType: string, Volume: bigint, Speed: double>>>>>>"
)


def random_records(rng: random.Random, detectors: int, minutes: int, start: int):
    """(oid, epoch second, status, links) with gaps, repeated minutes, abnormal readings, changing link sets."""
    for d in range(detectors):
        for minute in range(minutes):
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                second = (start + minute) * 60 + rng.randrange(60)
                links = []
                for name in rng.sample(["A", "B", "C"], rng.choice([0, 1, 2, 2, 3])):
                    lanes = []
                    for _ in range(rng.choice([0, 1, 2])):
                        vehicles = [(rng.choice("MSLTX"), rng.choice([0, 0, 3, 8, 40, 312 if rng.random() < 0.03 else 5]), None)
                                    for _ in range(rng.choice([0, 1, 2]))]
                        lanes.append((float(rng.choice([0, 50, 80, 151 if rng.random() < 0.03 else 60])),
                                      float(rng.choice([0, 10, 25])), vehicles))
                    links.append((name, lanes))
                yield f"VD-{d}", second, rng.choice(["0"] * 9 + ["1"]), links


def merge(record, pce):
    oid, second, status, links = record
    bad = status != "0"
    merged = []
    for name, lanes in links:
        volume = moved = occupancy = Fraction(0)
        for speed, lane_occupancy, vehicles in lanes:
            bad |= not 0 <= speed <= 150 or not 0 <= lane_occupancy <= 100
            bad |= any(not 0 <= count <= 311 for _, count, _ in vehicles)
            lane_volume = sum(Fraction(count) * Fraction(pce.get(kind, 1)) for kind, count, _ in vehicles)
            volume += lane_volume
            moved += Fraction(speed) * lane_volume
            occupancy += Fraction(lane_occupancy)
        merged.append((name, volume, moved / volume if volume > 0 else moved, occupancy / len(lanes) if lanes else occupancy))
    return {"oid": oid, "second": second, "minute": second // 60, "status": 2 if bad else 0, "links": merged}


def blank(links):
    return [(name, -1, -1, -1) for name, *_ in links]


def time_range(records, first, last, *, pce, error_process, null_time, time_interval, time_rolling, sort=None):
    """Rows (oid, minute, status, links or None) for one or many detectors; times are epoch minutes."""
    R, I, E, N = time_rolling, time_interval, error_process, null_time
    result = []
    for oid in sorted({r[0] for r in records}):
        mine = [merge(r, pce) for r in records if r[0] == oid and (first - R + 1) * 60 <= r[1] <= last * 60]
        mine.sort(key=lambda r: r["second"], reverse=sort == -1)
        if I == R == 1 and E == 0 and N == 0:
            result += [(oid, r["minute"], r["status"], r["links"]) for r in mine]
            continue
        handled = [r if r["status"] == 0 else dict(r, links=blank(r["links"])) for r in mine if r["status"] == 0 or E != 1]
        if I == R == 1 and (N == 0 or E == 1):
            result += [(oid, r["minute"], r["status"], r["links"]) for r in handled]
            continue
        if not handled:
            continue
        template = blank(handled[0]["links"])
        by_minute = {}
        for r in handled:
            by_minute.setdefault(r["minute"], r)
        grid = [by_minute.get(m, {"minute": m, "status": 1, "links": template}) for m in range(first - R + 1, last + 1)]
        if I == R == 1 and E == 2:
            result += [(oid, r["minute"], r["status"], r["links"]) for r in grid]
            continue
        for index in range(R - 1, len(grid)):
            if index % I != I - 1:
                continue
            window = grid[index - R + 1:index + 1]
            valid = [r for r in window if r["status"] in (0, 3)]
            if not valid:
                if E != 1 and N == 1:
                    status = 1 if any(r["status"] == 1 for r in window) else 2
                    result.append((oid, grid[index]["minute"], status, template if E == 2 else None))
                continue
            links = []
            for name, *_ in valid[0]["links"]:
                same = [k for r in valid for k in r["links"] if k[0] == name]
                volume, moved = sum(k[1] for k in same), sum(k[1] * k[2] for k in same)
                links.append((name, volume / Fraction(len(valid)) * R, moved / volume if volume else 0,
                              sum(k[3] for k in same) / Fraction(len(valid))))
            result.append((oid, grid[index]["minute"], 0, links))
    return result


def flat(rows):
    """Comparable rows with rounded readings."""
    out = []
    for oid, minute, status, links in rows:
        if not links:
            out.append((oid, minute, status, None, None, None, None))
        for name, volume, speed, occupancy in links or []:
            out.append((oid, minute, status, name, round(float(volume), 5), round(float(speed), 5), round(float(occupancy), 5)))
    return sorted(out, key=repr)
