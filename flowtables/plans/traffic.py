"""Whole queries over a table of detector records: each returns one lazy plan for all its detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.catalog import CLASSES
from flowtables.functions.timecols import back_minutes, minute_instant, minute_of
from flowtables.operators import grid, lookup, merge, quality, repair, rolling

DETECTOR = CLASSES["VDLive"]
REPAIR_METHODS = {30: "linear", 31: "polynomial"}
RESULT = ("VDID", "Time", "DataStatus", "LinkFlows")


def check_arguments(*, error_check=1, error_process=0, null_time=0, time_interval=1, time_rolling=1, sort=None,
                    single=False) -> None:
    if error_check != 1:
        raise ValueError("error_check must be 1: only the rule-based check exists")
    if error_process not in (0, 1, 2, *REPAIR_METHODS):
        raise ValueError("error_process must be 0, 1, 2, 30 or 31")
    if single and error_process in REPAIR_METHODS:
        raise ValueError("repair needs neighbouring records; use the time-range query")
    if null_time not in (0, 1) or sort not in (1, -1, None):
        raise ValueError("null_time must be 0 or 1, sort 1, -1 or None")
    if time_interval < 1 or time_rolling < 1:
        raise ValueError("time_interval and time_rolling must be positive")


def one_record(records: DataFrame, *, m_pce=1.0, s_pce=1.0, l_pce=1.0, t_pce=1.0,
               error_check=1, error_process=0) -> DataFrame:
    """Merge each record on its own; ``records`` is the result of a point read."""
    check_arguments(error_check=error_check, error_process=error_process, single=True)
    flows = merge.sum_lanes_sum_vehicles(records, m_pce=m_pce, s_pce=s_pce, l_pce=l_pce, t_pce=t_pce)
    return flows if error_process == 0 else quality.treat_abnormal(flows, error_process)


def merged_range(records: DataFrame, sdate, edate, *, time_rolling=1, **pce) -> DataFrame:
    """Merged records of the scan window, with the untruncated time in ``At``."""
    window = lookup.in_range(records, DETECTOR, back_minutes(sdate, time_rolling - 1), edate)
    return merge.sum_lanes_sum_vehicles(window, keep=(F.col("DataCollectTime").alias("At"),), **pce)


def range_minutes(records: DataFrame, sdate, edate, *, time_rolling=1, error_process=0, null_time=0, sort=None,
                  **pce) -> DataFrame:
    """One record per detector and minute after abnormal handling: the input of grids and windows."""
    flows = merged_range(records, sdate, edate, time_rolling=time_rolling, **pce)
    flows = quality.treat_abnormal(flows, error_process)
    minutes = grid.first_per_minute(flows, descending=sort == -1)
    if error_process in REPAIR_METHODS:
        minutes = repair.repair_minutes(minutes, method=REPAIR_METHODS[error_process], missing=null_time == 1)
    return minutes


def time_range(records: DataFrame, sdate, edate, *, m_pce=1.0, s_pce=1.0, l_pce=1.0, t_pce=1.0, error_check=1,
               error_process=0, null_time=0, time_interval=1, time_rolling=1, sort=None) -> DataFrame:
    """Time-range query, lanes and vehicle types summed: VDID, Time, DataStatus, LinkFlows."""
    check_arguments(error_check=error_check, error_process=error_process, null_time=null_time,
                    time_interval=time_interval, time_rolling=time_rolling, sort=sort)
    pce = dict(m_pce=m_pce, s_pce=s_pce, l_pce=l_pce, t_pce=t_pce)
    first, last = minute_of(sdate), minute_of(edate)
    every_minute = time_interval == 1 and time_rolling == 1
    repairs = error_process in REPAIR_METHODS

    if every_minute and not repairs and (null_time == 0 or error_process == 1):
        flows = merged_range(records, sdate, edate, **pce)
        if error_process != 0:
            flows = quality.treat_abnormal(flows, error_process)
        return _in_order(flows.select(*RESULT, "At"), sort, "At").drop("At")

    minutes = range_minutes(records, sdate, edate, time_rolling=time_rolling, error_process=error_process,
                            null_time=null_time, sort=sort, **pce)
    if every_minute and repairs and null_time == 0:
        result = minutes
    elif every_minute and error_process == 2:
        result = grid.fill_missing_minutes(minutes, first, last, descending=sort == -1)
    else:
        scanned = lookup.in_range(records, DETECTOR, back_minutes(sdate, time_rolling - 1), edate)
        result = rolling.roll(
            minutes, start=first, end=last, interval=time_interval, rolling=time_rolling,
            empty_windows=null_time == 1 and error_process != 1, fill_template=error_process == 2,
            detectors=scanned.select("VDID"), descending=sort == -1)
    return _in_order(result.withColumn("Time", minute_instant(F.col("minute"))).select(*RESULT), sort, "Time")


def _in_order(rows: DataFrame, sort, by: str) -> DataFrame:
    if sort is None:
        return rows
    return rows.orderBy(F.col(by).asc() if sort == 1 else F.col(by).desc(), "VDID")
