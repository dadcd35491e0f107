"""Streams of records: continuous upsert, first-wins deduplication, rolling windows.

All state is bounded by the watermark: an aggregate per detector and minute, then one per window holding
at most one entry per minute of the window.
"""

from __future__ import annotations

import pickle
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from flowtables.catalog import FLOW_LINKS, LIVE_UPLOAD, VDLIVE_LINKS, record_class
from flowtables.functions import flow
from flowtables.functions.timecols import epoch_minute, minute_instant, minute_of
from flowtables.operators import merge, upsert
from flowtables.operators.grid import first_by
from flowtables.operators.rolling import first_slot
from flowtables.sources import jsonrecords, tables

DETECTOR_STREAM = f"VDID string, DataCollectTime timestamp, Status string, LinkFlows {VDLIVE_LINKS}"


def read_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """A folder of JSON lines as a stream of raw records."""
    return jsonrecords.line_records(spark.readStream.options(**options).text(path))


def start_upsert(lines: DataFrame, spark: SparkSession, root: str, authority: str, dataclass: str, *,
                 checkpoint: str, trigger: dict, compact_every: int = 100) -> StreamingQuery:
    """Every micro-batch is upserted into the class table, writing only the fields it gives; every ``compact_every`` batches the
    layers so made are compacted. A batch replayed after a crash is known by its number and changes nothing."""
    cls = record_class(dataclass, LIVE_UPLOAD)

    def apply(batch: DataFrame, number: int) -> None:
        keyed = upsert.key_live(jsonrecords.in_arrival_order(batch), cls)
        tables.upsert_delta(batch.sparkSession, root, authority, dataclass, keyed, stream=checkpoint, batch_no=number)
        if number % compact_every == compact_every - 1:
            tables.compact(batch.sparkSession, root, authority, dataclass)

    return lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def first_of_key(stream: DataFrame, *key: str, time: str, delay: str) -> DataFrame:
    """For append-only sinks: the first record of a key wins while the watermark remembers it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def _window_links(records: Column, rolling: int) -> Column:
    """Readings of the links of the first usable record, summed over the window's usable records."""

    def total(link_id, reading):
        return F.aggregate(records, F.lit(0.0), lambda acc, r: acc + F.aggregate(
            F.filter(r["LinkFlows"], lambda k: k["LinkID"] == link_id), F.lit(0.0), lambda n, k: n + reading(k)))

    def link(k):
        volume = total(k["LinkID"], lambda x: x["Volume"])
        moved = total(k["LinkID"], lambda x: x["Speed"] * x["Volume"])
        return F.struct(
            k["LinkID"].alias("LinkID"), (volume / F.size(records) * rolling).alias("Volume"),
            F.when(volume == 0, F.lit(0.0)).otherwise(moved / volume).alias("Speed"),
            (total(k["LinkID"], lambda x: x["Occupancy"]) / F.size(records)).alias("Occupancy"))

    return F.transform(records[0]["LinkFlows"], link)


def rolling_flows(records: DataFrame, *, start, interval: int, rolling: int, delay: str, **pce) -> DataFrame:
    """Rolling windows over a stream of detector records: VDID, Time (slot), DataStatus, LinkFlows.

    ``start`` fixes the phase of the slots as in the batch query. The hop must not exceed the window.
    Windows without a usable record do not exist on a stream.
    """
    if interval > rolling:
        raise ValueError("a stream needs time_interval <= time_rolling")
    phase = (minute_of(start) - 2 * rolling + 1) % interval
    flows = merge.sum_lanes_sum_vehicles(records, keep=(F.col("DataCollectTime").alias("At"),), **pce).withWatermark("At", delay)
    minutes = flows.groupBy("VDID", F.window("At", "1 minute")).agg(
        first_by(F.col("At"), F.struct("DataStatus", "LinkFlows"), False).alias("first"))
    minutes = minutes.select(
        "VDID", F.window_time("window").alias("MinuteEnd"), epoch_minute(F.col("window.start")).alias("minute"),
        "first.DataStatus", "first.LinkFlows")
    hops = F.window("MinuteEnd", f"{rolling} minutes", f"{interval} minutes", f"{phase} minutes")
    usable = F.col("DataStatus").isin(flow.NORMAL, flow.REPAIR)
    windows = minutes.groupBy("VDID", hops).agg(
        F.collect_list(F.when(usable, F.struct("minute", "DataStatus", "LinkFlows"))).alias("records"))
    records_in_order = F.sort_array("records")
    return (
        windows.withColumn("records", records_in_order).where(F.size("records") > 0)
        .select(
            "VDID", minute_instant(epoch_minute(F.col("window.end")) - 1).alias("Time"),
            F.array_max(F.transform("records", lambda r: r["DataStatus"])).alias("DataStatus"),
            _window_links(F.col("records"), rolling).alias("LinkFlows"))
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append everything available now to a Parquet table and read it."""
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


NORMAL, NODATA, ABNORMAL, REPAIR = flow.NORMAL, flow.NODATA, flow.ABNORMAL, flow.REPAIR
# The state's code goes to the executors with the query, so that they need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
#: What :func:`rolling_windows` gives.
WINDOWS = f"VDID string, Time timestamp, DataStatus int, LinkFlows {FLOW_LINKS}"


class _Detector:
    """One detector's minutes that windows to come may need: of each the first record's status and its links' sums."""

    def __init__(self, slot: int, minutes: dict[int, tuple] | None = None):
        self.slot = slot  # the next one to give
        self.minutes = minutes or {}  # minute -> (time of the record, status, [(LinkID, volume, volume * speed, occupancy)])

    def add(self, at: int, status: int, links, closed: int) -> None:
        minute = at // 60_000_000
        if minute < closed:
            return  # its windows may have been given: as late as for any aggregate
        sums = [(k["LinkID"], k["Volume"], k["Volume"] * k["Speed"], k["Occupancy"]) for k in links if status in (NORMAL, REPAIR)]
        record = (at, int(status), sums)
        if minute not in self.minutes or record[:2] < self.minutes[minute][:2]:
            self.minutes[minute] = record

    def windows(self, until: int, interval: int, rolling: int):
        """The windows that end before minute ``until``: slot, status, links (None where no record is usable).

        A step forgets only the minutes it passes: looking through all that are held would cost their square.
        """
        if self.slot < until:
            for minute in [m for m in self.minutes if m <= self.slot - rolling]:
                del self.minutes[minute]
        while self.slot < until:
            inside = [self.minutes[m] for m in range(self.slot - rolling + 1, self.slot + 1) if m in self.minutes] if self.minutes else []
            usable = [(status, links) for _, status, links in inside if status in (NORMAL, REPAIR)]
            if usable:
                yield self.slot, max(status for status, _ in usable), self._links([links for _, links in usable], rolling)
            else:
                yield self.slot, ABNORMAL if len(inside) == rolling else NODATA, None
            for minute in range(self.slot - rolling + 1, self.slot + interval - rolling + 1) if self.minutes else ():
                self.minutes.pop(minute, None)
            self.slot += interval

    @staticmethod
    def _links(records: list, rolling: int) -> list[dict]:
        totals = {link_id: [0.0, 0.0, 0.0] for link_id, *_ in records[0]}
        for links in records:
            for link_id, *sums in links:
                if link_id in totals:
                    totals[link_id] = [a + b for a, b in zip(totals[link_id], sums, strict=True)]
        n = len(records)
        return [{"LinkID": link_id, "Volume": volume / n * rolling, "Speed": moved / volume if volume else 0.0, "Occupancy": occupancy / n}
                for link_id, (volume, moved, occupancy) in totals.items()]


def rolling_windows(records: DataFrame, *, start, interval: int, rolling: int, delay: str, **pce) -> DataFrame:
    """Every window of every detector seen, from ``start`` on, also those without a usable record: what the batch query gives with
    ``null_time=1``, as far as the watermark has come. Columns as :func:`rolling_flows`.

    State is one entry a detector and minute, for as many minutes as a window and the delay have, with one sum a link and reading
    whatever the lanes. A timer at the end of its next window wakes a detector that sends nothing.
    """
    origin = first_slot(minute_of(start), interval, rolling)
    flows = merge.sum_lanes_sum_vehicles(records, keep=(F.col("DataCollectTime").alias("At"),), **pce).withWatermark("At", delay)
    flows = flows.select("VDID", "At", F.unix_micros("At").alias("micros"), "DataStatus", "LinkFlows")

    def advance(key, batches, state):
        detector = _Detector(*pickle.loads(state.get[0])) if state.exists else _Detector(origin)
        closed = state.getCurrentWatermarkMs() // 60_000
        if not state.hasTimedOut:
            for batch in batches:
                for at, status, links in zip(batch["micros"], batch["DataStatus"], batch["LinkFlows"], strict=True):
                    detector.add(int(at), status, () if links is None else links, closed)
        some = []
        for slot, status, links in detector.windows(closed, interval, rolling):
            some.append((key[0], pd.Timestamp(slot * 60, unit="s"), status, links))
            if len(some) == 10_000:
                yield pd.DataFrame(some, columns=["VDID", "Time", "DataStatus", "LinkFlows"])
                some = []
        if some:
            yield pd.DataFrame(some, columns=["VDID", "Time", "DataStatus", "LinkFlows"])
        state.update((pickle.dumps((detector.slot, detector.minutes)),))  # plain values: state outlives this code
        state.setTimeoutTimestamp((max(detector.slot, closed) + 1) * 60_000)

    return flows.groupBy("VDID").applyInPandasWithState(advance, WINDOWS, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
