"""The library's front door: one object per table root, one method per query or upload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtables.catalog import LIVE_UPLOAD, STATIC_UPLOAD, record_class
from flowtables.functions.timecols import back_minutes, pin_utc
from flowtables.operators import lookup, merge, upsert
from flowtables.plans import traffic
from flowtables.sources import jsonrecords, tables, xmlrecords


class TrafficHistory:
    """Queries take one id or a list of ids, or ``None`` for every id of the class, and return lazy DataFrames."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = pin_utc(spark)
        self.root = root

    # Reads of the stored records

    def table(self, authority: str, dataclass: str, *, since=None, until=None) -> DataFrame:
        return tables.scan(self.spark, self.root, authority, dataclass, since=since, until=until).drop("dt")

    def _of(self, authority, dataclass, oid, since, until) -> DataFrame:
        rows = self.table(authority, dataclass, since=since, until=until)
        return rows if oid is None else lookup.by_id(rows, record_class(dataclass), oid)

    def record(self, authority: str, dataclass: str, oid, date) -> DataFrame:
        """Records of one instant."""
        return lookup.at_time(self._of(authority, dataclass, oid, date, date), record_class(dataclass), date)

    def records(self, authority: str, dataclass: str, oid, sdate, edate, sort=None) -> DataFrame:
        """Records of a time range, both ends included."""
        cls = record_class(dataclass)
        return lookup.sorted_by_time(
            lookup.in_range(self._of(authority, dataclass, oid, sdate, edate), cls, sdate, edate), cls, sort)

    def as_json(self, rows: DataFrame) -> DataFrame:
        """Whole records, with every field they were uploaded with."""
        times = [f.name for f in rows.schema if f.dataType.typeName() == "timestamp"]
        return tables.json_rows(rows, *times)

    def as_xml(self, rows: DataFrame, row_tag: str) -> DataFrame:
        """Whole records, with every field they were uploaded with."""
        times = [f.name for f in rows.schema if f.dataType.typeName() == "timestamp"]
        return tables.xml_rows(rows, row_tag, *times)

    # Detector flows

    def record_sum_lanes_sum_vehicles(self, authority: str, oid, date, **options) -> DataFrame:
        return traffic.one_record(self.record(authority, "VDLive", oid, date), **options)

    def record_sum_lanes_per_vehicle(self, authority: str, oid, date, **pce) -> DataFrame:
        return merge.sum_lanes_per_vehicle(self.record(authority, "VDLive", oid, date), **pce)

    def record_per_lane_sum_vehicles(self, authority: str, oid, date, **pce) -> DataFrame:
        return merge.per_lane_sum_vehicles(self.record(authority, "VDLive", oid, date), **pce)

    def record_per_lane_per_vehicle(self, authority: str, oid, date, **pce) -> DataFrame:
        return merge.per_lane_per_vehicle(self.record(authority, "VDLive", oid, date), **pce)

    def range_sum_lanes_sum_vehicles(self, authority: str, oid, sdate, edate, *, time_rolling=1, **options) -> DataFrame:
        since = back_minutes(sdate, time_rolling - 1)
        return traffic.time_range(
            self._of(authority, "VDLive", oid, since, edate), sdate, edate, time_rolling=time_rolling, **options)

    # Uploads

    def upload_batch(self, authority: str, dataclass: str, path: str, *, multi_line: bool = True) -> DataFrame:
        """Upsert JSON batch documents; returns the rejected records and the documents that could not be read."""
        cls = record_class(dataclass)
        rejected = self._upsert(authority, dataclass, upsert.key_batch(
            jsonrecords.read_batches(self.spark, path, cls, multi_line=multi_line), cls))
        return rejected.unionByName(jsonrecords.unreadable(self.spark, path, cls, multi_line=multi_line), allowMissingColumns=True)

    def upload_batch_xml(self, authority: str, dataclass: str, path: str) -> DataFrame:
        """Upsert XML batch documents, one per file of any size; returns the rejected records and what could not be read."""
        cls = record_class(dataclass)
        rejected = self._upsert(authority, dataclass, upsert.key_batch(xmlrecords.read_batches(self.spark, path, cls), cls))
        return rejected.unionByName(xmlrecords.unreadable(self.spark, path, cls), allowMissingColumns=True)

    def upload_live(self, authority: str, dataclass: str, path: str) -> DataFrame:
        """Upsert single live records, one JSON document per line; returns the rejected records."""
        cls = record_class(dataclass, LIVE_UPLOAD)
        return self._upsert(authority, dataclass, upsert.key_live(jsonrecords.read_records(self.spark, path), cls))

    def upload_static(self, authority: str, dataclass: str, date, path: str) -> DataFrame:
        """Upsert single static records under the given date; returns the rejected records."""
        cls = record_class(dataclass, STATIC_UPLOAD)
        return self._upsert(authority, dataclass, upsert.key_static(jsonrecords.read_records(self.spark, path), cls, date))

    def append_batch(self, authority: str, dataclass: str, path: str, *, multi_line: bool = True) -> DataFrame:
        """Add only the batch records whose key is new; returns the rejected records."""
        cls = record_class(dataclass)
        keyed = upsert.key_batch(jsonrecords.read_batches(self.spark, path, cls, multi_line=multi_line), cls)
        tables.append_new(self.spark, self.root, authority, dataclass, keyed)
        return upsert.rejected(keyed)

    def _upsert(self, authority: str, dataclass: str, keyed: DataFrame) -> DataFrame:
        tables.upsert_into(self.spark, self.root, authority, dataclass, keyed)
        return upsert.rejected(keyed)


def xml_to_json(spark: SparkSession, dataclass: str, source: str, target: str) -> None:
    """XML batch files to JSON batch documents, one line each."""
    cls = record_class(dataclass)
    texts = spark.read.text(source, wholetext=True)
    docs = xmlrecords.parse_documents(texts, "value", cls)
    xmlrecords.document_json(docs, cls).select(F.col("json").alias("value")).write.text(target)
