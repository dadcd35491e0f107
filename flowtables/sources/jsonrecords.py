"""JSON sources. A record arrives as ``fields``: top-level name -> value (see ``functions.fieldtext``), so that an absent
field and an explicit null, a number and a text stay apart. ``header`` is the batch's UpdateTime text, ``seq`` the arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtables.catalog import RecordClass
from flowtables.functions import fieldtext
from flowtables.functions.evaluate import unfold

FIELDS = "map<string,variant>"
CORRUPT = "_unreadable"


def envelope_schema(cls: RecordClass) -> str:
    return f"UpdateTime string, {cls.container} array<{FIELDS}>"


def _values(parsed: Column) -> Column:
    return F.transform_values(parsed, lambda _, value: fieldtext.from_variant(value))


def _records(batches: DataFrame, cls: RecordClass) -> DataFrame:
    records = batches.select(F.col("UpdateTime").alias("header"), "_order", F.transform(cls.container, _values).alias("_all"))
    return unfold(records, "_all", "fields").select("header", "fields", F.struct("_order", "_pos").alias("seq"))


def _place(rows: DataFrame) -> DataFrame:
    """Adds ``_order``: file time, file name, split and row of the scan. Must stand right on the scan."""
    return rows.withColumn("_order", F.struct(
        "_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start",
        F.monotonically_increasing_id().alias("row")))


def read_batches(spark: SparkSession, path: str, cls: RecordClass, *, multi_line: bool = True) -> DataFrame:
    """Batch documents from files: one document per file, or one per line (splittable) when not ``multi_line``."""
    return _records(_place(_documents(spark, path, cls, multi_line)), cls)


def _documents(spark: SparkSession, path: str, cls: RecordClass, multi_line: bool) -> DataFrame:
    reader = spark.read.schema(f"{envelope_schema(cls)}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.option("multiLine", multi_line).json(path)


def unreadable(spark: SparkSession, path: str, cls: RecordClass, *, multi_line: bool = True) -> DataFrame:
    """``file, offset, reason, content``: one row for each document that is no JSON or lacks the class's container.

    ``offset`` is where the split begins that holds the document.
    """
    docs = _documents(spark, path, cls, multi_line).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"),
        F.when(F.col(CORRUPT).isNotNull(), "no JSON").when(F.col(cls.container).isNull(), "no container").alias("reason"),
        F.col(CORRUPT).alias("content"))
    return docs.where("reason IS NOT NULL")


def parse_batches(texts: DataFrame, column: str, cls: RecordClass, *, order: str) -> DataFrame:
    """Batch documents already in a text column, with the caller's arrival order."""
    docs = texts.select(F.col(order).alias("_order"), F.from_json(column, envelope_schema(cls)).alias("doc"))
    return _records(docs.select("_order", "doc.*"), cls)


def line_records(lines: DataFrame) -> DataFrame:
    """Raw lines of a text scan as records, keeping where each came from."""
    return lines.select(
        F.lit(None).cast("string").alias("header"), _values(F.from_json("value", FIELDS)).alias("fields"),
        "_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start")


def in_arrival_order(records: DataFrame) -> DataFrame:
    """Adds ``seq`` to line records. Must stand right on the scan or the micro-batch."""
    return records.select("header", "fields", F.struct(
        "file_modification_time", "file_path", "file_block_start", F.monotonically_increasing_id().alias("row")).alias("seq"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Single records, one JSON document per line."""
    return in_arrival_order(line_records(spark.read.text(path)))
