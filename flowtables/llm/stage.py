"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of the warehouse, unless that is on one machine of a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
        if base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share; {base} is on one of them")
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> SparkSession:
    """Texts are long: the batches that go to Python hold fewer of them than Spark's default of 10,000 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


@contextmanager
def without_leftovers(spark: SparkSession):
    """A query's shuffle files go when it ends, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_open = threading.local()


@contextmanager
def scaffolding(spark: SparkSession):
    """Tables :func:`stored` in this block are deleted behind it: what is to stay must have been written elsewhere by then."""
    outer = getattr(_open, "paths", None)
    _open.paths = []
    try:
        yield
    finally:
        conf = spark._jsc.hadoopConfiguration()
        for name in _open.paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        _open.paths = outer


def written(frame: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    """Write ``frame`` to ``path`` and read it back."""
    spark = frame.sparkSession
    with without_leftovers(spark):
        frame.write.parquet(path, compression=codec)
    return spark.read.schema(frame.schema).parquet(path)


def stored(frame: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``frame`` once and read it back: cuts the lineage, and a lost executor costs only the reading tasks."""
    path = new_path(frame.sparkSession, label)
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    return written(frame, path, codec)


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, or something like it that ``frame`` has no column of (names are compared without case)."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def discard(*frames: DataFrame) -> None:
    """Delete the files behind tables made by :func:`stored` that nothing reads any more."""
    for frame in frames:
        jvm = frame.sparkSession._jvm
        conf = frame.sparkSession._jsc.hadoopConfiguration()
        for folder in {name.rpartition("/")[0] for name in frame.inputFiles()}:
            if "/llm-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
