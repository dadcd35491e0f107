"""Where jobs stage intermediate tables: the cluster's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, in a folder of the warehouse, unless that is on one machine of a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        if base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share; {base} is on one of them")
    return f"{base.rstrip('/')}/flowtables-{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made at a :func:`scratch_path` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
