"""Query registry: name -> DataFrame builder, and name -> comparison SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtables.functions.timecols import pin_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(pin_utc(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(column, name: str):
    return F.col(column).cast("timestamp_ntz").alias(name) if isinstance(column, str) else column.cast("timestamp_ntz").alias(name)


def r6(column, name: str):
    return F.round(F.col(column) if isinstance(column, str) else column, 6).alias(name)
