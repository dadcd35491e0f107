"""Costly expressions, such as parsed documents, worked out once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it may name several times."""
    return F.get(F.transform(F.array(value), use), 0)


def unfold(rows: DataFrame, items: str, name: str) -> DataFrame:
    """One row per element of the array ``items``, as ``name``, with its place ``_pos``.

    An inner explode makes the optimizer filter on the array's size, below the expression that makes it, so that a parsed document
    is parsed two or three times; so does a later filter on a projected value. The outer explode does not, and is a bar to both.
    """
    others = [column for column in rows.columns if column != items]
    return rows.select(*others, F.posexplode_outer(items).alias("_pos", name)).where("_pos IS NOT NULL")
