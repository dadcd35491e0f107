"""Comparing the members of large groups block against block, so that no task holds a group whole."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def in_blocks(members: DataFrame, keys: list[str], size: str, salt: str) -> DataFrame:
    """Deals every group (``keys``) of ``size`` members out in pairs of blocks of about ``BLOCK`` members.

    A group of up to ``BLOCK`` is one block. Adds ``block`` (the member's own), ``low`` and ``high`` (the pair of blocks);
    rows of one ``keys, low, high`` come next to each other in one partition.
    """
    many = F.ceil(F.col(size) / BLOCK).cast("int")
    split = members.withColumn("block", F.pmod(F.xxhash64(salt), many).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
    split = split.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", size)
    order = [*keys, "low", "high"]
    return split.repartition(*order).sortWithinPartitions(*order)


def whole_groups(batches, keys: list[str]):
    """Record batches with no group (``keys``, adjacent rows) cut in two. A group is bounded by :func:`in_blocks`."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        last = [table.column(k)[-1] for k in keys]
        begin = table.num_rows - 1
        low = 0
        while low < begin:  # rows are sorted: halve to the first row of the last group
            mid = (low + begin) // 2
            if [table.column(k)[mid] for k in keys] == last:
                begin = mid
            else:
                low = mid + 1
        if begin:
            yield table.slice(0, begin).combine_chunks()
        held = table.slice(begin)
    if held is not None:
        yield held.combine_chunks()


def pairs_within(starts_new, test: Callable):
    """Calls ``test(i, j)`` with arrays of row numbers for all pairs of rows of one group, by distance.

    ``starts_new`` says where a group begins; work and memory of a call follow the number of rows.
    """
    import numpy as np

    group = np.cumsum(starts_new)
    rows = np.arange(len(group))
    distance = 1
    while len(rows):
        rows = rows[rows + distance < len(group)]
        rows = rows[group[rows] == group[rows + distance]]
        if len(rows):
            test(rows, rows + distance)
        distance += 1
