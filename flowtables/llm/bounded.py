"""Helpers whose size does not follow the data: a bit filter over hashes, and a join that takes its few hot keys apart."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.llm.stage import discard, stored, without_leftovers

LEAST_BITS, MOST_BITS = 20, 29  # of a filter: 64 MB at most, whatever the table's size
CHUNK_BITS = 18
HOT_KEYS = 1000


def bit_filter(hashes: DataFrame, like: np.ndarray | None = None) -> np.ndarray:
    """A filter with one bit for the first bits of every hash in ``hash``, made in chunks by the executors.

    A given hash always passes. It has sixteen bits a hash while that is at most 2 ** ``MOST_BITS``, so one in sixteen of other hashes
    passes too; beyond that more do. With ``like``, it has as many bits as that filter.
    """
    given = stored(hashes.select("hash"), "hashes")
    size = max(LEAST_BITS, min(MOST_BITS, (16 * given.count()).bit_length())) if like is None else (64 * len(like)).bit_length() - 1

    def chunk(table: pa.Table) -> pa.Table:
        there = np.zeros(1 << CHUNK_BITS, bool)
        hashes = table.column("hash").to_numpy().view("uint64")
        there[(hashes >> np.uint64(64 - size)) & np.uint64((1 << CHUNK_BITS) - 1)] = True
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": [np.packbits(there, bitorder="little").tobytes()]})

    chunks = given.withColumn("chunk", F.shiftrightunsigned("hash", 64 - size + CHUNK_BITS)).groupBy("chunk").applyInArrow(
        chunk, "chunk long, bits binary")
    bits = np.zeros(1 << (size - 3), "uint8")
    with without_leftovers(hashes.sparkSession):
        for row in chunks.collect():
            bits[row.chunk << (CHUNK_BITS - 3):(row.chunk + 1) << (CHUNK_BITS - 3)] = np.frombuffer(row.bits, "uint8")
    discard(given)
    return bits.view("<u8")


def passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned) may have been given."""
    top = hashes >> np.uint64(65 - (64 * len(bits)).bit_length())
    return (bits[top >> np.uint64(6)] >> (top & np.uint64(63))) & np.uint64(1) == 1


def joined(many: DataFrame, one: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has one row a key and in ``n`` the key's number of rows in ``many``.

    A key with a thousandth of all rows or more would make one task the longest. There are ``HOT_KEYS`` of them at most, so
    their rows of ``one`` go to every task, and only the other keys are shuffled. ``one`` is read several times: a stored table.
    """
    total, most = one.agg(F.sum(n), F.max(n)).first()
    bound = max(HOT_KEYS, -(-(total or 0) // HOT_KEYS))
    if (most or 0) <= bound:
        return many.join(one.drop(n), keys)
    hot = F.broadcast(one.filter(F.col(n) > bound).drop(n))
    rest = many.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(one.filter(F.col(n) <= bound).drop(n), keys)
    return many.join(hot, keys).unionByName(rest)
