"""Best-fit packing planned on the histogram of lengths.

The plan is made over counts, not documents: at most ``capacity`` lengths, whatever the number of rows. It says for each
length which ranks of that length go to which sequences. Every piece then finds its place from its rank within its length.
Ranks are counted where the pieces are cut: each task numbers its own pieces of a length, and only the tasks' counts meet, one
row a task and length. So no piece is moved or sorted for its rank, whatever its length holds of all pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowtables.llm.stage import small_batches, stored
from flowtables.llm.tokens import encoder, read_spec

CAPACITY = 2048
END_ID = 0


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as token ids with the end id, cut to ``capacity``: ``doc_id, piece, start, length, ids_crc32, part, nth``.

    ``part`` is the task and ``nth`` the piece's number from 0 among the task's pieces of its length. They hold for one run
    of the tasks: write the rows before using them, with no ``coalesce`` in between. ``with_ids`` adds the ids (little-endian
    unsigned 32-bit). A null or empty text is the end id alone.
    """
    spec = small_batches(docs.sparkSession).sparkContext.broadcast({"spec": read_spec(tokenizer_path)})
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches):
        coder = encoder(spec.value)
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            at, piece, start, length, crc, nth, ids = [], [], [], [], [], [], []
            for row, found in enumerate(coder.encoded(batch.column(1))):
                whole = found.tobytes() + end
                for n, begin in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[begin:begin + 4 * capacity]
                    at.append(row)
                    piece.append(n)
                    start.append(begin // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    nth.append(seen[len(part) // 4])
                    seen[len(part) // 4] += 1
                    if with_ids:
                        ids.append(part)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(at), pa.int32()),
                       pa.array(nth, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first: ``(length, first rank, first sequence, offset, per sequence)``, each up to the next of its length.

    Runs of sequences with the same room are treated as one, so the work follows the number of lengths, not of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: runs (first sequence, how many)
    places, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        for free in sorted(f for f in room if f >= length and room[f]):
            runs, each = room.pop(free), free // length
            while runs and left:
                first, many = runs.pop()
                full = min(many, left // each)
                if full:
                    places.append((length, rank, first, capacity - free, each))
                    room[free - each * length].append((first, full))
                    left, rank = left - full * each, rank + full * each
                if full < many and left:  # fewer are left than one sequence takes
                    places.append((length, rank, first + full, capacity - free, left))
                    room[free - left * length].append((first + full, 1))
                    full, left = full + 1, 0
                if full < many:
                    runs.append((first + full, many - full))
            room[free].extend(runs)
            if not left:
                break
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            places.append((length, rank, opened, 0, each))
            if full:
                room[capacity - each * length].append((opened, full))
            if rest:
                room[capacity - rest * length].append((opened + full, 1))
            opened += full + (rest > 0)
    return places


def bases(cut: DataFrame) -> DataFrame:
    """``part, length, n, base``: how many pieces of a length each task has, and how many the tasks before it have."""
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to written :func:`pieces` of ``length`` up to ``capacity``, in place of ``part, nth``.

    Every sequence is filled from 0 without gaps.
    """
    counted = stored(bases(cut), "bases")  # as its size is known, Spark chooses how to join it
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    table = np.array(sorted(plan(histogram, capacity)), "int64").reshape(-1, 5)
    shared = cut.sparkSession.sparkContext.broadcast(table)
    kept = cut.drop("part", "nth")
    with_rank = cut.join(counted.select("part", "length", "base"), ["part", "length"]).select(
        *kept.columns, (F.col("base") + F.col("nth")).alias("rank"))

    def find(batches):
        length, first_rank, first, offset, each = shared.value.T
        keys = (length << 48) + first_rank
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.asarray(batch.column("length"), "int64")
            rank = np.asarray(batch.column("rank"), "int64")
            at = np.searchsorted(keys, (own << 48) + rank, "right") - 1
            turn = rank - first_rank[at]
            columns = [batch.column(n) for n in names] + [
                pa.array(first[at] + turn // each[at]), pa.array(offset[at] + turn % each[at] * own)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    names = kept.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    return with_rank.mapInArrow(find, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (``ids``), ``sequence_id, offset`` of every piece of every row.

    Rows without an id or repeated are packed like others; an empty table gives no sequence; other columns are not read,
    whatever their names.
    """
    return placed(stored(pieces(docs, tokenizer_path, capacity, with_ids, id_col, text_col), "pieces"), capacity)
