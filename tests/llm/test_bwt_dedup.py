"""Repeated byte strings against brute force, on odd tables and through every way a window can take."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowtables.llm import bounded, bwt_dedup


def brute(rows):
    """``doc_id -> n_bytes, n_removed, n_spans, kept_sha256`` of rows with different ids."""
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            window = data[i:i + 50]
            if doc_id is not None and (window not in first or doc_id < first[window]):
                first[window] = doc_id
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if doc_id is not None and first[data[i:i + 50]] < doc_id:
                gone[i:i + 50] = True
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), int(gone.sum()), int(np.diff(gone.astype(int), prepend=0).clip(0).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, kind="long"):
    frame = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    for name in ("bytes", "mark", "spans", "p1", "low", "n"):
        frame = frame.withColumn(name, F.lit(1))
    return sorted((tuple(r) for r in bwt_dedup.repeated_bytes(frame).collect()), key=repr)


def table(seed, n=60):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("ab cé") for _ in range(rng.choice([49, 50, 51, 70, 200, 900]))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [rng.choice([rng.choice(passages), rng.choice(passages)[rng.randrange(20):], "".join(rng.choice("xyz ü") for _ in range(rng.randrange(80)))])
                 for _ in range(rng.randrange(5))]
        rows.append((k * 3, "".join(parts)))
    rows += [(1000, "a" * 2000), (1001, "b" + "a" * 300), (1002, "ab" * 400), (1003, "ab" * 60 + "c"), (1004, ""), (1005, None), (1006, "\x00" * 60 + "q"),
             (1007, "z\x00" + "\x00" * 60), (-5, rows[7][1]), (None, rows[7][1]), (None, "a" * 100)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = table(seed)
    assert found(spark, rows) == brute(rows)


def test_keys_with_many_segments_are_grouped_window_by_window(spark, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "KEY_SEGMENTS", 2)
    monkeypatch.setattr(bounded, "HOT_KEYS", 3)  # and their windows joined apart from the others
    rows = table(9)
    assert found(spark, rows) == brute(rows)


def test_a_crowded_key_costs_a_row_a_run_not_a_row_a_window(spark, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "KEY_SEGMENTS", 20)
    given = []
    monkeypatch.setattr(bwt_dedup, "joined", lambda many, *rest: given.append(many.count()) or bounded.joined(many, *rest))
    rng = random.Random(1)
    line = "".join(rng.choice("abcdefghij ") for _ in range(100))
    rows = [(k, f"{rng.random()}{rng.random()}{line}{rng.random()}{rng.random()}") for k in range(150)]
    assert found(spark, rows) == brute(rows)
    assert len(given) == 2  # both ways of a window were taken
    assert max(given) <= 150 * 51 / 5


def test_windows_of_one_piece_need_no_index(spark, monkeypatch):
    given = []
    monkeypatch.setattr(bwt_dedup, "merged", lambda shards, real=bwt_dedup.merged: given.append(shards.count()) or real(shards))
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("abcdefghij ") for _ in range(400))) for k in range(5)]
    rows += [(k + 100, text) for k, text in rows]
    assert found(spark, rows) == brute(rows)
    assert given == [0]


def test_keys_of_many_rows_are_found_across_buckets_and_batches(spark, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "HELD_KEYS", 5)
    rows = table(6)
    assert found(spark, rows) == brute(rows)


def test_texts_in_chunks_and_small_shards(spark, monkeypatch):
    for name, value in (("CHUNK", 300), ("PIECE", 7), ("RUN", 3), ("SHARD_BYTES", 500), ("PART_BYTES", 2000)):
        monkeypatch.setattr(bwt_dedup, name, value)
    rows = table(4)
    assert found(spark, rows) == brute(rows)


def test_ids_that_are_texts(spark):
    rows = [(f"é{k}" if k % 2 else f"z{k}", text) for k, (_, text) in enumerate(table(5)) if text is not None]
    assert found(spark, rows, "string") == brute(rows)


def test_rows_of_one_id_do_not_take_from_each_other(spark):
    text = "the same words again and again in this text of more than fifty bytes"
    rows = [(1, text), (1, text), (1, text + "!"), (2, text + "?")]
    assert [(r[0], r[2]) for r in found(spark, rows)] == [(1, 0), (1, 0), (1, 0), (2, len(text))]


def test_empty_table(spark):
    assert found(spark, [(1, "x")])[0][2] == 0
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert bwt_dedup.repeated_bytes(frame).collect() == []


def test_kept_bytes(spark):
    text = "0123456789" * 6
    frame = spark.createDataFrame([(1, text), (2, f"<{text}>")], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept) for r in bwt_dedup.repeated_bytes(frame, with_text=True).collect()}
    assert kept == {1: text.encode(), 2: b"<>"}


def test_transform_is_that_of_the_sorted_suffixes():
    rng = random.Random(3)
    strings = sorted({"".join(rng.choice("ab\x00") for _ in range(rng.randrange(50, 90))).encode() for _ in range(30)})
    before, begins = bwt_dedup.transform(pa.array(strings, pa.binary()))
    suffixes = sorted((s[i:], k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
    assert [r for r, (_, k, i) in enumerate(suffixes) if i == 0] == begins.tolist()
    assert [strings[k][i - 1] for _, k, i in suffixes if i] == [b for r, b in enumerate(before.tolist()) if r not in set(begins.tolist())]
