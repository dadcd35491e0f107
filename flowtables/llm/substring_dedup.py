"""Repeated passages by difference-cover anchors.

Windows of 20 words are hashed only at positions that fall on a difference cover modulo 31: of any two positions, some shift
under 31 takes both onto the cover. So two equal windows of 50 words, wherever they stand, hold an equal anchor at the same
place. First only the hashes are counted, once for each batch of documents, so an anchor of very many documents moves little.
Of the anchors themselves only those leave their task whose hash may be shared: a filter of fixed size says so, and a join
makes it exact. From them the match is extended to the 50-word windows around.

Neighbouring windows are compared as runs first. A run ends where a window's hash says so, so equal stretches of text fall
into equal runs. A run that a smaller document holds too is repeated as a whole, and what it holds also stands in that
document; so only the first document's windows of each run are compared one by one. Groups are aggregated, never paired.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.llm.stage import discard, small_batches, stored
from flowtables.llm.words import SpanHashes, WordHashes, window_hashes

WINDOW = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # every difference modulo 31 is one of two members
ANCHOR = WINDOW - PERIOD + 1
SEED = 90
FILTER_BITS = 25
RUN_BITS = 4  # a run holds 2 ** RUN_BITS windows on average
ROWS = 200_000  # about as many rows go out in a batch


def anchor_places(n: int) -> np.ndarray:
    """The cover's positions in a text of ``n`` words at which an anchor fits."""
    if n < WINDOW:
        return np.zeros(0, "int64")
    turns = np.arange(0, n, PERIOD)
    places = (turns[:, None] + np.array(COVER)).ravel()
    return places[places <= n - ANCHOR]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def summed(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _anchors_of(batch, hashes: WordHashes):
    """``hash, row, place`` arrays of all anchors of a batch of ``doc_id, text``."""
    found, rows, at = [np.zeros(0, "uint64")], [np.zeros(0, "int64")], [np.zeros(0, "int64")]
    for row, text in enumerate(batch.column(1).to_pylist()):
        words = words_of(text)
        places = anchor_places(len(words))
        if len(places):
            found.append(window_hashes(hashes(words), places, ANCHOR, SEED))
            rows.append(np.full(len(places), row))
            at.append(places)
    return np.concatenate(found), np.concatenate(rows), np.concatenate(at)


def shared_hashes(texts: DataFrame) -> DataFrame:
    """``hash`` of the anchors that occur in several documents (also of rows repeated with their id)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            found, rows, _ = _anchors_of(batch, hashes)
            order = np.lexsort((rows, found))
            found, rows = found[order], rows[order]
            first = np.ones(len(found), bool)
            first[1:] = found[1:] != found[:-1]
            several = np.zeros(len(found), bool)
            several[1:] = ~first[1:] & (rows[1:] != rows[:-1])
            begins = np.nonzero(first)[0]
            if len(begins):
                n = 1 + np.logical_or.reduceat(several, begins).astype("int8")
                yield pa.RecordBatch.from_arrays([pa.array(found[begins].view("int64")), pa.array(n)], ["hash", "n"])

    counted = texts.mapInArrow(run, "hash long, n byte").groupBy("hash").agg(F.sum("n").alias("n"))
    return counted.filter("n > 1").select("hash")


def filter_bits(shared: DataFrame) -> np.ndarray:
    """A bit for the first bits of every hash: at most ``2 ** FILTER_BITS`` bits come to the driver, whatever the table's size."""
    top = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    words = shared.select(F.shiftright(top, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 63 as int))").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), "int64")
    bits[rows["w"].to_numpy("int64")] = rows["b"].to_numpy("int64")
    return bits.view("uint64")


def anchors(texts: DataFrame, bits) -> DataFrame:
    """``hash, doc_id, place`` of every anchor whose hash the filter lets through."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            found, rows, at = _anchors_of(batch, hashes)
            top = found >> np.uint64(64 - FILTER_BITS)
            through = (bits.value[top >> np.uint64(6)] >> (top & np.uint64(63))) & np.uint64(1) == 1
            if through.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[through].view("int64")), batch.column(0).take(pa.array(rows[through])),
                     pa.array(at[through].astype("int32"))], ["hash", "doc_id", "place"])

    return texts.mapInArrow(run, f"hash long, doc_id {kind}, place int")


def _gathered(batches, of_row, names: list[str]):
    """Record batches of ``of_row``'s arrays for each row (or None) with the row's ``doc_id``, about ``ROWS`` rows each."""
    for batch in batches:
        parts, rows, size = [], [], 0
        for row, given in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, batch.num_columns)), strict=True)):
            found = of_row(*given)
            if found is not None and len(found[0]):
                parts.append(found)
                rows.append(np.full(len(found[0]), row))
                size += len(found[0])
            if size and (size > ROWS or row == batch.num_rows - 1):
                columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), *columns], names)
                parts, rows, size = [], [], 0
        if size:
            columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), *columns], names)


def runs(chosen: DataFrame) -> DataFrame:
    """``doc_id, r1, r2, start, length``: the windows that hold one of a document's shared anchors (``places``), in runs.

    A run is ``length`` windows from ``start`` on, hashed over all their words. It ends before a window whose hash has
    ``RUN_BITS`` zero bits, or where windows without such an anchor follow.
    """
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hashes, spans = WordHashes(), SpanHashes(SEED)

        def of_text(text, places):
            words = words_of(text)
            last = len(words) - WINDOW
            if last < 0:
                return None
            places = np.array(places, "int64")
            edge = np.zeros(len(words) + 2, "int64")
            np.add.at(edge, np.maximum(places - PERIOD + 1, 0), 1)
            np.add.at(edge, places + 1, -1)
            starts = np.nonzero(np.cumsum(edge)[:last + 1])[0]
            if not len(starts):
                return None
            own = spans.of(hashes(words))
            first = np.ones(len(starts), bool)
            first[1:] = (np.diff(starts) != 1) | (own(0, starts[1:], starts[1:] + WINDOW) & np.uint64((1 << RUN_BITS) - 1) == 0)
            begins = np.nonzero(first)[0]
            length = np.diff(np.append(begins, len(starts)))
            begin = starts[begins]
            one, two = (own(k, begin, begin + length - 1 + WINDOW).view("int64") for k in (0, 1))
            return one, two, begin.astype("int32"), length.astype("int32")

        yield from _gathered(batches, of_text, ["doc_id", "r1", "r2", "start", "length"])

    return chosen.select("doc_id", "text", "places").mapInArrow(run, f"doc_id {kind}, r1 long, r2 long, start int, length int")


def windows(chosen: DataFrame) -> DataFrame:
    """``doc_id, h1, h2, start`` of every window of the runs (``spans``: ``start, length``) of each text."""
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hashes, spans = WordHashes(), SpanHashes(SEED)

        def of_text(text, found):
            words = words_of(text)
            starts = np.concatenate([np.arange(s["start"], s["start"] + s["length"]) for s in found])
            starts = starts[starts <= len(words) - WINDOW]
            own = spans.of(hashes(words))
            one, two = (own(k, starts, starts + WINDOW).view("int64") for k in (0, 1))
            return one, two, starts.astype("int32")

        yield from _gathered(batches, of_text, ["doc_id", "h1", "h2", "start"])

    return chosen.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, start int")


def digests(texts: DataFrame) -> DataFrame:
    """``doc_id, n_words, whole_sha256`` of every row."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            split = [words_of(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in split], pa.int64()), pa.array([summed(w) for w in split], pa.string())],
                ["doc_id", "n_words", "whole_sha256"])

    return texts.mapInArrow(run, f"doc_id {kind}, n_words long, whole_sha256 string")


def cut(chosen: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, removed, cut_sha256`` (``kept_text``) of documents with the runs of their repeated windows (``spans``)."""
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            removed, digest, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = words_of(text)
                edge = np.zeros(len(words) + 1, "int64")
                begin = np.array([s["start"] for s in spans], "int64")
                end = begin + np.array([s["length"] for s in spans], "int64") - 1 + WINDOW
                inside = end <= len(words)
                np.add.at(edge, begin[inside], 1)
                np.add.at(edge, end[inside], -1)
                gone = np.cumsum(edge)[:len(words)] > 0
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(int(gone.sum()))
                digest.append(summed(left))
                kept.append(b" ".join(left).decode() if with_text else None)
            columns = [batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "removed", "cut_sha256", "kept_text"])

    return chosen.mapInArrow(run, f"doc_id {kind}, removed long, cut_sha256 string, kept_text string")


def repeated_passages(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256``; ``with_text`` adds ``kept_text`` of documents that lose words.

    A word goes if a window of 50 words over it also starts in a document with a smaller id. Null and empty texts have no words.
    A row without an id has no place in the order: it loses nothing and takes nothing. Rows repeated with their id are one
    document. Other columns are not read, whatever their names.
    """
    spark = small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = texts.filter("doc_id is not null")
    shared = stored(shared_hashes(known), "shared")
    found = anchors(known, spark.sparkContext.broadcast(filter_bits(shared)))
    places = found.join(shared, "hash", "left_semi").groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    chosen = stored(known.join(places, "doc_id"), "chosen")
    discard(shared)
    alike = stored(runs(chosen), "runs")
    low = alike.groupBy("r1", "r2").agg(F.min("doc_id").alias("low"))
    span = F.struct("start", "length")
    marked = stored(alike.join(low, ["r1", "r2"]).groupBy("doc_id", (F.col("low") < F.col("doc_id")).alias("later")).agg(
        F.collect_set(span).alias("spans")), "marked")
    discard(alike)
    own = marked.filter("not later").select("doc_id", "spans")
    seen = stored(windows(chosen.select("doc_id", "text").join(own, "doc_id")), "windows")
    first = seen.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    single = seen.join(first.select("h1", "h2", "low"), ["h1", "h2"]).filter("doc_id > low").groupBy("doc_id").agg(
        F.collect_set(F.struct("start", F.lit(1).alias("length"))).alias("spans"))
    repeated = marked.filter("later").select("doc_id", "spans").unionByName(single).groupBy("doc_id").agg(
        F.flatten(F.collect_list("spans")).alias("spans"))
    losses = stored(cut(chosen.select("doc_id", "text").join(repeated, "doc_id"), with_text).dropDuplicates(["doc_id"]), "losses")
    discard(chosen, marked, seen)
    out = digests(texts).join(losses, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("removed", F.lit(0)).alias("n_removed"),
        F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"), "kept_text")
    return out if with_text else out.drop("kept_text")


SQL = r"""
WITH w AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
g AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS h FROM p),
low AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM g JOIN low USING (h) WHERE doc_id > low),
lists AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, unnest(words) AS x, generate_subscripts(words, 1) AS k FROM w),
kept AS (SELECT each.doc_id, string_agg(x, ' ' ORDER BY k) AS t FROM each ANTI JOIN gone USING (doc_id, k) GROUP BY each.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN lists ON lists.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
