"""Exact deduplication by content-defined chunk recipes (native: DataFrame functions only).

A normalised text is cut where its own letters say so, so equal passages give equal chunks wherever they stand. A chunk's
identifier is a 64-bit hash that a dictionary of all chunks has verified: where one hash stands for two different SHA-256
digests, the documents holding it get identifiers made from the digests instead. Documents are equal when their ordered
identifier lists are; only the lists (about a hundredth of the text) are grouped, so no long text is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtables.llm.stage import free_name, stored

SPACE = r"[\x20\x09-\x0D]+"
#: A chunk ends after 512 characters or more where a word with one of these ends meets a word with one of these starts;
#: a stretch of 4096 characters without such a place is cut there.
CHUNK = r"(?s).{512,4096}?[aehnrs] (?=[a-m])|.{1,4096}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, text_sha256, chunks`` (array of ``id`` and ``digest`` in order) of every row."""
    norm = docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), normalised(F.col(text_col)).alias("norm"))
    return norm.select(
        "doc_id", "row", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.transform(
            F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)),
            lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("digest")),
        ).alias("chunks"))


def unverified(chunked: DataFrame) -> DataFrame:
    """Rows that hold a chunk whose hash also stands for another chunk."""
    pieces = chunked.select("row", F.explode("chunks").alias("c")).select("row", "c.id", "c.digest")
    doubtful = (
        pieces.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
        .filter("low <> high").select("id"))
    return pieces.join(doubtful, "id", "left_semi").select("row").distinct().withColumn("wide", F.lit(True))


def verified_lists(chunked: DataFrame) -> DataFrame:
    """``doc_id, row, text_sha256, ids``: the ordered list of verified identifiers of every row."""
    wide = F.transform("chunks", lambda c: F.xxhash64(c["id"], c["digest"]))
    return chunked.join(unverified(chunked), "row", "left").select(
        "doc_id", "row", "text_sha256", F.when(F.col("wide"), wide).otherwise(F.col("chunks.id")).alias("ids"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of white space is made one space. Null counts as the empty text, and all
    empty texts are equal. Of equal rows one is kept: the smallest id; rows without an id come last; of rows repeated with
    their id one is kept. Other columns are not read, whatever their names.
    """
    lists = stored(verified_lists(stored(recipes(docs, id_col, text_col), "recipes")), "lists")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = lists.groupBy("ids").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(
        F.col("ids").alias("list"), F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size")
    return lists.join(groups, F.col("ids") == F.col("list")).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``documents`` without the rows whose text an earlier row has; all columns stay.

    The kept row of a text is found again by its id and its text, as ids may be missing or repeated.
    """
    digest = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    own, kept_id, kept_digest = (free_name(docs, name) for name in ("own_sha256", "kept_id", "kept_sha256"))
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_digest))
    held = docs.withColumn(own, digest)
    held = held.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_digest)), "left_semi")
    return held.dropDuplicates(["doc_id", own]).drop(own)


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
