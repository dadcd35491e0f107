"""Language identification, word first: known words by their frequency in each language, unseen ones by character n-grams.

The model is fitted on a bounded sample of labelled texts; every text is then scored whole. A word that the model knows
adds its log frequency in each language. One that it does not know falls back to its character n-grams: the longest length
of which any n-gram is known counts, then the next shorter one.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtables.llm.stage import small_batches
from flowtables.llm.tokens import batches

#: Bounds of the model: labelled texts a language in the sample (as expected by hashing), and entries over all languages.
SAMPLE_PER_LANGUAGE = 4000
MODEL_WORDS = 100_000
MODEL_GRAMS = 100_000
LONGEST_GRAM = 5
SMOOTH = 0.1
UNKNOWN = "und"
CACHE_BYTES = 40 << 20
WORD = r"\p{L}+"


def sampled(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """``lang, text``: about ``per_language`` different texts of each language, chosen by the hash of the text."""
    known = labelled.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    texts = known.select("lang", "h").distinct()  # copies count once: they are one text in the sample
    counts = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language, as the model has
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], per_language / r["n"])])[F.col("lang")] if counts else F.lit(0.0)
    chosen = known.filter(F.shiftrightunsigned("h", 1).cast("double") / F.lit(float(2**63)) < share)
    return chosen.dropDuplicates(["lang", "h"]).select("lang", "text")


def fitted(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> dict:
    """The model: ``langs``, and for words and n-grams the row of each in a table of log frequencies by language."""
    words = sampled(labelled, per_language).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("w"))
    counts = words.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    top = _commonest(counts, MODEL_WORDS)  # the size of the model, not of the data
    padded = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    grams = counts.select("lang", "n", padded.alias("p")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(LONGEST_GRAM))))
    grams = grams.filter(F.length("p") >= F.col("k")).select("lang", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("p") - F.col("k") + 1), lambda i: F.substring(F.col("p"), i, F.col("k")))).alias("w"))
    grams = _commonest(grams.groupBy("lang", "w").agg(F.sum("n").alias("n")), MODEL_GRAMS)
    langs = sorted(r["lang"] for r in labelled.filter("lang is not null").select("lang").distinct().collect())
    return {"langs": langs, "words": _table(top, langs, False), "grams": _table(grams, langs, True)}


def _commonest(counts: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` entries: of each language equally many, its commonest; what one does not need goes to the others."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    ranked = counts.filter("n > 1").withColumn("place", place).filter(F.col("place") <= limit)
    return ranked.orderBy("place", "lang").limit(limit).select("lang", "w", "n")


def _table(counts: DataFrame, langs: list[str], by_length: bool) -> tuple[dict[str, int], np.ndarray]:
    column, rows = {x: k for k, x in enumerate(langs)}, {}
    found = counts.toPandas()
    for w in found["w"]:
        rows.setdefault(w, len(rows))
    table = np.full((len(rows), len(langs)), SMOOTH)
    for lang, w, n in zip(found["lang"], found["w"], found["n"], strict=True):
        table[rows[w], column[lang]] += n
    kinds = np.array([len(w) if by_length else 0 for w in rows], dtype=int)
    for kind in set(kinds.tolist()):  # frequencies among the words, or among the n-grams of one length
        table[kinds == kind] /= table[kinds == kind].sum(axis=0, keepdims=True)
    return rows, np.log(table)


class Scorer:
    """Log scores of stretches without white space, each distinct one worked out once."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        (self.words, self.word_logs), (self.grams, self.gram_logs) = model["words"], model["grams"]
        self.letters = re.compile(r"[^\W\d_]+")
        self.clear()

    def clear(self):
        self.row: dict[bytes, int] = {}
        self.table, self.used, self.size = np.zeros((1 << 12, len(self.langs) + 1)), 0, 0

    def word(self, word: str) -> np.ndarray:
        at = self.words.get(word)
        if at is not None:
            return self.word_logs[at]
        padded = f"^{word}$"
        for n in range(LONGEST_GRAM, 0, -1):
            known = [k for k in (self.grams.get(padded[i:i + n]) for i in range(len(padded) - n + 1)) if k is not None]
            if known:
                return self.gram_logs[known].mean(axis=0)
        return np.zeros(len(self.langs))

    def learn(self, stretches: set[bytes]) -> None:
        for stretch in stretches:
            words = self.letters.findall(stretch.decode().lower())
            if self.used == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for w in words:
                self.table[self.used, :-1] += self.word(w)
            self.table[self.used, -1] = len(words)
            self.row[stretch] = self.used
            self.used += 1
            self.size += 150 + 2 * len(stretch) + 8 * len(self.langs)

    def totals(self, texts: list[str | None]):
        """The log score of each text in each language, and last its number of words."""
        for some in batches(texts):
            split = [(x or "").encode().split() for x in some]
            new = set().union(*split).difference(self.row)
            if new and self.size > CACHE_BYTES:
                self.clear()
                new = set().union(*split)
            self.learn(new)
            row = self.row
            for stretches in split:
                yield self.table[[row[x] for x in stretches]].sum(axis=0) if stretches else np.zeros(len(self.langs) + 1)

    def scores(self, texts: list[str | None]):
        """``(language, score)`` of each text."""
        for total in self.totals(texts):
            if not total[-1] or not self.langs:
                yield UNKNOWN, 0.0
            else:
                best = int(total[:-1].argmax())
                yield self.langs[best], 1.0 / float(np.exp(np.maximum(total[:-1] - total[best], -math.log(1e300))).sum())


def predicted(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row: the likeliest language and its share of the likelihood (0 to 1).

    A text that is null, empty or without letters is ``und`` with score 0; a tie goes to the language that comes first.
    Without labelled texts all are ``und``. Rows without an id or repeated are scored like others; other columns are not read,
    whatever their names.
    """
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(model)  # bounded by MODEL_WORDS and MODEL_GRAMS
    kind = docs.schema[id_col].dataType.simpleString()

    def run(incoming):
        scorer = Scorer(shared.value)
        for batch in incoming:
            if batch.num_rows:
                lang, score = zip(*scorer.scores(batch.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """``documents`` without texts in no language: null, or without letters, whatever the model knows. All columns stay.

    A null ``lang`` becomes the language predicted for the text, where the model has learned any; a given one is not changed.
    """
    model = fitted(docs.filter(~held_out()).select("text", "lang"))
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(model)
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(incoming):
        scorer = Scorer(shared.value)
        for batch in incoming:
            totals = list(scorer.totals(batch.column(text_at).to_pylist()))
            given = batch.column(lang_at).to_pylist()
            lettered = [bool(total[-1]) for total in totals]
            lang = [scorer.langs[int(total[:-1].argmax())] if own is None and found and scorer.langs else own
                    for total, own, found in zip(totals, given, lettered, strict=True)]
            columns = [pa.array(lang, pa.string()) if k == lang_at else column for k, column in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(lettered, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
