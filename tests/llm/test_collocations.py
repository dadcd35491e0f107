"""Collocations against counting everything, with samples that miss phrases, and on odd tables."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flowtables.llm import collocations

TEXTS = [
    ("en", "New York, new york. New York City is in New York State; a big city"), ("en", "the new york city marathon\nthe new york city marathon"),
    (None, "alpha beta gamma alpha beta gamma alpha beta"), ("de", "Ärger ärger ärger\x0bärger ärger Ärger"), ("de", None), ("fr", ""),
    ("en", "a a a a a a a a"), ("en", "new york\tcity  marathon"), ("und", "alpha beta gamma delta"), ("xx", "one time only")]


def brute(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = tuple(w for w in re.split(r"[\x20\x09]+", piece) if w)
            n[lang] += len(words)
            for m in range(1, 6):
                f[lang].update(words[i:i + m] for i in range(len(words) - m + 1))
    out = []
    for lang in f:
        count = f[lang]
        candidates = [p for p, a in count.items() if len(p) > 1 and a >= least]

        def inside(p, q):
            return len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))

        rows = []
        for p in candidates:
            if any(inside(p, q) and 100 * count[q] >= 100 * count[p] for q in candidates):
                continue
            score, k = min((1000 * count[p] * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -count[p], " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(spark, rows, least, top):
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for name in ("hash", "phrase", "n", "words", "f"):
        frame = frame.withColumn(name, F.lit("x"))
    return sorted(tuple(r) for r in collocations.collocations(frame, least, top).collect())


@pytest.mark.parametrize("sample", [0.0, 0.5, 1.0])
def test_equals_counting_everything_whatever_the_sample_holds(spark, monkeypatch, sample):
    monkeypatch.setattr(collocations, "SAMPLE", sample)
    monkeypatch.setattr(collocations, "SAMPLE_COUNT", 1)
    rows = TEXTS * 2
    assert found(spark, rows, 2, 2000) == brute(rows, 2, 2000)
    assert found(spark, rows, 3, 2) == brute(rows, 3, 2)


def test_an_empty_sample_needs_a_pass_for_each_length(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SAMPLE", 0.0)
    texts = spark.createDataFrame(TEXTS * 2, "lang string, text string").select(
        F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    passes, _ = collocations.frequent(texts, 2)
    assert len(passes) == 6  # words, then phrases of two to five words, then one that shows nothing is left
    assert [p.count() > 0 for p in passes] == [True] * 5 + [False]


def test_counts_handed_on_early_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 5)
    monkeypatch.setattr(collocations, "CHUNK", 30)
    rows = TEXTS + [("en", "new york city, " * 40)]
    assert found(spark, rows, 2, 2000) == brute(rows, 2, 2000)


def test_empty_table_and_nothing_frequent(spark):
    assert found(spark, TEXTS, 1000, 10) == []
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_large_products_are_exact(spark):
    big = 3 * 10**12
    counts = spark.createDataFrame([("en", "", 0, 9 * 10**12), ("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 7)],
                                   "lang string, phrase string, words int, f long")
    assert collocations.scored(counts).first().score == 1000 * big * 9 * 10**12 // ((big + 1) * (big + 7))
