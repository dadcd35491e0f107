"""Pipeline stages on tables with clashing columns, repeated and missing ids; the ledger's method."""

import pytest
from pyspark.sql import functions as F

from flowtables.llm import chunk_dedup, language_id, minhash_dedup, secret_scan

CLASHES = "spans _lettered _kept_id kept_id kept_sha256 own_sha256 dropped_id row gone sha at_id at_sha _cut _t"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"


@pytest.fixture
def docs(spark):
    texts = [
        (1, f"{LONG} end", "en"), (5, f"{LONG} end now", "en"), (5, "another text of the same id, secret = abcdefgh", None), (6, "lone text", "en"),
        (None, f"{LONG} end", "en"), (None, "no id here", "en"), (7, None, "en"), (8, "123 456", "en"), (6, "lone text", "en")]
    frame = spark.createDataFrame(texts, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    for name in CLASHES.split():
        frame = frame.withColumn(name, F.lit(name))
    return frame


def rows(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=repr)


def test_language_stage_fills_missing_languages(docs):
    out = language_id.drop_unidentified(docs)
    assert out.columns == docs.columns
    assert {r.text for r in out.collect()} == {r.text for r in docs.filter("text rlike '[a-z]'").collect()}
    assert {r.lang for r in out.collect()} == {"en"}


def test_exact_stage_with_clashing_columns(docs):
    out = chunk_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert rows(out) == sorted([
        (1, f"{LONG} end"), (5, f"{LONG} end now"), (5, "another text of the same id, secret = abcdefgh"), (6, "lone text"), (None, "no id here"),
        (7, None), (8, "123 456")], key=repr)


def test_near_stage_decides_by_row(docs):
    out = minhash_dedup.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert rows(out) == sorted([
        (1, f"{LONG} end"), (5, "another text of the same id, secret = abcdefgh"), (6, "lone text"), (None, "no id here"), (7, None), (8, "123 456")],
        key=repr)


def test_redaction_with_clashing_columns(spark, docs):
    out = secret_scan.redact(docs, secret_scan.empty_ledger(spark))
    assert out.columns == docs.columns
    assert out.count() == docs.count()
    assert [r.text for r in out.filter("text like '%SECRET%'").collect()] == ["another text of the same id, [SECRET]"]


@pytest.mark.parametrize("stage", [language_id.drop_unidentified, chunk_dedup.drop_copies, minhash_dedup.drop_near_copies])
def test_stages_on_an_empty_table(docs, stage):
    out = stage(docs.filter("false"))
    assert (out.count(), out.columns) == (0, docs.columns)


def test_patterns_stay_above_the_ledger(spark, docs):
    texts = docs.select("doc_id", F.col("text"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    unseen = texts.select(F.col("sha").alias("at_sha")).distinct()
    found = secret_scan.spans_of(texts.join(unseen, F.col("sha") == F.col("at_sha"), "left_semi").select("sha", "text"))
    plan = found._jdf.queryExecution().optimizedPlan()
    semi = []

    def walk(node):
        if node.nodeName() == "Join" and "LeftSemi" in node.simpleString(100):
            semi.append(node.toString())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    assert semi and not any("RLIKE" in text or "regexp" in text for text in semi)


def test_second_run_scans_nothing_new(spark, docs):
    ledger = secret_scan.empty_ledger(spark)
    first = {(r.doc_id, r.sha, str(r.spans)) for r in secret_scan.scan(docs, ledger).collect()}
    held = spark.read.parquet(ledger).count()
    again = secret_scan.scan(docs.unionByName(docs.limit(1).withColumn("text", F.lit("token: 123456789"))), ledger)
    assert first <= {(r.doc_id, r.sha, str(r.spans)) for r in again.collect()}
    assert spark.read.parquet(ledger).count() == held + 1
