"""A training corpus from documents, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowtables.llm import bestfit_packing, chunk_dedup, language_id, minhash_dedup, secret_scan
from flowtables.llm.stage import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language: null, or without letters."""
    return language_id.drop_unidentified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but one of each group of equal texts."""
    return chunk_dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but one of each group of near copies."""
    return minhash_dedup.drop_near_copies(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; no document goes."""
    return secret_scan.redact(docs, secret_scan.empty_ledger(spark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; a row for each piece, with its ids."""
    return bestfit_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language ID", language), ("exact dedup", exact_dedup), ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_redaction), ("best-fit packing", packing),
]
#: No SQL: learned language scores and signatures are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else stored(docs, name.replace(" ", "-"))
    return docs
