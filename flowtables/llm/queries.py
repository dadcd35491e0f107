"""The registered queries of the training-data operators, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowtables.llm import (
    backtrack_bpe,
    bestfit_packing,
    bwt_dedup,
    chunk_dedup,
    collocations,
    language_id,
    minhash_dedup,
    preference_chat,
    secret_scan,
    substring_dedup,
    token_alignment,
    training_order,
    vector_dedup,
)

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents"), training_order.new_root(spark), WORD_BPE, seed=20)


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fitted(docs.filter(~language_id.held_out()).select("text", "lang"))
    return language_id.predicted(docs, model).withColumn("held_out", language_id.held_out())


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtrack_bpe.round_trips(table(spark, sf_dir, "documents"), BYTE_BPE)


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.empty_ledger(spark)))


def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_groups(table(spark, sf_dir, "documents"))


def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def token_alignment_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignments(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference_chat.answer_swaps(preference_chat.conversations_of(table(spark, sf_dir, "conversations")))
    return preference_chat.digest(preference_chat.format_pairs(pairs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_training_order": token_shards,
    "op2_language_id": language,
    "op3_best_fit_packing": best_fit_packing,
    "op4_bpe_round_trip": bpe_round_trip,
    "op5_minhash_dedup": near_dedup,
    "op6_secret_scan": secret_spans,
    "op7_embedding_dedup": embedding_dedup,
    "op8_exact_dedup": exact_dedup,
    "op9_preference_format": preference_format,
    "op10_substring_dedup": passage_dedup,
    "op11_token_alignment": token_alignment_of,
    "op12_suffix_array_dedup": byte_dedup,
    "op13_phrase_mining": phrase_mining,
}
ORACLES: dict[str, str] = {
    "op5_minhash_dedup": minhash_dedup.SQL,
    "op6_secret_scan": secret_scan.SQL,
    "op7_embedding_dedup": vector_dedup.SQL,
    "op8_exact_dedup": chunk_dedup.SQL,
    "op9_preference_format": preference_chat.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
    "op12_suffix_array_dedup": bwt_dedup.SQL,
    "op13_phrase_mining": collocations.SQL,
}
