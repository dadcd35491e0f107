"""Ids that 16 bits do not hold are refused, not wrapped."""

import json

import public_tokenizers
import pytest

from flowtables.llm import training_order


def test_large_ids_are_refused_and_the_end_id_is_a_parameter(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat")], "doc_id long, text string")
    wide = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None,
            "decoder": None, "pre_tokenizer": {"type": "Whitespace"},
            "model": {"type": "WordLevel", "vocab": {"[UNK]": 0, "the": 1, "cat": 65536}, "unk_token": "[UNK]"}}
    (tmp_path / "wide.json").write_text(json.dumps(wide))
    with pytest.raises(ValueError, match="65536"):
        training_order.token_table(docs, str(tmp_path / "wide.json"))
    narrow = public_tokenizers.path("word_bpe_49k.json")
    with pytest.raises(ValueError, match="end id"):
        training_order.token_table(docs, narrow, 1 << 16)
    assert training_order.token_table(docs, narrow, 7).first()["ids"][-2:] == b"\x07\x00"
