"""Stretches encoded by the merges alone, and kept from task to task."""

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkContext
from tokenizers import Tokenizer

from flowtables.llm import tokens, training_order

SPEC = tokens.read_spec(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = [
    "Plain words, UPPER lower MiXed. don't we'll l's 's ''s", "Straße ÀÉÎõü ÿ Þórr × ÷ a×b a÷b œuvre ŒUVRE Ā İI ı K Å", "été É é. à",
    "<|startoftext|> <|STARTOFTEXT|> x<|endoftext|>y", "a1b2 4d5e &&& abc&&& (476) 38.101.105.188 | a|b |  x ", "", None, "ΑΣ Σας 中文 한국어 🙂ok",
    "thheeror Thheeror THHEEROR, thheeror. thheeror!? thheeror%$*#"]


def test_ids_are_the_tokenizers_own():
    own = Tokenizer.from_str(SPEC)
    coder = tokens.StretchEncoder(SPEC)
    assert coder.merges is not None
    for _ in range(2):
        for text, ids in zip(TEXTS, coder.encoded(pa.array(TEXTS)), strict=True):
            assert np.array_equal(ids, own.encode(text or "", add_special_tokens=False).ids), text
        coder.size = tokens.CACHE_BYTES + 1  # the older table goes, its stretches are met again


def test_every_latin_letter():
    own = Tokenizer.from_str(SPEC)
    letters = [chr(k) for k in range(1, 0x180) if chr(k).isalpha()]
    words = [x + y for x in letters for y in ("", "a", "Z", "é", "'s", ",")]
    for word, ids in zip(words, tokens.StretchEncoder(SPEC).encoded(pa.array(words)), strict=True):
        assert np.array_equal(ids, own.encode(word, add_special_tokens=False).ids), word


def test_other_rules_do_not_take_the_short_way():
    for change in ({"normalizer": None}, {"pre_tokenizer": None}):
        assert tokens.word_merges(json.dumps(json.loads(SPEC) | change)) is None
    assert tokens.word_merges(tokens.read_spec(public_tokenizers.path("byte_bpe_50k.json"))) is None


def test_an_encoder_is_kept_beside_its_tokenizer():
    held = {"spec": SPEC}
    list(tokens.encoder(held).encoded(pa.array(["some words"])))
    assert tokens.encoder(held).known.keys() == {b"some", b"words"}


def test_training_order_sends_a_place_for_its_encoder(spark, monkeypatch):
    sent, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    docs = spark.createDataFrame([(k, text) for k, text in enumerate(TEXTS)], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    found = {r.doc_id: np.frombuffer(r.ids, "<u2") for r in training_order.token_table(docs, path).collect()}
    own = Tokenizer.from_str(SPEC)
    for k, text in enumerate(TEXTS):
        assert found[k].tolist() == [*own.encode(text or "", add_special_tokens=False).ids, training_order.END_ID]
    assert sent == [{"spec": SPEC}]
