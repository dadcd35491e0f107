"""Alignment of two tokenizers against a walk over single tokens, whole and in many pieces."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowtables.llm import token_alignment
from flowtables.llm.backtrack_bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", None, "plain words in a row", "  two  spaces", "\nstart", "end ", "tab\tx", "a ▁ b", "<|endoftext|> x <s> </s>", "naïve café 日本語\n\n🙂",
    "a\nb\n c", "x y", "\r\n", " lead", "a", "nul\x00 x", "don't won't  \n", "١٢٣ ４５", "é   z", "line one\nline two\nline one", "-- ## \n--",
    "x" * 3000, "word " * 500 + "word"]


def walked(texts):
    tokenizer, pieces, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_letters()
    tokenizer.encode_special_tokens = True

    def piece(k):
        name = pieces.id_to_piece(k)
        return bytes([int(name[3:5], 16)]) if pieces.is_byte(k) else name.replace("▁", " ").encode()

    rows = []
    for text in texts:
        links, groups, a, b = [], [], [], []
        if text:
            a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
            a_bytes, b_bytes = [bytes(letters[c] for c in tokenizer.id_to_token(k)) for k in a], [piece(k) for k in b]
            if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a, b = [], []
        i = j = a_end = b_end = 0
        own, other = [], []
        while i < len(a) or j < len(b):
            if a_end == b_end:
                own, other = [a[i]], [b[j]]
                a_end, b_end = a_end + len(a_bytes[i]), b_end + len(b_bytes[j])
            elif a_end < b_end:
                i += 1
                own.append(a[i])
                a_end += len(a_bytes[i])
            else:
                j += 1
                other.append(b[j])
                b_end += len(b_bytes[j])
            links.append((a[i], b[j]))
            if a_end == b_end:
                groups.append(",".join(map(str, own)) + "|" + ",".join(map(str, other)))
                i, j = i + 1, j + 1
        rows.append((len(a), len(b), links, groups))
    count = Counter(pair for _, _, links, _ in rows for pair in set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    return [(k, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for k, (n_a, n_b, links, groups) in enumerate(rows)]


def found(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for name in ("row", "pairs", "times", "n_a", "pair"):
        frame = frame.withColumn(name, F.lit(1))
    return sorted(tuple(r) for r in token_alignment.alignments(frame, A, B).collect())


def test_equals_the_walk(spark):
    assert found(spark, TEXTS) == walked(TEXTS)


def test_rare_pairs_by_the_join_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "COMMON", 3)
    monkeypatch.setattr(token_alignment, "PIECE", 5)
    assert found(spark, TEXTS) == walked(TEXTS)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_pieces_are_independent_of_their_size(piece):
    rng = np.random.default_rng(piece)
    for _ in range(50):
        total = int(rng.integers(1, 60))
        a, b = (np.append(np.sort(rng.choice(np.arange(1, total), rng.integers(0, total), replace=False)), total) if total > 1 else np.array([1]) for _ in "ab")
        i, j, a_end, b_end = token_alignment.overlaps(a, b, piece)
        starts = [np.concatenate([[0], x[:-1]]) for x in (a, b)]
        want = [(x, y) for x in range(len(a)) for y in range(len(b)) if max(starts[0][x], starts[1][y]) < min(a[x], b[y])]
        assert list(zip(i.tolist(), j.tolist(), strict=True)) == want
        assert a[a_end - 1].tolist() == b[b_end - 1].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_pieces_have_equal_work():
    a, b = np.arange(1, 1001) * 3, np.arange(1, 3001)
    diagonals = np.arange(0, 4001, 100)
    places = token_alignment.path_places(a, b, diagonals)
    merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
    assert places.tolist() == [sum(side == 0 for _, side in merged[:d]) for d in diagonals.tolist()]


def test_empty_table_and_repeated_rows(spark):
    assert token_alignment.alignments(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    rows = token_alignment.alignments(spark.createDataFrame([(1, "same"), (1, "same"), (None, "same")], "doc_id long, text string"), A, B).collect()
    assert len({tuple(r)[1:] for r in rows}) == 1 and len(rows) == 3
