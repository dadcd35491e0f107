"""Token ids of whole texts by the tokenizers library, each distinct stretch without white space encoded once.

Usable with tokenizers whose rules never look across ASCII white space (they drop it or split at it) nor between an ASCII
letter or digit and marks after it (``MARKS``): then the ids of a text are those of its stretches in a row, and those of a
stretch are its word's and its marks'. New stretches are encoded in runs, as one text with ``BAR`` between them. Where the
tokenizer is known to lower a word of Latin letters (``WORD``) and to do no more with it, such words go straight to its merges.
"""

from __future__ import annotations

import json
import os
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_BYTES = 60 << 20  # of each of two tables
BATCH_BYTES = 2 << 20
MARKS = b".,;:!?%$*#"
BAR = "|"
RUN = 64  # stretches encoded as one text
WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")  # in UTF-8; none of the letters is changed by NFC
#: Rules under which a word of these letters is lowered and meets the merges whole.
_LOWERED = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})
_WHOLE = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed",
     "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def word_merges(spec: str):
    """The merges alone of a tokenizer with the rules above, for lowered words (``WORD``) with a space between them, and which ids
    end a word; None for any other tokenizer."""
    from tokenizers import Tokenizer, pre_tokenizers

    given = json.loads(spec)
    model, rules, split = given["model"], given["normalizer"] or {}, given["pre_tokenizer"] or {}
    rules, split = rules.get("normalizers", []), split.get("pretokenizers", [])
    suffix = model.get("end_of_word_suffix") or ""
    letters = [x + end for x in pre_tokenizers.ByteLevel.alphabet() for end in ("", suffix)]
    if (model.get("type") != "BPE" or model.get("dropout") or not suffix or any(x not in _LOWERED for x in rules)
            or {"type": "Lowercase"} not in rules or split != _WHOLE or any(x not in model["vocab"] for x in letters)
            or any(WORD.fullmatch(x["content"].encode()) for x in given["added_tokens"])):
        return None
    spaces = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
    plain = given | {"normalizer": None, "post_processor": None, "added_tokens": [], "truncation": None, "padding": None,
                     "pre_tokenizer": {"type": "Sequence", "pretokenizers": [spaces, _WHOLE[1]]}}
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[[k for token, k in model["vocab"].items() if token.endswith(suffix)]] = True
    return Tokenizer.from_str(json.dumps(plain)), ends


def encoder(held: dict) -> StretchEncoder:
    """The encoder for ``held["spec"]``, kept there: the value of a broadcast stays with a Python worker, so its next task finds
    the stretches that are known already."""
    if "encoder" not in held:
        held["encoder"] = StretchEncoder(held["spec"])
    return held["encoder"]


class StretchEncoder:
    """``spec`` is a tokenizer's JSON. Kept for a stretch: its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bar = self.tokenizer.encode(BAR, add_special_tokens=False).ids
        self.merges = word_merges(spec)
        self.known, self.before, self.size = {}, {}, 0

    def forms(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each of the parts."""
        joinable = [x for x in parts if BAR.encode() not in x] if len(self.bar) == 1 else []
        runs = [joinable[k:k + RUN] for k in range(0, len(joinable), RUN)]
        found = {}
        for run, ids in zip(runs, self.ids([f" {BAR} ".encode().join(run) for run in runs]), strict=True):
            bars, data = np.flatnonzero(ids == self.bar[0]), ids.tobytes()
            spans = zip([0, *(4 * bars + 4).tolist()], [*(4 * bars).tolist(), len(data)], strict=True)
            found.update(zip(run, [data[a:b] for a, b in spans], strict=True))
        alone = [x for x in parts if x not in found]
        found.update(zip(alone, [x.tobytes() for x in self.ids(alone)], strict=True))
        return found

    def words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of lowered words, by the merges alone."""
        tokenizer, last = self.merges
        runs = [b" ".join(words[k:k + 16 * RUN]).decode() for k in range(0, len(words), 16 * RUN)]
        found = [np.array(x.ids, "<u4") for x in tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, "<u4"), *found])
        ends = (4 * np.flatnonzero(last[ids]) + 4).tolist()
        data = ids.tobytes()
        return dict(zip(words, [data[a:b] for a, b in pairwise([0, *ends])], strict=True))

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in found]

    def learn(self, new: set[bytes]) -> None:
        """Encode stretches that are not known. What has not been met for a while is forgotten: of two tables the older one goes."""
        if self.size > CACHE_BYTES:
            self.known, self.before, self.size = {}, self.known, 0
        known, before = self.known, self.before
        if before:
            again = {x: before[x] for x in new if x in before}
            known.update(again)
            new = new.difference(again)
        whole, stems, tails = [], [], []
        for stretch in new:
            stem = stretch.rstrip(MARKS)
            if len(stem) < len(stretch) and stem[-1:].isalnum():  # an ASCII letter or digit before the marks
                whole.append(stretch)
                stems.append(stem)
                tails.append(stretch[len(stem):])
        plain = new.difference(whole)
        parts = plain.union(stems, tails)
        forms = {x: form for x in parts if (form := known.get(x) or before.get(x)) is not None}
        fresh = parts.difference(forms)
        if self.merges:
            words = [x for x in fresh if WORD.fullmatch(x)]
            lowered = [x.lower() if x.isascii() else x.decode().lower().encode() for x in words]
            found = self.words(list(set(lowered)))
            forms.update(zip(words, map(found.__getitem__, lowered), strict=True))
            others = list(fresh.difference(words))
        else:
            others = list(fresh)
        if others:
            forms.update(self.forms(others))
        known.update(forms)
        known.update(zip(whole, [forms[a] + forms[b] for a, b in zip(stems, tails, strict=True)], strict=True))
        self.size += sum(map(len, new)) * 2 + 150 * (len(new) + len(fresh))

    def encoded(self, texts: pa.Array):
        """An iterator over each text's ids in order; null is the empty text."""
        texts, first = pc.fill_null(texts, ""), 0
        for some in batches(pc.binary_length(texts).to_pylist(), int):
            split = pc.ascii_split_whitespace(texts.slice(first, len(some)))
            first += len(some)
            coded = split.flatten().dictionary_encode()
            stretches = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
            forms = list(map(self.known.get, stretches))
            if None in forms:
                self.learn({x for x, form in zip(stretches, forms, strict=True) if form is None})
                known = self.known
                forms = [known[x] if form is None else form for x, form in zip(stretches, forms, strict=True)]
            flat = np.frombuffer(b"".join(forms), "<u4")
            sizes = np.fromiter(map(len, forms), "int64", len(forms)) // 4
            starts = np.cumsum(sizes) - sizes
            turn = coded.indices.to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes[turn])])
            ids = flat[np.repeat(starts[turn] - ends[:-1], sizes[turn]) + np.arange(ends[-1])]
            bounds = ends[split.offsets.to_numpy()].tolist()
            for a, b in pairwise(bounds):
                yield ids[a:b]


def batches(texts: list, length=lambda text: len(text or "")):
    """The texts in runs of about ``BATCH_BYTES``."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += length(text)
        if size > BATCH_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def read_spec(path: str) -> str:
    """A tokenizer file's content, read by the driver and sent to the executors (a file of fixed size, about 2 MB)."""
    with open(path, encoding="utf-8") as file:
        return file.read()
