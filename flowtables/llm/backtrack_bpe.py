"""Byte-level BPE by backtracking: exact merges in linear time, and decoding by an offset table.

An Aho-Corasick automaton over the reversed vocabulary gives the longest token from every place of a word. The encoder
takes the longest token that may stand beside the one before it; a table of merges tells which pairs may, by undoing merges
across the seam. Where no shorter token fits, it steps back and never tries that place again. So each place is settled once.
Words are encoded once a task and looked up afterwards.
"""

from __future__ import annotations

import hashlib
import json
import re
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowtables.llm.stage import small_batches
from flowtables.llm.tokens import batches, read_spec

CACHE_BYTES = 100 << 20
#: The pattern of byte-level pre-tokenising, with white space as Unicode defines it.
WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A space between two characters that are none (for Python some control characters are white space too; they only make fewer seams).
SEAM = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable ones stand for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tables of a byte-level BPE tokenizer file: token bytes, merges, and what the encoder needs of them."""

    def __init__(self, spec: str):
        import ahocorasick

        spec = json.loads(spec)
        letters = byte_letters()
        model = spec["model"]
        ids = {bytes(letters[c] for c in token): k for token, k in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [(ids[bytes(letters[c] for c in a)], ids[bytes(letters[c] for c in b)]) for a, b in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for token, k in ids.items():
            self.token[k] = token
        for content, k in self.special.items():
            self.token[k] = content.encode()
        # Rank: the order of merges. A token made by no merge is a byte and precedes all.
        self.rank, self.parts = [-1] * size, [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            whole = ids[self.token[a] + self.token[b]]
            if self.parts[whole] is None:
                self.rank[whole], self.parts[whole] = rank, (a, b)
                self.merged[a, b] = whole
        usable = {t: k for t, k in ids.items() if self.parts[k] is not None or len(t) == 1}
        self.shorter: list[int | None] = [None] * size  # the longest usable token that begins a token
        for token, k in usable.items():
            self.shorter[k] = next((usable[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in usable), None)
        self.automaton = ahocorasick.Automaton()
        for token, k in usable.items():
            self.automaton.add_word(token[::-1].decode("latin-1"), k)
        self.automaton.make_automaton()
        self.lengths = np.array([len(t) for t in self.token], "int64")
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.length = self.lengths.tolist()
        self.bytes = np.frombuffer(b"".join(self.token), "uint8")
        self.fits: dict[tuple[int, int], bool] = {}

    def longest(self, word: bytes) -> list[int]:
        """The longest token from each place of ``word``."""
        found: list[int] = [-1] * len(word)
        last = len(word) - 1
        for end, k in self.automaton.iter(word[::-1].decode("latin-1")):
            if found[last - end] < 0:  # of the tokens at a place the automaton gives the longest first
                found[last - end] = k
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves the seam between them: no merge across it comes before those that made them."""
        if len(self.fits) > 500_000:
            self.fits.clear()
        known = self.fits[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        rank, parts, merged = self.rank, self.parts, self.merged
        bound = len(rank)  # of a merge across the seam: those of this rank or more came too late
        a, b = left, right
        while True:
            across = merged.get((a, b))
            if across is not None and rank[across] < bound:
                return False
            # Undo the later of the two merges; the right one of equal tokens, as merging goes from the left.
            if rank[a] > rank[b]:
                bound, a = rank[a], parts[a][1]
            elif parts[b] is not None:
                bound, b = rank[b] + 1, parts[b][0]
            else:
                return True

    def encode_word(self, word: bytes) -> list[int]:
        longest = self.longest(word)
        if len(word) == self.length[longest[0]]:  # the word is a token
            return [longest[0]]
        length, shorter, fits = self.length, self.shorter, self.fits
        open_at = bytearray(b"\1") * (len(word) + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < len(word):
            before = tokens[-1] if tokens else None
            while token is not None:
                end = at + length[token]
                if open_at[end]:
                    fit = before is None or fits.get((before, token))
                    if fit or fit is None and self.compatible(before, token):
                        break
                token = shorter[token]
            if token is not None:
                tokens.append(token)
                at = end
                token = longest[at] if at < len(word) else None
            else:
                open_at[at] = 0
                at -= length[tokens.pop()]
                token = shorter[before]
        return tokens

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens in a row, taken from one table by offset."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.bytes[at].tobytes()


def packed(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Whole texts to ids (bytes of little-endian unsigned 32-bit ids)."""

    def __init__(self, spec: str):
        import regex

        self.vocabulary = Vocabulary(spec)
        self.words = regex.compile(WORDS)
        special = "|".join(regex.escape(x) for x in sorted(self.vocabulary.special, key=len, reverse=True))
        self.special = regex.compile(f"({special})") if special else None
        self.pieces: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}  # of a line, its first stretch
        self.spaced: dict[str, bytes] = {}  # one that a single space precedes, without it
        self.size = 0
        self.newline = self.exact("\n")

    def piece(self, word: str) -> bytes:
        ids = self.pieces.get(word)
        if ids is None:
            ids = packed(self.vocabulary.encode_word(word.encode()))
            if len(word) < 64:
                self.pieces[word] = ids
                self.size += 150 + 2 * len(word) + len(ids)
        return ids

    def exact(self, text: str) -> bytes:
        """Any text: special tokens first, then words by the pattern."""
        if self.special is None or not self.special.search(text):
            return b"".join(map(self.piece, self.words.findall(text)))
        out = []
        for part in self.special.split(text):
            k = self.vocabulary.special.get(part)
            out.append(packed([k]) if k is not None else b"".join(map(self.piece, self.words.findall(part))))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Encodes apart what single spaces or line ends between other characters part: no word reaches over such a seam."""
        if self.size > CACHE_BYTES:
            self.pieces, self.stretches, self.spaced, self.size = {}, {}, {}, 0
        if not text:
            return b""
        out: list[bytes] = []
        lines, begin = text.split("\n"), 0
        for k in range(1, len(lines) + 1):
            if k < len(lines) and not (lines[k - 1] and lines[k] and not lines[k - 1][-1].isspace() and not lines[k][0].isspace()):
                continue  # no seam here: the lines stay together
            if begin:
                out.append(self.newline)
            self.line(lines[begin] if k == begin + 1 else "\n".join(lines[begin:k]), out)
            begin = k
        return b"".join(out)

    def line(self, line: str, out: list[bytes]) -> None:
        parts = line.split(" ")
        if parts != line.split():
            parts = SEAM.split(line)
        spaced, first = self.spaced, self.stretches.get(parts[0])
        out.append(self.learn(self.stretches, "", parts[0]) if first is None else first)
        found = [spaced.get(part) for part in parts[1:]]
        if None in found:
            found = [self.learn(spaced, " ", part) if ids is None else ids for part, ids in zip(parts[1:], found, strict=True)]
        out += found

    def learn(self, known: dict[str, bytes], before: str, stretch: str) -> bytes:
        """Encodes a stretch that is not known."""
        ids = self.exact(before + stretch)
        if len(stretch) < 64:
            known[stretch] = ids
            self.size += 150 + 2 * len(stretch) + len(ids)
        return ids


def round_trips(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row; ``with_ids`` adds ``ids`` and ``decoded``.

    A null text is empty: no ids, empty decoded text. Rows without an id or repeated are encoded like others; other columns
    are not read, whatever their names.
    """
    spec = small_batches(docs.sparkSession).sparkContext.broadcast(read_spec(tokenizer_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(incoming):
        coder = Encoder(spec.value)
        for batch in incoming:
            if not batch.num_rows:
                continue
            n, before, after, ids, texts = [], [], [], [], []
            for some in batches(batch.column(1).to_pylist()):
                for text in some:
                    found = coder.encode(text or "")
                    decoded = coder.vocabulary.decode(np.frombuffer(found, "<u4")).decode("utf-8", "replace")
                    n.append(len(found) // 4)
                    before.append(hashlib.sha256(found).hexdigest())
                    after.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        ids.append(found)
                        texts.append(decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(before), pa.array(after)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary()), pa.array(texts, pa.string())], [*names, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)
