"""Words of whole texts as 64-bit hashes, for operators on word windows."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_BYTES = 40 << 20


class WordHashes:
    """Words are runs of other characters than ``[\\x20\\x09-\\x0D]``; each distinct word is hashed once."""

    def __init__(self):
        self.known: dict[bytes, bytes] = {}
        self.size = 0

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = set(words).difference(known)
        if new:
            if self.size > CACHE_BYTES:
                known = self.known = {}
                self.size, new = 0, set(words)
            for w in new:
                known[w] = xxhash.xxh3_64_digest(w)
            self.size += 180 * len(new) + sum(map(len, new))
        return np.frombuffer(b"".join([known[w] for w in words]), "<u8")


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads each value's bits over all of it (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, "uint64") * np.uint64(2) + np.uint64(1)


def window_hashes(hashes: np.ndarray, places: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of the ``width`` words from each place on."""
    out = np.zeros(len(places), "uint64")
    for k, factor in enumerate(odd_numbers(width, seed)):
        out += hashes[places + k] * factor
    return mixed(out)


class SpanHashes:
    """Two hashes of any span of a text's words, in constant time each: sums of word hashes times powers of an odd number."""

    def __init__(self, seed: int):
        self.bases = [int(x) & ~7 | 5 for x in odd_numbers(2, seed)]  # 5 modulo 8: the powers repeat as late as they can
        self.powers = [(np.ones(1, "uint64"), np.ones(1, "uint64"))] * 2

    def grow(self, n: int) -> None:
        if n > len(self.powers[0][0]):
            n = max(n, 1 << 12)
            self.powers = [tuple(
                np.concatenate([np.ones(1, "uint64"), np.cumprod(np.full(n - 1, x, "uint64"), dtype="uint64")])
                for x in (base, pow(base, -1, 1 << 64))) for base in self.bases]

    def of(self, hashes: np.ndarray):
        """A function of ``k`` (which hash), first words and ends (exclusive) of spans."""
        n = len(hashes)
        self.grow(n + 1)
        sums = []
        for k in (0, 1):
            sums.append(np.zeros(n + 1, "uint64"))
            np.cumsum(mixed(hashes + np.uint64(k)) * self.powers[k][0][:n], out=sums[k][1:])

        def over(k: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
            return mixed((sums[k][ends] - sums[k][begins]) * self.powers[k][1][begins] + (ends - begins).astype("uint64"))

        return over
