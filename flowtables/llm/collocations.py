"""Phrases whose words keep together, by Toivonen's sampling: a sample proposes, full passes count.

A phrase can only be frequent if both phrases that lack its first or its last word are. So a full pass counts every phrase whose two
parts are proposed: the proposals themselves and their negative border, all words in it. If the sample missed nothing, the frequent
phrases counted are all there are. Where a border phrase turns out frequent, it joins the proposals, and a further pass counts what
that lets in, until a pass shows no such failure.

Counting passes move 64-bit hashes; phrases of one hash are counted together, so a count is never too small. A last pass counts the
texts of the phrases found frequent, which makes all counts exact. Proposals are held as bits of a filter of fixed size: what it
lets through too much is counted too and changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtables.llm.bounded import bit_filter, joined, passing
from flowtables.llm.stage import discard, small_batches, stored
from flowtables.llm.words import mixed, odd_numbers

MOST_WORDS = 5
LEAST_COUNT = 100
SAMPLE = 1 / 16  # share of the rows that propose phrases
SAMPLE_COUNT = 3  # a proposal's occurrences there: half of what LEAST_COUNT lets expect
SHARE = 100  # a phrase goes if a longer one has this percentage of its occurrences
TOP = 2000  # phrases reported for each language
CHUNK = 2 << 20
HELD = 2_000_000  # counts a task holds before it hands them on
SEED = 13
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"


class Phrases:
    """Hashes of the phrases of texts, by place of their first word, for 1 to ``MOST_WORDS`` words."""

    lower = np.arange(256, dtype="uint8")
    lower[65:91] += 32
    kind = np.zeros(256, "uint8")
    kind[[9, 32]] = 1
    kind[list(BREAKS)] = 2

    def __init__(self):
        self.byte = odd_numbers(256, SEED)
        self.bases = [int(x) & ~7 | 5 for x in odd_numbers(2, SEED + 1)]
        self.factor = odd_numbers(2, SEED + 2)
        self.powers = [[np.ones(1, "uint64")] * 2 for _ in self.bases]

    def powers_of(self, which: int) -> list[np.ndarray]:
        """Powers of a base and of its inverse, for as many bytes as are read now."""
        if len(self.powers[which][0]) <= len(self.data):
            n, base = len(self.data) * 9 // 8 + 1, self.bases[which]
            self.powers[which] = [np.concatenate([np.ones(1, "uint64"), np.cumprod(np.full(n, x, "uint64"), dtype="uint64")])
                                  for x in (base, pow(base, -1, 1 << 64))]
        return self.powers[which]

    def read(self, texts: list[tuple[int, bytes]]) -> None:
        """``texts`` with the hash of their language each."""
        data = b"\n".join(text for _, text in texts)
        raw = np.frombuffer(data, "uint8")
        self.data = self.lower[raw]
        kind = self.kind[raw]
        edge = np.diff((kind == 0).astype("int8"), prepend=0, append=0)
        self.begin, self.end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        ends = np.cumsum([len(text) + 1 for _, text in texts])
        self.text = np.searchsorted(ends, self.begin, "right")
        self.piece = np.cumsum(kind == 2, dtype="int32")[self.begin]
        self.own = np.array([x for x, _ in texts], "uint64")[self.text]

    def hashes(self, which: int = 0) -> list[np.ndarray]:
        """For each number of words the hashes at all places, also where the piece ends before."""
        powers, inverse = self.powers_of(which)
        sums = np.zeros(len(self.data) + 1, "uint64")
        np.cumsum(self.byte[self.data] * powers[:len(self.data)], out=sums[1:])
        words = mixed((sums[self.end] - sums[self.begin]) * inverse[self.begin] + (self.end - self.begin).astype("uint64"))
        out = [mixed(words + self.own)]
        for n in range(1, MOST_WORDS):
            out.append(mixed(out[-1][:max(len(words) - n, 0)] * self.factor[which] + words[n:]))
        return out

    def whole(self) -> list[np.ndarray]:
        """For each number of words whether the phrase at a place lies in one piece."""
        n = len(self.begin)
        return [self.piece[:max(n - k, 0)] == self.piece[k:] for k in range(MOST_WORDS)]

    def counted(self, hashes: list[np.ndarray], bits: np.ndarray) -> list[np.ndarray]:
        """Where the phrases start of which both parts are proposed."""
        out = self.whole()
        inside = out[0]
        for n in range(1, MOST_WORDS):
            inside = inside & passing(bits, hashes[n - 1])
            out[n] &= inside[:-1] & inside[1:] if len(inside) else inside
            inside = out[n]
        return out


def _texts(batches):
    """Lists of ``language, hash of it, text`` of about ``CHUNK`` bytes; a longer text is cut between pieces."""
    some, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = xxhash.xxh3_64_intdigest(lang.encode())
            while text:
                part, text = _cut(text)
                some.append((lang, own, part))
                size += len(part)
                if size >= CHUNK:
                    yield some
                    some, size = [], 0
    if some:
        yield some


def _cut(text: bytes) -> tuple[bytes, bytes]:
    if len(text) > CHUNK:
        for at in range(CHUNK, len(text)):
            if text[at] in BREAKS:
                return text[:at], text[at + 1:]
    return text, b""


def _summed(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    begins = np.nonzero(np.append(True, hashes[1:] != hashes[:-1]))[0] if len(hashes) else order
    return hashes[begins], np.add.reduceat(n[order], begins) if len(hashes) else n


def _counts(texts: DataFrame, chosen) -> DataFrame:
    """``hash, n`` of the places that ``chosen(phrases, hashes)`` marks, summed by task as far as they fit, then over all."""

    def run(batches):
        phrases, parts, size = Phrases(), [], 0

        def out():
            hashes, n = _summed(np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts]))
            return hashes, n

        for some in _texts(batches):
            phrases.read([(own, text) for _, own, text in some])
            hashes = phrases.hashes()
            marked = chosen(phrases, hashes)
            found, n = np.unique(np.concatenate([h[m] for h, m in zip(hashes, marked, strict=True)]), return_counts=True)
            parts.append((found, n))
            size += len(found)
            if size > HELD:
                parts = [out()]
                size = len(parts[0][0])
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view("int64")), pa.array(parts[0][1])], ["hash", "n"])
                    parts, size = [], 0
        if parts:
            found, n = out()
            yield pa.RecordBatch.from_arrays([pa.array(found.view("int64")), pa.array(n)], ["hash", "n"])

    return texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def proposals(texts: DataFrame) -> DataFrame:
    """``hash`` of the phrases that a sample of the rows holds ``SAMPLE_COUNT`` times or more."""
    found = _counts(texts.sample(SAMPLE, SEED), lambda phrases, hashes: phrases.whole())
    return found.filter(F.col("n") >= SAMPLE_COUNT).select("hash")


def frequent(texts: DataFrame, least: int) -> tuple[list[DataFrame], np.ndarray]:
    """Tables of the ``hash`` of every phrase that may occur ``least`` times or more, one a full pass, and the proposals' bits at the end.

    Each pass counts the proposals and their negative border, but what an earlier pass counted. Border phrases found frequent are
    failures of the sample: they become proposals, and the next pass counts what they let in. No failure: all are found.
    """
    spark = texts.sparkSession
    bits, before, passes = bit_filter(proposals(texts)), None, []
    while True:
        now, then = spark.sparkContext.broadcast(bits), spark.sparkContext.broadcast(before)

        def chosen(phrases, hashes, now=now, then=then):
            marked = phrases.counted(hashes, now.value)
            if then.value is None:
                return marked
            return [m & ~old for m, old in zip(marked, phrases.counted(hashes, then.value), strict=True)]

        found = stored(_counts(texts, chosen).filter(F.col("n") >= least).select("hash"), "frequent")
        passes.append(found)

        def failed(batches, now=now):
            for batch in batches:
                hashes = batch.column(0).to_numpy().view("uint64")
                yield batch.filter(pa.array(~passing(now.value, hashes)))

        failures = bit_filter(found.mapInArrow(failed, "hash long"), bits)
        if not failures.any():
            return passes, bits
        before, bits = bits, bits | failures


def phrase_counts(texts: DataFrame, bits: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """``lang, phrase, words, f``: exact counts of the texts of wanted phrases; ``words`` 0 has the number of all words."""
    spark = texts.sparkSession
    bits, wanted = spark.sparkContext.broadcast(bits), spark.sparkContext.broadcast(wanted)

    def run(batches):
        phrases = Phrases()
        for some in _texts(batches):
            phrases.read([(own, text) for _, own, text in some])
            hashes, others = phrases.hashes(), phrases.hashes(1)
            data, begin, end, text = phrases.data.tobytes(), phrases.begin, phrases.end, phrases.text
            langs, out = [lang for lang, _, _ in some], ([], [], [], [])
            for n, marked in enumerate(phrases.counted(hashes, bits.value)):
                at = np.nonzero(marked & passing(wanted.value, hashes[n][:len(marked)]))[0]
                order = np.lexsort((others[n][at], hashes[n][at]))
                at = at[order]
                first = np.ones(len(at), bool)
                first[1:] = (np.diff(hashes[n][at]) != 0) | (np.diff(others[n][at]) != 0)
                heads = np.nonzero(first)[0]
                words = [[data[a:b] for a, b in zip(begin[at[heads] + k].tolist(), end[at[heads] + k].tolist(), strict=True)] for k in range(n + 1)]
                out[0].extend(langs[k] for k in text[at[heads]].tolist())
                out[1].extend(b" ".join(x) for x in zip(*words, strict=True))
                out[2].extend([n + 1] * len(heads))
                out[3].extend(np.diff(np.append(heads, len(at))).tolist())
            for k, n in zip(*(x.tolist() for x in np.unique(text, return_counts=True)), strict=True):
                for column, x in zip(out, (langs[k], b"", 0, n), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()).cast(pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64())],
                ["lang", "phrase", "words", "f"])

    counted = texts.mapInArrow(run, "lang string, phrase string, words int, f long")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def _some_words(words: Column, first, n) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def _looked_up(rows: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    """Adds as ``name`` the count of the phrase in ``key``."""
    uses = rows.groupBy("lang", key).agg(F.count(F.lit(1)).alias("uses"))
    one = stored(counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(name)).join(uses, ["lang", key]), "uses")
    return joined(rows, one, ["lang", key], "uses")


def scored(counts: DataFrame, share: int = SHARE) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the candidates: frequent phrases of two words and more that no longer one explains."""
    words = F.split("phrase", " ")
    phrases = counts.filter((F.col("words") > 0))
    longer = phrases.filter("words > 2").select("lang", "f", F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: _some_words(words, i, m)))))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = phrases.filter("words > 1").join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f")))
    cuts = stored(left.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"),
                              F.col("words").alias("m")).select(
        "lang", "phrase", "a", "k", _some_words(words, F.lit(1), F.col("k")).alias("first"),
        _some_words(words, F.col("k") + 1, F.col("m") - F.col("k")).alias("rest")), "cuts")
    parted = _looked_up(_looked_up(cuts, phrases, "first", "l"), phrases, "rest", "r")
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    totals = stored(totals.join(cuts.groupBy("lang").agg(F.count(F.lit(1)).alias("uses")), "lang"), "totals")
    wide = lambda name: F.col(name).cast("decimal(18,0)")  # noqa: E731 a product of two has all 36 digits
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * F.col("n").cast("decimal(16,0)"), wide("l") * wide("r"))
    each = joined(parted, totals, ["lang"], "uses").withColumn("score", score)
    best = each.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    return best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """Adds ``rank`` and keeps each language's first ``top``: those of each of several parts of it, then of what is left."""
    order = "ORDER BY score DESC, a DESC, phrase"
    some = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, part {order})")).filter(F.col("rank") <= top)
    some = some.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("long")).filter(F.col("rank") <= top)
    return some.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``MOST_WORDS`` words.

    Texts are put in lower case (A to Z) and end a piece at punctuation and line ends; words stand between spaces and tabs. A null language is
    ``und``; null and empty texts hold no words. Repeated rows count each; other columns are not read, whatever their names. No
    phrase ``least`` times in a language gives no rows.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    passes, bits = frequent(texts, least)
    wanted = passes[0]
    for more in passes[1:]:
        wanted = wanted.unionByName(more)
    counts = stored(phrase_counts(texts, bits, bit_filter(wanted)).filter((F.col("f") >= least) | (F.col("words") == 0)), "phrases")
    discard(*passes)
    return ranked(scored(counts), top)


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
w AS (SELECT lang, [x FOR x IN string_split_regex(t, '[\x20\x09]+') IF x <> ''] AS w FROM p),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
part AS (SELECT lang, f, w, k, unnest(range(1, m - k + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS k) WHERE k < m),
longer AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(f) AS most FROM part GROUP BY ALL),
cut AS (SELECT c.lang, c.phrase, c.f AS a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
  FROM c LEFT JOIN longer USING (lang, phrase), (SELECT unnest(range(1, 5)) AS k) WHERE k < m AND (most IS NULL OR 100 * most < 100 * c.f)),
s AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranks WHERE rank <= 2000
"""
