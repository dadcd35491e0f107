"""How the tokens of two tokenizers lie over each other, by merge-path partitioning.

The ends of both tokenizers' tokens, as byte offsets, are two sorted lists. Where a diagonal of their merge grid crosses the merge's
path, a binary search finds without merging anything; so the path is cut into pieces of equal work that need nothing of each other. Each
step of a piece that moves on in the text is one overlap of a token of A and a token of B, and where both lists have the same end
a group ends. A group that reaches over pieces is put together from their ends.

Corpus-wide counts of linked ids are looked up in two ways: the most frequent ``COMMON`` pairs go to every task, so a pair that all
documents have is never a hot key; the others, each in a small share of the documents, meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.llm.backtrack_bpe import byte_letters
from flowtables.llm.stage import small_batches, stored
from flowtables.llm.tokens import batches, read_spec

PIECE = 1 << 16  # ends merged in a piece
COMMON = 1 << 16  # pairs sent to every task
RUN = 64  # stretches encoded as one text
CACHE_BYTES = 60 << 20
SHIFT = 20  # of a pair's first id: ids are below 2 ** 20


def path_places(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of ``a`` the merge of sorted ``a`` and ``b`` has taken on each diagonal; of equal values that of ``a`` comes first."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) // 2
        taken = np.zeros(len(low), bool)
        taken[open_] = a[middle[open_]] <= b[(diagonals - 1 - middle)[open_]]
        low, high = np.where(open_ & taken, middle + 1, low), np.where(open_ & ~taken, middle, high)


def piece_overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int):
    """Of the piece that merges ``a[i0:i1]`` with ``b[j0:j1]``: the overlaps as numbers of tokens, and the places where groups end."""
    some_a, some_b = a[i0:i1], b[j0:j1]
    from_a = np.zeros(len(some_a) + len(some_b), bool)
    from_a[np.arange(len(some_a)) + np.searchsorted(some_b, some_a, "left")] = True
    ends = np.empty(len(from_a), "int64")
    ends[from_a], ends[~from_a] = some_a, some_b
    i = i0 + np.cumsum(from_a) - from_a  # the first token of each list that has not ended before the step
    j = j0 + np.cumsum(~from_a) - ~from_a
    before = max(a[i0 - 1] if i0 else 0, b[j0 - 1] if j0 else 0)
    moved = np.diff(ends, prepend=before) > 0
    both = ~moved  # the same end twice: first A's, then B's
    return i[moved], j[moved], i[both], j[both] + 1


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE):
    """All overlaps (numbers in ``a``, numbers in ``b``) and, for each group, the end (exclusive) of its tokens in ``a`` and ``b``."""
    diagonals = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    i = path_places(a, b, diagonals)
    j = diagonals - i
    parts = [piece_overlaps(a, b, *x) for x in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True)]
    return tuple(np.concatenate(x) if parts else np.zeros(0, "int64") for x in (zip(*parts, strict=True) if parts else ((),) * 4))


class Pair:
    """Both tokenizers over ``space + text``, each distinct stretch encoded once.

    A stretch is a space or line end and what follows up to the next, where each stands alone between other characters: neither
    tokenizer has a token over such a seam. Other texts are encoded whole.
    """

    def __init__(self, a_spec: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_spec)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        added = {k: t.content.encode() for k, t in self.a.get_added_tokens_decoder().items()}
        tokens = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        self.a_bytes = [added.get(k) or bytes(letters[c] for c in t) for k, t in enumerate(tokens)]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(k) else b"" if self.b.is_control(k) else t.replace("▁", " ").encode()
                        for k, t in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t], "int64") for t in (self.a_bytes, self.b_bytes))
        self.seams = not any("▁" in t.lstrip("▁") or " " in t or "\n" in t for t in pieces)
        self.space = self.b.piece_to_id("▁")
        self.numbers = pa.array([str(k) for k in range(max(len(tokens), len(pieces)))])
        self.known: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.size = 0

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both over ``space + text``; None if the tokens' bytes are not those of it."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        want = b" " + text.encode()
        if b"".join([self.a_bytes[k] for k in a]) != want or b"".join([self.b_bytes[k] for k in b]) != want:
            return None
        return np.array(a, "<u4"), np.array(b, "<u4")

    def _run(self, some: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of stretches (each with its space or line end before it), encoded in a row."""
        text = "".join(some)
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:] if text[0] == " " else text)
        if text[0] != " ":
            if b[:1] != [self.space]:
                return [None] * len(some)
            b = b[1:]
        ends = np.cumsum([len(x.encode()) for x in some])
        out = []
        for ids, lengths, tokens in ((a, self.a_lengths, self.a_bytes), (b, self.b_lengths, self.b_bytes)):
            ids = np.array(ids, "<u4")
            at = np.cumsum(lengths[ids])
            cut = np.searchsorted(at, ends)
            if len(at) == 0 or at[-1] != ends[-1] or (at[cut] != ends).any() or b"".join([tokens[k] for k in ids.tolist()]) != text.encode():
                return [None] if len(some) == 1 else [self._run([x])[0] for x in some]
            out.append([x.tobytes() for x in np.split(ids, cut[:-1] + 1)])
        return list(zip(*out, strict=True))

    def learn(self, parts: list[str]) -> None:
        """Encodes stretches (without the space before them); those that cannot stand alone get None."""
        fit = []
        for part in parts:
            stem = part[1:] if part[:1] == "\n" else part
            if self.seams and stem.split() == [stem]:
                fit.append(part)
            else:
                self.known[part] = None
        for k in range(0, len(fit), RUN):
            some = fit[k:k + RUN]
            for part, form in zip(some, self._run([x if x[0] == "\n" else " " + x for x in some]), strict=True):
                self.known[part] = form
                self.size += 200 + 2 * len(part) + sum(map(len, form or ()))

    def encoded(self, texts: pa.Array):
        """Rows with tokens, and for A and B the ids of all of them in a row with each row's number of ids."""
        if self.size > CACHE_BYTES:
            self.known, self.size = {}, 0
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = split.flatten().dictionary_encode()
        parts = coded.dictionary.to_pylist()
        new = [x for x in parts if x not in self.known]
        if new:
            self.learn(new)
        forms = [self.known[x] for x in parts]
        turn, bounds = coded.indices.to_numpy(), split.offsets.to_numpy()
        bounds = bounds - bounds[0]
        poor = np.array([form is None for form in forms], bool)
        before = np.concatenate([[0], np.cumsum(poor[turn])])
        filled = pc.binary_length(texts).to_numpy() > 0
        fast = filled & (before[bounds[1:]] == before[bounds[:-1]])
        use = np.repeat(fast, np.diff(bounds))
        rows, sides = [np.nonzero(fast)[0]], []
        for side in (0, 1):
            data = [b"" if form is None else form[side] for form in forms]
            sizes = np.fromiter(map(len, data), "int64", len(data)) // 4
            flat, starts, chosen = np.frombuffer(b"".join(data), "<u4"), np.cumsum(sizes) - sizes, turn[use]
            ends = np.cumsum(sizes[chosen])
            ids = flat[np.repeat(starts[chosen] - ends + sizes[chosen], sizes[chosen]) + np.arange(ends[-1] if len(ends) else 0)]
            total = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(np.diff(bounds)[fast])])]
            sides.append(([ids], [np.diff(total)]))
        for row in np.nonzero(filled & ~fast)[0].tolist():
            found = self.whole(texts[row].as_py())
            if found is not None:
                rows.append(np.array([row]))
                for (ids, n), x in zip(sides, found, strict=True):
                    ids.append(x)
                    n.append(np.array([len(x)]))
        return np.concatenate(rows), *((np.concatenate(ids).astype("int64"), np.concatenate(n)) for ids, n in sides)

    def joined_groups(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Each group's ids in decimal, with commas."""
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("int32")), self.numbers.take(pa.array(ids)))
        return pc.binary_join(lists, ",")


def links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` with its different linked ``pairs`` (the id of A
    times 2 ** ``SHIFT`` plus that of B) and the ``times`` each is linked; ``with_groups`` adds the ``groups`` themselves.

    A row whose text is null or empty, or whose tokens do not give back ``space + text``, has no tokens. Rows without an id and repeated rows are
    treated like others; other columns are not read, whatever their names.
    """
    context = small_batches(docs.sparkSession).sparkContext
    with open(b_path, "rb") as file:
        specs = context.broadcast((read_spec(a_path), file.read()))  # two files of fixed size
    kind = docs.schema[id_col].dataType.simpleString()

    def run(incoming):
        pair = Pair(*specs.value)
        for batch in incoming:
            texts, first = batch.column(1), 0
            for some in batches(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), int):
                part = texts.slice(first, len(some))
                ids = batch.column(0).slice(first, len(some))
                first += len(some)
                yield aligned(pair, ids, part)

    def aligned(pair: Pair, doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        rows, (a, n_a), (b, n_b) = pair.encoded(texts)
        i, j, a_end, b_end = overlaps(np.cumsum(pair.a_lengths[a]), np.cumsum(pair.b_lengths[b]))
        doc = np.repeat(np.arange(len(rows)), n_a)
        n_links = np.bincount(doc[i], minlength=len(rows))
        n_groups = np.bincount(doc[a_end - 1], minlength=len(rows))
        groups = pc.binary_join_element_wise(pair.joined_groups(a, a_end), pair.joined_groups(b, b_end), "|")
        texts_of = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_groups)]).astype("int32")), groups), ";")
        keys = np.sort(doc[i] << (2 * SHIFT) | a[i] << SHIFT | b[j])
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        heads = np.nonzero(first)[0]
        n_pairs = np.bincount(keys[heads] >> (2 * SHIFT), minlength=len(rows))

        def spread(values, empty=0):
            out = np.full(len(doc_ids), empty, "int64")
            out[rows] = values
            return pa.array(out)

        order = np.argsort(rows, kind="stable")  # rows encoded whole come last; back to the order of the batch
        counts = np.zeros(len(doc_ids), "int64")
        counts[rows] = n_pairs
        starts = np.cumsum(n_pairs) - n_pairs
        take = np.repeat(starts[order] - (np.cumsum(n_pairs[order]) - n_pairs[order]), n_pairs[order]) + np.arange(len(heads))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype("int32"))
        times = np.diff(np.append(heads, len(keys)))
        shown = [""] * len(doc_ids)
        found = texts_of.to_pylist()
        for row, x in zip(rows.tolist(), found, strict=True):
            shown[row] = x
        columns = [doc_ids, spread(n_a), spread(n_b), spread(n_groups), spread(n_links),
                   pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in shown]),
                   pa.ListArray.from_arrays(offsets, pa.array((keys[heads] & ((1 << 2 * SHIFT) - 1))[take])),
                   pa.ListArray.from_arrays(offsets, pa.array(times[take].astype("int32")))]
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        if with_groups:
            columns, names = [*columns, pa.array(shown)], [*names, "groups"]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = (f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
              + ", groups string" * with_groups)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pair_counts(linked: DataFrame) -> DataFrame:
    """``pair, n, best``: how many rows have the ids linked, and whether no other pair of the same id of A has more."""

    def run(incoming):
        for batch in incoming:
            pairs, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    counts = linked.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts, "counts")
    a = F.shiftright("pair", SHIFT)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` are the links whose pair of ids is in as many rows as any of its id of A; ``count_sum`` adds up over the links in how many
    rows their pair is. What :func:`links` says of odd rows holds here too.
    """
    spark = docs.sparkSession
    linked = stored(links(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "links")
    counts = stored(pair_counts(linked), "pairs")
    top = counts.orderBy(F.desc("n"), "pair").limit(COMMON).toPandas().sort_values("pair")  # COMMON rows at most, whatever the table's size
    common = spark.sparkContext.broadcast(tuple(top[name].to_numpy() for name in ("pair", "n", "best")))

    def run(incoming):
        pairs, n, best = common.value
        for batch in incoming:
            lists = batch.column(1)
            found, times = lists.flatten().to_numpy(zero_copy_only=False), batch.column(2).flatten().to_numpy(zero_copy_only=False).astype("int64")
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            at = np.minimum(np.searchsorted(pairs, found), max(len(pairs) - 1, 0))
            there = pairs[at] == found if len(pairs) else np.zeros(len(found), bool)
            sums = []
            for value in (np.where(there, best[at], False), np.where(there, n[at], 0)) if len(pairs) else (there, there):
                total = np.concatenate([[0], np.cumsum(value * times)])
                sums.append(pa.array((total[bounds[1:]] - total[bounds[:-1]]).astype("int64")))
            left = pa.array(np.concatenate([[0], np.cumsum(~there)])[bounds].astype("int32"))
            rest = [pa.ListArray.from_arrays(left, pa.array(x[~there])) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums, *rest], ["row", "n_best", "count_sum", "pairs", "times"])

    known = stored(linked.select("row", "pairs", "times").mapInArrow(
        run, "row long, n_best long, count_sum long, pairs array<long>, times array<long>"), "known")
    rest = known.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    more = rest.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_more"), F.sum(F.col("n") * F.col("times")).alias("sum_more"))
    sums = known.select("row", "n_best", "count_sum").join(more, "row", "left")
    out = linked.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("best_more", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("sum_more", F.lit(0))).alias("count_sum"), "groups_sha256")
