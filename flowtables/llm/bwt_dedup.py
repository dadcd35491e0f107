"""Repeated byte strings by merging Burrows-Wheeler transforms of shards.

Only text whose windows may be shared is looked at: a window's key is the least hash of its ``GRAM``-byte strings, equal windows
have equal keys, and keys seen in one row only are left out (a filter of fixed size says which; what it lets through too much
costs time, not rightness). The rest is cut into pieces at places the text itself decides, so copies give equal pieces; an equal
piece is looked at once, with the smallest document that holds it. A key of one segment in all different pieces needs no index: its
windows are in no other piece, and the piece's smallest document is their answer.

The index is a suffix order in parts. All windows of one key are in one part, so a part needs nothing of the others. Shards of
a part are transformed apart, each with its own sort; then the transforms alone are merged. The interleave of the shards' suffixes
is refined step by step: the order by ``h`` bytes and one pass over the transforms' bytes give the order by ``h + 2``. Suffixes
that agree in ``h`` bytes stand side by side as a block: where a block parts, the common prefix of its neighbours is ``h`` or one more.
Blocks of one suffix are settled and leave the refinement. After ``WINDOW`` bytes what is left are the repeated intervals, and the
smallest document of each is the answer for all windows in it.

A key of more segments than a part may hold is no part's. Its segments are few texts often met: equal ones are taken together, and
of the different ones a window in very many is looked up in a table, the others are grouped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtables.llm.bounded import bit_filter, joined, passing
from flowtables.llm.stage import discard, small_batches, stored
from flowtables.llm.words import mixed, odd_numbers

WINDOW = 50
GRAM = 20
CHUNK = 1 << 18  # bytes of text worked on at once: its hashes stay in a processor's cache
RUN = 64  # windows of a segment at most
PIECE = 512  # windows of a piece at most
PIECE_BITS = 2  # a piece holds 2 ** PIECE_BITS runs of one key on average
PART_BYTES = 1 << 20  # of segments, on average
SHARD_BYTES = 8 << 20  # of segments that a task holds to make shards of them, one a part
KEY_SEGMENTS = 4096  # a key with more segments is no part's
HOT_WINDOWS = 100_000  # of crowded keys, at most, whose answers every task has
HELD_KEYS = 1 << 19  # that a task holds to sort them into buckets
BUCKET_BITS = 11
SEEN = 200_000  # pieces a task remembers
SEED = 12
ZSTD = "zstd"


class WindowKeys:
    """The key of every ``WINDOW``-byte window of a text: the least hash of its ``GRAM``-byte strings."""

    def __init__(self):
        self.byte = odd_numbers(256, SEED)
        self.base = int(odd_numbers(1, SEED + 1)[0]) & ~7 | 5
        self.grow(CHUNK)

    def grow(self, n: int) -> None:
        self.powers, self.inverse = (
            np.concatenate([np.ones(1, "uint64"), np.cumprod(np.full(n, x, "uint64"), dtype="uint64")])
            for x in (self.base, pow(self.base, -1, 1 << 64)))

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n > len(self.powers):
            self.grow(2 * n)
        sums = np.zeros(n + 1, "uint64")
        np.cumsum(self.byte[data] * self.powers[:n], out=sums[1:])
        least = mixed((sums[GRAM:] - sums[:-GRAM]) * self.inverse[:n - GRAM + 1])
        grams, width = WINDOW - GRAM + 1, 1
        while 2 * width <= grams:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < grams:
            least = np.minimum(least[:len(least) - (grams - width)], least[grams - width:])
        return mixed(least ^ np.uint64(SEED))  # least values are small: their first bits would be much alike


def _chunks(texts: list[bytes | None]):
    """Lists of ``row, place of its first byte, bytes``: every window of every text is in one of them."""
    some, size = [], 0
    for row, text in enumerate(texts):
        for base in range(0, len(text or b"") - WINDOW + 1, CHUNK):
            part = text[base:base + CHUNK + WINDOW - 1]
            some.append((row, base, part))
            size += len(part)
            if size >= CHUNK:
                yield some
                some, size = [], 0
    if some:
        yield some


class Keyed:
    """Texts put together, with the key of each window and whether the window lies in one text: between two texts some do not."""

    def __init__(self, some: list[tuple[int, int, bytes]], key: WindowKeys):
        self.data = b"".join(part for _, _, part in some)
        lengths = np.array([len(part) for _, _, part in some])
        self.keys = key(np.frombuffer(self.data, "uint8"))
        self.ends = np.cumsum(lengths)
        self.inside = np.ones(len(self.data), bool)
        self.inside[(self.ends[:, None] - np.arange(1, WINDOW)).ravel()] = False
        self.inside = self.inside[:len(self.keys)]
        self.row = np.array([row for row, _, _ in some])
        self.before = np.array([base for _, base, _ in some]) - (self.ends - lengths)

    def rows(self, windows: np.ndarray) -> np.ndarray:
        return self.row[np.searchsorted(self.ends, windows, "right")]

    def places(self, windows: np.ndarray) -> np.ndarray:
        return windows + self.before[np.searchsorted(self.ends, windows, "right")]

    def runs(self, chosen: np.ndarray, cut: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """First windows and lengths of the runs of chosen windows, all of them inside, cut where ``cut`` says so and after ``most`` windows."""
        first = chosen.copy()
        first[1:] &= ~chosen[:-1] | cut[1:]
        begins = np.nonzero(first)[0]
        if not len(begins):
            return begins, begins
        within = np.cumsum(chosen) - chosen
        total = int(within[-1] + chosen[-1])
        lengths = np.diff(np.append(within[begins], total))
        pieces = -(-lengths // most)
        turn = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        return np.repeat(begins, pieces) + turn * most, np.minimum(most, np.repeat(lengths, pieces) - turn * most)

    def new_key(self) -> np.ndarray:
        out = np.ones(len(self.keys), bool)
        out[1:] = self.keys[1:] != self.keys[:-1]
        return out


def _buckets(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Keys with their rows (rising) as sorted keys by their first bits: once if one row has the key, twice if several have."""
    keys, rows = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    keys = keys[new]
    needed = np.ones(len(keys), bool)
    needed[2:] = keys[2:] != keys[:-2]
    keys = keys[needed]
    begins = np.searchsorted(keys, np.arange(1 << BUCKET_BITS, dtype="uint64") << np.uint64(64 - BUCKET_BITS))
    offsets = (np.append(begins, len(keys)) * 8).astype("int32")
    content = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(keys)])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(begins), dtype="int32")), content], ["bucket", "keys"])
    return batch.filter(pa.array(np.diff(offsets) > 0))


def shared_keys(texts: DataFrame) -> DataFrame:
    """``hash`` of the window keys that several rows have.

    There is a key for every few bytes of text: they travel sorted, many in a row, by their first bits.
    """

    def run(batches):
        key, held, size, past = WindowKeys(), [], 0, 0
        for batch in batches:
            for some in _chunks(batch.column(0).to_pylist()):
                found = Keyed(some, key)
                heads, _ = found.runs(found.inside, found.new_key(), 1 << 40)
                held.append((found.keys[heads], found.rows(heads) + past))
                size += len(heads)
                if size >= HELD_KEYS:
                    yield _buckets(held)
                    held, size = [], 0
            past += batch.num_rows
        if held:
            yield _buckets(held)

    def repeated(table: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]))
        return pa.table({"hash": np.unique(keys[1:][keys[1:] == keys[:-1]]).view("int64")})

    return texts.select("bytes").mapInArrow(run, "bucket int, keys binary").groupBy("bucket").applyInArrow(repeated, "hash long")


def pieces(texts: DataFrame, bits) -> DataFrame:
    """``doc_id, mark, start, length, p1, p2, bytes`` of the stretches of windows whose key may be shared, in pieces.

    ``length`` counts windows; ``p1, p2`` name the piece's bytes. Of the pieces that a task met lately only the first has ``bytes``.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        key, seen = WindowKeys(), set()
        for batch in batches:
            for some in _chunks(batch.column(2).to_pylist()):
                found = Keyed(some, key)
                chosen = found.inside & passing(bits.value, found.keys)
                cut = found.new_key() & (found.keys & np.uint64((1 << PIECE_BITS) - 1) == 0)
                begins, lengths = found.runs(chosen, cut, PIECE)
                if not len(begins):
                    continue
                ends = begins + lengths + WINDOW - 1
                content = [found.data[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                names = [xxhash.xxh3_128_digest(x) for x in content]
                for k, name in enumerate(names):
                    if name in seen:
                        content[k] = None
                    else:
                        seen.add(name)
                if len(seen) > SEEN:
                    seen.clear()
                p = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
                rows = pa.array(found.rows(begins))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found.places(begins)), pa.array(lengths.astype("int32")),
                     pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(content, pa.binary())],
                    ["doc_id", "mark", "start", "length", "p1", "p2", "bytes"])

    schema = f"doc_id {kind}, mark long, start long, length int, p1 long, p2 long, bytes binary"
    return texts.select("doc_id", "mark", "bytes").mapInArrow(run, schema)


def segment_keys(distinct: DataFrame) -> DataFrame:
    """``hash, n, windows`` of the keys with several segments: those of one are in one piece only."""

    def run(batches):
        key = WindowKeys()
        for batch in batches:
            for some in _chunks(batch.column(0).to_pylist()):
                found = Keyed(some, key)
                begins, lengths = found.runs(found.inside, found.new_key(), RUN)
                keys, of, n = np.unique(found.keys[begins], return_inverse=True, return_counts=True)
                windows = np.bincount(of, lengths, len(keys)).astype("int64")
                yield pa.RecordBatch.from_arrays([pa.array(keys.view("int64")), pa.array(n), pa.array(windows)], ["hash", "n", "windows"])

    counted = distinct.select("bytes").mapInArrow(run, "hash long, n long, windows long").groupBy("hash").agg(
        F.sum("n").alias("n"), F.sum("windows").alias("windows"))
    return counted.filter("n > 1")


def _texts(found: Keyed, begins: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    return [found.data[a:b] for a, b in zip(begins.tolist(), (begins + lengths + WINDOW - 1).tolist(), strict=True)]


def _segments(batches, several, crowded, parts: int):
    """Of batches of ``p1, p2, low, n, bytes`` the segments of the parts: part, row of the batch, place in the piece, bytes; each
    piece cut by key, so that equal windows are in one part."""
    key = WindowKeys()
    for batch in batches:
        for some in _chunks(batch.column(4).to_pylist()):
            found = Keyed(some, key)
            chosen = found.inside & passing(several, found.keys) & ~passing(crowded, found.keys)
            begins, lengths = found.runs(chosen, found.new_key(), RUN)
            part = (found.keys[begins] % np.uint64(parts)).astype("int64")
            rows = pa.array(found.rows(begins))
            yield pa.table([
                pa.array(part), *(batch.column(k).take(rows) for k in (0, 1)), pa.array(found.places(begins).astype("int32")),
                *(batch.column(k).take(rows) for k in (2, 3)), pa.array(_texts(found, begins, lengths), pa.binary())],
                names=["part", "p1", "p2", "at", "low", "n", "bytes"])


def apart(distinct: DataFrame, several, crowded) -> DataFrame:
    """``p1, p2, at, length, low, n, r1, r2, bytes`` of the windows that are in no part.

    Without ``bytes``: stretches of windows in one piece only, where several rows have that piece (one row loses nothing to itself).
    With ``bytes``, which ``r1, r2`` name: runs of windows of a crowded key.
    """
    kind = distinct.schema["low"].dataType.simpleString()

    def stretches(batch, found, begins, lengths, names, content):
        rows = pa.array(found.rows(begins))
        return pa.RecordBatch.from_arrays(
            [*(batch.column(k).take(rows) for k in (0, 1)), pa.array(found.places(begins).astype("int32")), pa.array(lengths.astype("int32")),
             *(batch.column(k).take(rows) for k in (2, 3)), *names, content], ["p1", "p2", "at", "length", "low", "n", "r1", "r2", "bytes"])

    def run(batches):
        key = WindowKeys()
        for batch in batches:
            n = batch.column(3).to_numpy()
            for some in _chunks(batch.column(4).to_pylist()):
                found = Keyed(some, key)
                shared = passing(several.value, found.keys)
                begins, lengths = found.runs(found.inside & ~shared, np.zeros(len(shared), bool), 1 << 40)
                held = n[found.rows(begins)] > 1
                begins, lengths = begins[held], lengths[held]
                yield stretches(batch, found, begins, lengths, [pa.nulls(len(begins), pa.int64())] * 2, pa.nulls(len(begins), pa.binary()))
                begins, lengths = found.runs(found.inside & shared & passing(crowded.value, found.keys), found.new_key(), RUN)
                content = _texts(found, begins, lengths)
                yield stretches(batch, found, begins, lengths, map(pa.array, _names(content).T), pa.array(content, pa.binary()))

    return distinct.select("p1", "p2", "low", "n", "bytes").mapInArrow(
        run, f"p1 long, p2 long, at int, length int, low {kind}, n long, r1 long, r2 long, bytes binary")


def _names(content: list[bytes]) -> np.ndarray:
    """Two numbers that name each text."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, content)), "<i8").reshape(-1, 2)


def _windows(text: bytes) -> list[bytes]:
    return [text[k:k + WINDOW] for k in range(len(text) - WINDOW + 1)]


def crowded_windows(runs: DataFrame) -> DataFrame:
    """``p1, p2, n, found`` for the windows of crowded keys.

    Equal runs are taken together. A window in more than ``KEY_SEGMENTS`` different ones is looked up; there are few of those.
    """
    kind = runs.schema["low"].dataType.simpleString()
    distinct = stored(runs.groupBy("r1", "r2").agg(
        F.min("low").alias("low"), F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes")), "runs", ZSTD)

    def named(batches):
        for batch in batches:
            lists = [_windows(text) for text in batch.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            names = _names([window for some in lists for window in some])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *map(pa.array, names.T)], ["low", "w1", "w2"])

    counted = distinct.select("low", "bytes").mapInArrow(named, f"low {kind}, w1 long, w2 long").groupBy("w1", "w2").agg(
        F.min("low").alias("least"), F.count(F.lit(1)).alias("n"))
    total = distinct.agg(F.sum(F.length("bytes") - WINDOW + 1)).first()[0] or 0
    bound = max(KEY_SEGMENTS, total // HOT_WINDOWS)
    hot = runs.sparkSession.sparkContext.broadcast({(r.w1, r.w2): r.least for r in counted.filter(F.col("n") > bound).collect()})

    def looked_up(batches):
        known = hot.value
        for batch in batches:
            out = []
            for r1, r2, n, low, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                last = None
                for k, name in enumerate(map(tuple, _names(_windows(text)).tolist())):
                    if name not in known:
                        out.append([r1, r2, n, k, 1, low, *name])
                        last = None
                    elif last is not None and last[5] == known[name]:
                        last[4] += 1
                    else:
                        last = [r1, r2, n, k, 1, known[name], None, None]
                        out.append(last)
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [batch.schema.field("low").type] + [pa.int64()] * 2
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, like) for x, like in zip(zip(*out, strict=True), kinds, strict=True)],
                    ["r1", "r2", "rows", "at", "length", "low", "w1", "w2"])

    windows = stored(distinct.select("r1", "r2", "rows", "low", "bytes").mapInArrow(
        looked_up, f"r1 long, r2 long, rows long, at int, length int, low {kind}, w1 long, w2 long"), "windows", ZSTD)
    grouped = windows.filter("w1 is not null").withColumn("low", F.min("low").over(Window.partitionBy("w1", "w2")))
    found = stored(windows.filter("w1 is null").unionByName(grouped).groupBy("r1", "r2").agg(
        F.max("rows").alias("rows"), F.collect_list(F.struct("at", "length", "low")).alias("found")), "run-windows", ZSTD)
    of_pieces = F.transform("found", lambda x: F.struct((F.col("place") + x["at"]).alias("at"), x["length"].alias("length"), x["low"].alias("low")))
    out = joined(runs.select("p1", "p2", "n", F.col("at").alias("place"), "r1", "r2"), found, ["r1", "r2"], "rows")
    out = stored(out.select("p1", "p2", "n", of_pieces.alias("found")).groupBy("p1", "p2").agg(
        F.max("n").alias("n"), F.flatten(F.collect_list("found")).alias("found")), "crowded", ZSTD)
    discard(distinct, windows, found)
    return out


def _packed(code: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Each place's code and the next ones, ``width`` in all, in one number; nothing behind a string's end (0) counts."""

    def longer(one, n, more, n_more):
        tail = np.zeros(len(one), "uint64")
        tail[:max(0, len(one) - n)] = more[n:]
        tail[one & np.uint64((1 << bits) - 1) == 0] = 0
        return one << np.uint64(n_more * bits) | tail

    powers = [code]
    while 2 << (len(powers) - 1) <= width:
        n = 1 << (len(powers) - 1)
        powers.append(longer(powers[-1], n, powers[-1], n))
    out, n = powers[-1], 1 << (len(powers) - 1)
    for k in range(len(powers) - 2, -1, -1):
        if n + (1 << k) <= width:
            out, n = longer(out, n, powers[k], 1 << k), n + (1 << k)
    return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of strings in a row (bytes plus 1, each string ended by 0) in order; a 0 before that of a later string.

    As many bytes as 64 bits hold beside the place at first, then the ranks of suffixes still equal are doubled.
    """
    n = len(text)
    there = np.bincount(text, minlength=257) > 0
    there[0] = True  # stays 0
    code = np.cumsum(there, dtype="uint64") - np.uint64(1)
    bits, place_bits = max(1, int(code[-1]).bit_length()), n.bit_length()
    width = (64 - place_bits) // bits
    keys = np.sort(_packed(code[text], bits, width) << np.uint64(place_bits) | np.arange(n, dtype="uint64"))
    order = (keys & np.uint64((1 << place_bits) - 1)).astype("int64")
    keys >>= np.uint64(place_bits)
    new = np.ones(n, bool)
    new[1:] = (keys[1:] != keys[:-1]) | (keys[1:] & np.uint64((1 << bits) - 1) == 0)  # those with an end in them are settled by their place
    while not new.all():
        rank = np.empty(n + 1, "int64")
        rank[n] = -1
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.nonzero(tied)[0]
        some = order[at]
        pair = rank[some] * (n + 1) + rank[np.minimum(some + width, n)] + 1
        turn = np.argsort(pair, kind="stable")
        order[at] = some[turn]
        pair = pair[turn]
        fresh = np.ones(len(at), bool)
        fresh[1:] = np.diff(pair) != 0
        new[at] = fresh
        width *= 2
    return order


def transform(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of sorted strings: the byte before each suffix, and the rows of it that begin a string."""
    offsets = np.frombuffer(strings.buffers()[1], "int32")[strings.offset:strings.offset + len(strings) + 1].astype("int64")
    data = np.frombuffer(strings.buffers()[2], "uint8")[offsets[0]:offsets[-1]]
    lengths = np.diff(offsets)
    text = np.zeros(len(data) + len(strings), "uint16")
    ends = np.cumsum(lengths + 1) - 1
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = data.astype("uint16") + 1
    order = suffix_order(text)
    before = text[order - 1]  # of a string's first byte: the end of the one before it, which stands for its own
    return (before - (before > 0)).astype("uint8"), np.nonzero(before == 0)[0].astype("int32")


def shard_transforms(distinct: DataFrame, several, crowded, parts: int) -> DataFrame:
    """One row a shard, which is what a task holds of a part at once: its transform, and what belongs to its strings in their order."""
    kind = distinct.schema["low"].dataType.simpleString()
    lists = ("p1", "p2", "at", "low", "n")

    def shards(held):
        table = pa.concat_tables(held)
        table = table.take(pc.sort_indices(table, sort_keys=[("part", "ascending"), ("bytes", "ascending")])).combine_chunks()
        if not table.num_rows:
            return
        part = table.column("part").to_numpy()
        bounds = np.append(np.nonzero(np.append(True, part[1:] != part[:-1]))[0], len(part))
        rows = [transform(table.column("bytes").chunk(0).slice(a, b - a)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        offsets = pa.array(bounds.astype("int32"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[bounds[:-1]]), pa.array([x.tobytes() for x, _ in rows], pa.binary()), pa.array([x.tobytes() for _, x in rows], pa.binary()),
             *(pa.ListArray.from_arrays(offsets, table.column(name).chunk(0)) for name in lists)], ["part", "before", "begins", *lists])

    def run(batches):
        held, size = [], 0
        for table in _segments(batches, several.value, crowded.value, parts):
            held.append(table)
            size += table.column("bytes").nbytes
            if size > SHARD_BYTES:
                yield from shards(held)
                held, size = [], 0
        if held:
            yield from shards(held)

    return distinct.select("p1", "p2", "low", "n", "bytes").mapInArrow(
        run, f"part long, before binary, begins binary, p1 array<long>, p2 array<long>, at array<int>, low array<{kind}>, n array<long>")


def two_bytes_on(before: np.ndarray, back: np.ndarray) -> np.ndarray:
    """For each row the two bytes before its suffix, the further one first, and above them the row of the suffix that begins there.

    Rows with fewer bytes before them get something that no one may look at. In one number, as a refinement's look-ups are scattered.
    """
    byte = (before - 1).astype("uint8").astype("int64")
    return back[back].astype("int64") << 16 | byte[back] << 8 | byte


def repeated_blocks(on: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Refines the interleave of all shards' suffixes to ``WINDOW`` bytes; rows of the repeated intervals, and each one's block.

    ``on`` is :func:`two_bytes_on`: a step takes the order by ``h`` bytes to that by ``h + 2``. ``rows`` are the suffixes that have
    ``WINDOW`` bytes of their string before them. After ``h`` bytes a window stands for its last ``h`` bytes and on.
    """
    block = np.zeros(len(rows), "int64")
    for _ in range(WINDOW // 2):
        if not len(rows):
            break
        there = on[rows]
        pair = there.astype("uint16")
        order = np.argsort(pair, kind="stable")
        rows, own = (there >> 16).astype("int32")[order], (block << 16 | pair)[order]
        first = np.ones(len(rows) + 1, bool)
        np.not_equal(own[1:], own[:-1], out=first[1:-1])
        several = ~(first[:-1] & first[1:])
        block = np.cumsum(first[:-1])[several]
        rows = rows[several]
    return rows, block


def merged(shards: DataFrame) -> DataFrame:
    """``p1, p2, n, at, length, low`` for the windows of the shards' strings, by merging the transforms of each part's shards.

    Of a piece that one row has, only those that are also in another piece, of a smaller document.
    """
    kind = shards.schema["low"].dataType.elementType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        shards = table.select(["before", "begins"]).to_pylist()
        before, back, starts, size = [], [], [], 0
        for shard in shards:
            own = np.frombuffer(shard["before"], "uint8").astype("uint16") + 1
            begins = np.frombuffer(shard["begins"], "int32")
            own[begins] = 0
            there = np.empty(len(own), "int32")
            there[np.argsort(own, kind="stable")] = np.arange(size, size + len(own), dtype="int32")
            before.append(own)
            back.append(there)
            starts.append(np.arange(size, size + len(begins), dtype="int32"))  # the rows of the strings' ends come first
            size += len(own)
        before, back, starts = np.concatenate(before), np.concatenate(back), np.concatenate(starts)
        lows = [x for some in table.column("low").to_pylist() for x in some]
        ordered = sorted(set(lows))
        place = {x: k for k, x in enumerate(ordered)}
        own = np.fromiter(map(place.__getitem__, lows), "int64", len(lows))
        # Each string is read from its end to its begin, all at once; a row is met once.
        met = np.empty(size, "int64")  # the row's string, and below it the bytes from its suffix to the string's end
        left = back.astype("int64") << 1 | (before != 0)
        at_row, which, step = starts, np.arange(len(starts), dtype="int64") << 32, 0
        while len(at_row):
            met[at_row] = which + step
            there = left[at_row]
            going = (there & 1).astype(bool)
            at_row, which, step = (there >> 1)[going], which[going], step + 1
        string, behind = (met >> 32).astype("int32"), met.astype("int32")
        low = own[string]
        whole = np.zeros(len(starts), "int32")
        whole[string[before == 0]] = behind[before == 0]
        rows, block = repeated_blocks(two_bytes_on(before, back), np.nonzero(behind <= (whole - WINDOW)[string])[0].astype("int32"))
        if len(rows):
            begins = np.nonzero(np.diff(block, prepend=-1))[0]
            least = np.minimum.reduceat(low[rows], begins)
            low[rows] = np.repeat(least, np.diff(np.append(begins, len(rows))))
        own_windows = whole - WINDOW + 1
        ends = np.cumsum(own_windows)
        windows = np.empty(ends[-1], "int32")
        at_row = np.nonzero(behind >= WINDOW)[0]
        windows[(ends - own_windows + whole)[string[at_row]] - behind[at_row]] = at_row
        string, behind, low = string[windows], behind[windows], low[windows]
        first = np.ones(len(windows), bool)
        first[1:] = (string[1:] != string[:-1]) | (low[1:] != low[:-1])
        heads = np.nonzero(first)[0]
        owner = pa.array(string[heads])
        flat = {name: pa.concat_arrays([x.flatten() for x in table.column(name).chunks]).take(owner) for name in ("p1", "p2", "n", "at")}
        needed = (low[heads] != own[string[heads]]) | (flat["n"].to_numpy() > 1)
        at = flat["at"].to_numpy() + whole[string[heads]] - behind[heads]
        return pa.table({
            "p1": flat["p1"], "p2": flat["p2"], "n": flat["n"], "at": pa.array(at.astype("int32")),
            "length": pa.array(np.diff(np.append(heads, len(windows))).astype("int32")),
            "low": pa.array([ordered[k] for k in low[heads].tolist()], table.schema.field("low").type.value_type), "needed": pa.array(needed)})

    found = shards.groupBy("part").applyInArrow(run, f"p1 long, p2 long, n long, at int, length int, low {kind}, needed boolean")
    return found.filter("needed").drop("needed")


def marked(texts: DataFrame, marks) -> DataFrame:
    """The texts whose mark may be among the given ones: others need not move."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(passing(marks.value, batch.column("mark").to_numpy().view("uint64"))))

    return texts.mapInArrow(run, texts.schema)


def cut(chosen: DataFrame, with_text: bool) -> DataFrame:
    """``doc_id, mark, removed, runs, cut_sha256, kept`` of rows with the runs of windows (``spans``) that go."""
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            removed, runs, digest, kept = [], [], [], []
            spans = batch.column("spans")
            starts = spans.values.field("start").to_numpy()
            ends = starts + spans.values.field("length").to_numpy() + WINDOW - 1
            of = spans.offsets.to_numpy()
            for data, a, b in zip(batch.column("bytes").to_pylist(), of[:-1].tolist(), of[1:].tolist(), strict=True):
                n = len(data) + 1
                gone = np.cumsum(np.bincount(starts[a:b], minlength=n) - np.bincount(ends[a:b], minlength=n))[:-1] > 0
                left = np.frombuffer(data, "uint8")[~gone].tobytes()
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                ["doc_id", "mark", "removed", "runs", "cut_sha256", "kept"])

    return chosen.select("doc_id", "mark", "bytes", "spans").mapInArrow(
        run, f"doc_id {kind}, mark long, removed long, runs long, cut_sha256 string, kept binary")


def repeated_bytes(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``; ``with_text`` adds ``kept``, the bytes left.

    A byte of a text in UTF-8 goes if 50 bytes over it also start in a row with a smaller id. Null and empty texts have no bytes. A
    row without an id has no place in the order: it loses nothing and takes nothing. Rows that share an id do not take from each
    other, whatever their texts. Other columns are not read, whatever their names.
    """
    spark = small_batches(docs.sparkSession)
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).alias("doc_id"), data.alias("bytes")).withColumn("mark", F.xxhash64("bytes"))
    known = texts.filter("doc_id is not null")
    shared = spark.sparkContext.broadcast(bit_filter(shared_keys(known)))
    held = stored(pieces(known, shared), "pieces", ZSTD)
    distinct = stored(held.groupBy("p1", "p2").agg(
        F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")), "distinct", ZSTD)
    keys = stored(segment_keys(distinct), "keys", ZSTD)
    few, many = F.col("n") <= KEY_SEGMENTS, F.col("n") > KEY_SEGMENTS
    size = keys.filter(few).agg(F.sum(F.col("windows") + (WINDOW - 1) * F.col("n"))).first()[0] or 0
    several, crowded = (spark.sparkContext.broadcast(bit_filter(x)) for x in (keys, keys.filter(many)))
    others = stored(apart(distinct, several, crowded), "apart", ZSTD)
    indexed = merged(shard_transforms(distinct, several, crowded, int(size // PART_BYTES + 1)))
    alone = others.filter("bytes is null").select("p1", "p2", "n", "at", "length", "low")
    found = indexed.unionByName(alone).groupBy("p1", "p2").agg(
        F.max("n").alias("n"), F.collect_list(F.struct("at", "length", "low")).alias("found"))
    if crowded.value.any():
        found = found.unionByName(crowded_windows(others.filter("bytes is not null")))
    found = stored(found, "found", ZSTD)
    discard(distinct, keys, others)
    later = F.transform(
        F.filter("found", lambda x: x["low"] < F.col("doc_id")),
        lambda x: F.struct((F.col("start") + x["at"]).alias("start"), x["length"].alias("length")))
    spans = joined(held.select("doc_id", "mark", "start", "p1", "p2"), found, ["p1", "p2"], "n").select(
        "doc_id", "mark", later.alias("spans")).filter("size(spans) > 0")
    spans = stored(spans.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    discard(held, found)
    touched = spark.sparkContext.broadcast(bit_filter(spans.select(F.col("mark").alias("hash"))))
    losses = stored(cut(marked(known, touched).join(spans, ["doc_id", "mark"]), with_text).dropDuplicates(["doc_id", "mark"]), "losses")
    discard(spans)
    whole = texts.select("doc_id", "mark", F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("whole"),
                         *([F.col("bytes")] if with_text else []))
    out = whole.join(losses, ["doc_id", "mark"], "left").select(
        "doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).alias("n_removed"), F.coalesce("runs", F.lit(0)).alias("n_spans"),
        F.coalesce("cut_sha256", "whole").alias("kept_sha256"), *([F.coalesce("kept", "bytes").alias("kept")] if with_text else []))
    return out


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, x, unnest(range(1, length(x) - 98, 2000)) AS b FROM d WHERE length(x) >= 100),
y AS (SELECT doc_id, b, substr(x, b, 2098) AS y FROM b),
p AS (SELECT doc_id, b, y, unnest(range(1, least(2001, length(y) - 98), 2)) AS j FROM y),
g AS (SELECT doc_id, b + j - 1 AS i, md5_number(substr(y, j, 100)) AS h FROM p),
low AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g JOIN low USING (h) WHERE doc_id > low),
runs AS (SELECT doc_id, i, sum((before IS NULL OR i - before > 100)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lag(b, 1, 1) OVER w AS a, a AS b, (b - a) // 2 AS gone FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY run)),
kept AS (SELECT d.doc_id, string_agg(x[gaps.a:gaps.b - 1], '' ORDER BY gaps.a) || any_value(x[gaps_end.e:]) AS t,
    sum(gone) AS removed, count(*) AS n
  FROM gaps JOIN d USING (doc_id) JOIN (SELECT doc_id, max(b) AS e FROM spans GROUP BY doc_id) AS gaps_end USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(t, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
