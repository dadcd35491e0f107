"""Near-duplicate documents: MinHash bands find candidates, full shingle sets confirm them, components join them.

Equal sets are one node from the start. In each bucket of a band the nodes are first confirmed against the one whose
signature is nearest to what most have. Where that leaves a bucket in several components, the pairs between components are
compared by signature and set, in blocks inside tasks, and only links leave these. So a large group of near copies moves
its size, not its square, and no pair that shares a band is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.llm.blocks import in_blocks, pairs_within, whole_groups
from flowtables.llm.components import components
from flowtables.llm.stage import free_name, new_path, scaffolding, small_batches, stored, written
from flowtables.llm.words import WordHashes, mixed, odd_numbers, window_hashes

WIDTH = 5
NUMERATOR, DENOMINATOR = 75, 100
#: 32 bands of 4 minima: a pair at the threshold shares no band once in 190,000 times.
BANDS, ROWS = 32, 4
#: Of 128 minima, a pair at the threshold agrees in fewer than this once in ten million times.
LEAST_AGREEING = 70
SEED = 50


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The document's set, as sorted 64-bit hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "uint64")
    h = hashes(words)
    width = min(WIDTH, len(h))  # fewer words: the whole sequence, which no other width can equal
    return np.unique(window_hashes(h, np.arange(len(h) - width + 1), width, SEED + width))


def minima(sets: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash over the set."""
    short = (sets >> np.uint64(32)).astype("uint32")
    out = np.full(len(factors), 2**32 - 1, "uint32")
    for k in range(0, len(short), 512):
        out = np.minimum(out, (short[k:k + 512, None] * factors + shifts).min(axis=0))
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, h1, h2`` (a 128-bit hash of the set), ``keys`` (a hash for each band), ``sketch`` of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        hashes = WordHashes()
        random = np.random.default_rng(SEED)
        factors = random.integers(0, 2**31, BANDS * ROWS, "uint32") * np.uint32(2) + np.uint32(1)
        shifts = random.integers(0, 2**32, BANDS * ROWS, "uint32")
        spread = odd_numbers(ROWS, SEED + 100)
        for batch in batches:
            n, h1, h2, keys, sketch = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, hashes)
                n.append(len(found))
                h1.append(int(found.sum().view("int64")))
                h2.append(int(mixed(found).sum().view("int64")))
                least = minima(found, factors, shifts)
                bands = mixed((least.reshape(BANDS, ROWS).astype("uint64") * spread).sum(axis=1))
                keys.append(bands.view("int64") if len(found) else [])
                sketch.append((least & 255).astype("uint8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "n_shingles", "h1", "h2", "keys", "sketch"])

    schema = f"doc_id {kind}, n_shingles long, h1 long, h2 long, keys array<long>, sketch binary"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, set, short`` (64-bit hashes, and their upper halves) of the documents whose ids are given."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(ids, "doc_id", "left_semi")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(text, hashes) for text in batch.column(1).to_pylist()]
            short = [(s >> np.uint64(32)).astype("uint32").tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(short, pa.binary())], ["doc_id", "set", "short"])

    return chosen.mapInArrow(run, f"doc_id {kind}, set binary, short binary").dropDuplicates(["doc_id"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("s")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("set").alias("t")), "b").select("a", "b", "s", "t")

    def run(batches):
        for batch in batches:
            keep = []
            for s, t in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True):
                s, t = np.frombuffer(s, "uint64"), np.frombuffer(t, "uint64")
                both = np.concatenate([s, t])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(DENOMINATOR * common >= NUMERATOR * (len(s) + len(t) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return joined.mapInArrow(run, pairs.select("a", "b").schema)


GROUP = ["band", "key", "low", "high"]


def _alike(rows: DataFrame, chosen, schema) -> DataFrame:
    """Different pairs (``a > b``) of the row pairs that ``chosen(new, table, sketch)`` gives; ``new``: where a group begins."""

    def run(batches):
        for table in whole_groups(batches, GROUP):
            ids = table.column("doc_id").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "uint8").reshape(-1, BANDS * ROWS)
            new = np.ones(len(ids), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in (table.column(g).to_numpy() for g in GROUP)], axis=0)
            i, j = chosen(new, table, sketch)
            if len(i):
                i, j = ids[i], ids[j]
                found = np.unique(np.stack([np.maximum(i, j), np.minimum(i, j)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return rows.mapInArrow(run, schema).distinct()


def to_centers(members: DataFrame, sketches: DataFrame, schema) -> DataFrame:
    """Every bucket's members with the one whose signature is nearest to what most of them have, where both look alike."""

    def chosen(new, table, sketch):
        begins = [*np.nonzero(new)[0], len(new)]
        columns = np.arange(sketch.shape[1]) * 256
        pairs = []
        for begin, end in zip(begins, begins[1:], strict=False):
            own = sketch[begin:end]
            common = np.bincount((own + columns).ravel(), minlength=len(columns) * 256).reshape(-1, 256).argmax(axis=1) if end - begin > 2 else own[0]
            center = (own == common).sum(axis=1).argmax()
            alike = np.nonzero((own == own[center]).sum(axis=1) >= LEAST_AGREEING)[0]
            alike = alike[alike != center] + begin
            pairs.append((alike, np.full(len(alike), center + begin)))
        return (np.concatenate(x) for x in zip(*pairs, strict=True))

    rows = members.join(sketches.select("doc_id", "sketch"), "doc_id").select("band", "key", "doc_id", "sketch", "size")
    return _alike(in_blocks(rows, ["band", "key"], "size", "doc_id"), lambda *x: tuple(chosen(*x)), schema)


def between_components(members: DataFrame, sketches: DataFrame, sets: DataFrame, schema) -> DataFrame:
    """All pairs of one bucket but different components whose signatures agree often enough and whose sets are similar enough,
    as far as half of each hash can tell. Each pair is tried in the first band only that both share."""
    several = members.groupBy("band", "key").agg(F.min("component").alias("low_c"), F.max("component").alias("high_c"))
    several = several.filter("low_c <> high_c").select("band", "key")
    rows = members.join(several, ["band", "key"], "left_semi").join(sketches.select("doc_id", "sketch", "keys"), "doc_id").join(
        sets.select("doc_id", "short"), "doc_id").select("band", "key", "doc_id", "component", "sketch", "keys", "short", "size")

    def chosen(new, table, sketch):
        component, block, band, low, high = (table.column(c).to_numpy() for c in ("component", "block", "band", "low", "high"))
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        short = table.column("short").to_pylist()
        sizes = np.array([len(x) // 4 for x in short])
        first, second = [np.zeros(0, "int64")], [np.zeros(0, "int64")]

        def test(i, j):
            tried = (component[i] != component[j]) & ((low[i] == high[i]) | (block[i] != block[j]))
            tried &= DENOMINATOR * np.minimum(sizes[i], sizes[j]) >= NUMERATOR * np.maximum(sizes[i], sizes[j])
            i, j = i[tried], j[tried]
            alike = (sketch[i] == sketch[j]).sum(axis=1) >= LEAST_AGREEING
            i, j = i[alike], j[alike]
            alike = ~((keys[i] == keys[j]) & (np.arange(BANDS) < band[i][:, None])).any(axis=1)
            first.append(i[alike])
            second.append(j[alike])

        pairs_within(new, test)
        i, j = np.concatenate(first), np.concatenate(second)
        if not len(i):
            return i, j
        used = np.unique(np.concatenate([i, j]))
        at = np.zeros(len(sizes), "int64")
        at[used] = np.arange(len(used))
        values, numbers = np.unique(np.concatenate([np.frombuffer(short[k], "uint32") for k in used]), return_inverse=True)
        parts = np.split(numbers, np.cumsum(sizes[used])[:-1])
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        keep = []
        has = np.zeros(len(values), bool)
        for run in np.split(np.arange(len(i)), np.nonzero(np.diff(i))[0] + 1):  # all partners of one row at once
            own, others = parts[at[i[run[0]]]], j[run]
            has[own] = True
            lengths = sizes[others]
            common = np.add.reduceat(has[np.concatenate([parts[at[k]] for k in others])].astype("int64"), np.cumsum(lengths) - lengths)
            has[own] = False
            keep.append(DENOMINATOR * common >= NUMERATOR * (sizes[i[run]] + lengths - common))
        keep = np.concatenate(keep)
        return i[keep], j[keep]

    return _alike(in_blocks(rows, ["band", "key"], "size", "doc_id"), chosen, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Ids are integers. Words are runs without ``[\\x20\\x09-\\x0D]``, A-Z in lower case; the set of a document is its distinct
    runs of five words, or its whole sequence if it has fewer. Null, empty and blank texts have an empty set and are linked
    with nothing, and so is a row without an id (its component is null and it is kept). Rows repeated with their id are one
    document. Other columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    signed = stored(signatures(docs, id_col, text_col), "signatures")
    filled = signed.filter("n_shingles > 0 and doc_id is not null")
    same = filled.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = stored(
        filled.join(same.select("h1", "h2", F.col("rep").alias("doc_id")), ["h1", "h2", "doc_id"], "left_semi")
        .select("doc_id", "keys", "sketch").dropDuplicates(["doc_id"]), "reps")
    banded = reps.select("doc_id", F.posexplode("keys").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(banded.join(shared, ["band", "key"]), "members")
    sets = stored(full_sets(docs, members.select("doc_id").distinct(), id_col, text_col), "sets")
    links = docs.select(F.col(id_col).alias("a"), F.col(id_col).alias("b")).schema
    centered = to_centers(members, reps, links)
    joined = components(stored(confirmed(centered, sets), "links"))
    labelled = members.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id"))
    more = stored(confirmed(between_components(labelled, reps, sets, links), sets), "links")
    found = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    classes = same.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("component_id"))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    key = [signed["h1"] == classes["h1"], signed["h2"] == classes["h2"], signed["n_shingles"] == classes["n"]]
    return signed.join(classes, key, "left").select(
        "doc_id", "n_shingles", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    ).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``documents`` with one row of each group of near copies, that with the smallest id (none comes last); all columns stay.

    The decision is by row, so rows that share an id or have none are compared and kept or dropped each by its own text.
    """
    row = free_name(docs, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows", "zstd")
    gone = free_name(rows, "gone")
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "gone")
    with scaffolding(spark):  # of all that the search writes, only the rows to drop are wanted
        found = near_duplicates(rows, id_col=row).join(rows.select(F.col(row).alias("doc_id"), F.col("doc_id").alias("id")), "doc_id")
        place = F.struct(F.col("id").isNull(), "id", "doc_id")
        groups = stored(found.select("component_id", "doc_id", "id"), "groups")
        several = groups.groupBy("component_id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        dropped = groups.join(several, "component_id").filter(F.col("doc_id") != F.col("first.doc_id"))
        dropped = written(dropped.select(F.col("doc_id").alias(gone)), path)
    return rows.join(dropped, F.col(row) == F.col(gone), "left_anti").drop(row)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, r) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT b, r FROM reach JOIN both_ways ON reach.doc_id = a AND r < b),
c AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.r, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(c.r, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
