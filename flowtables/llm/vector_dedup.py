"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A vector's code is the signs of its randomly rotated unit vector; its correction factor is the inner product of the code's
vector with the rotated vector. From one side's code and factor and the other side's rotated vector comes an unbiased
estimate of the cosine, with an error that shrinks as the cosine nears 1. Only pairs whose confidence bound reaches the
threshold are computed exactly, in double precision. Signs of further rotations deal the vectors into tables of buckets, so
only pairs that share a bucket are estimated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.llm.blocks import in_blocks, pairs_within, whole_groups
from flowtables.llm.components import components
from flowtables.llm.stage import stored

THRESHOLD = 0.98
#: Tables of buckets by 12 signs each: a pair at the threshold (signs agree with 0.936) meets in none once in 1,987,000 times.
TABLES, SIGNS = 24, 12
#: Standard errors that an estimate may be off: a pair at the threshold is missed about once in a million times.
ERRORS = 5.0
SEED = 70


def rotation(size: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, size]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def coded(vectors: DataFrame) -> DataFrame:
    """Adds ``code`` (signs), ``factor``, ``keys`` (bucket in each table) to rows of ``embedding``; null where it can't be compared."""

    def run(batches):
        known: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            code, factor, keys = [], [], []
            for values in batch.column("embedding").to_pylist():
                v = np.array([np.nan] if not values else [np.nan if x is None else x for x in values], "float64")
                length = np.sqrt(v @ v)
                if not np.isfinite(length) or length == 0:
                    code.append(None)
                    factor.append(None)
                    keys.append(None)
                    continue
                d = len(v)
                if d not in known:
                    known[d] = [rotation(d, SEED)] + [rotation(d, SEED + 1 + k) for k in range(-(-TABLES * SIGNS // d))]
                own, *others = known[d]
                turned = own @ (v / length)
                code.append(np.packbits(turned >= 0).tobytes())
                factor.append(float(np.abs(turned).sum() / np.sqrt(d)))
                signs = np.concatenate([m @ v >= 0 for m in others])[:TABLES * SIGNS].reshape(TABLES, SIGNS)
                keys.append((signs @ (1 << np.arange(SIGNS))).astype("int32"))
            columns = [*batch.columns, pa.array(code, pa.binary()), pa.array(factor, pa.float64()), pa.array(keys, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "code", "factor", "keys"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{fields}, code binary, factor double, keys array<int>")


def linked_rows(table: pa.Table, new: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the linked pairs of rows of vectors of one size; ``new``: where a pair of blocks begins. Each pair is
    taken in the first table only that both share."""
    block, low, high, now = (table.column(c).to_numpy() for c in ("block", "low", "high", "table"))
    n = table.num_rows
    keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(n, -1)
    unit = table.column("embedding").combine_chunks().flatten().to_numpy().astype("float64").reshape(n, -1)
    unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
    d = unit.shape[1]
    turned = unit @ rotation_of(d).T / np.sqrt(d)
    code = np.frombuffer(b"".join(table.column("code").to_pylist()), "uint8").reshape(n, -1)
    signs = np.where(np.unpackbits(code, axis=1)[:, :d], 1.0, -1.0)
    factor = table.column("factor").to_numpy()
    error = ERRORS * np.sqrt((1 - threshold**2) * np.maximum(1 - factor**2, 0) / factor**2 / max(d - 1, 1))
    left, right = [np.zeros(0, "int64")], [np.zeros(0, "int64")]

    def test(i, j):
        tried = (low[i] == high[i]) | (block[i] != block[j])
        i, j = i[tried], j[tried]
        estimate = np.einsum("ij,ij->i", turned[i], signs[j]) / factor[j]  # unbiased; off by more than the error only rarely
        near = estimate + error[j] >= threshold
        i, j = i[near], j[near]
        seen = ((keys[i] == keys[j]) & (np.arange(keys.shape[1]) < now[i][:, None])).any(axis=1)
        i, j = i[~seen], j[~seen]
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
        left.append(i[near])
        right.append(j[near])

    pairs_within(new, test)
    return np.concatenate(left), np.concatenate(right)


_ROTATIONS: dict[int, np.ndarray] = {}


def rotation_of(size: int) -> np.ndarray:
    if size not in _ROTATIONS:
        _ROTATIONS[size] = rotation(size, SEED)
    return _ROTATIONS[size]


def roots_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the smallest row that the pairs connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(members: DataFrame, threshold: float) -> DataFrame:
    """For each block ``vec_id, n_links`` (weight of the rows linked with it) and ``root``, a row it is connected with."""
    group = ["label", "dims", "table", "key", "low", "high"]

    def run(batches):
        for table in whole_groups(batches, group):
            cols = [table.column(c).to_numpy() for c in group]
            new = np.ones(table.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            dims = cols[group.index("dims")]
            edges = [0, *np.nonzero(np.diff(dims))[0] + 1, table.num_rows]
            for begin, end in zip(edges, edges[1:], strict=False):
                part = table.slice(begin, end - begin)
                i, j = linked_rows(part, new[begin:end], threshold)
                if len(i):
                    ids, weight = part.column("vec_id").to_numpy(), part.column("weight").to_numpy()
                    n = np.zeros(len(ids), "int64")
                    np.add.at(n, i, weight[j])
                    np.add.at(n, j, weight[i])
                    root = ids[roots_of(len(ids), i, j)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0]), pa.array(root[n > 0])], ["vec_id", "n_links", "root"])

    return members.mapInArrow(run, "vec_id long, n_links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors are compared when their labels are equal and not null and their sizes are equal. Null, empty and zero vectors, and
    those with null or non-finite components, are linked with nothing, and so is a row without an id (its component is null and
    it is kept). Rows repeated whole are one vector. Equal vectors are compared once, with their number as weight. Other
    columns are not read, whatever their names.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label")).distinct()
    rows = stored(rows.withColumn("same", F.xxhash64("label", "embedding")), "vectors")
    usable = rows.filter("vec_id is not null and label is not null and embedding is not null")
    alike = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"))
    reps = stored(coded(alike).filter("code is not null"), "codes")
    placed = reps.select(
        "vec_id", "label", "embedding", "weight", "code", "factor", "keys", F.size("embedding").alias("dims"), F.posexplode("keys").alias("table", "key"))
    group = ["label", "dims", "table", "key"]
    sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    found = stored(links(in_blocks(placed.join(sizes, group), group, "size", "vec_id"), threshold), "links")
    joined = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("vec_id").agg(F.sum("n_links").alias("others"))
    classes = reps.select("vec_id", "label", "embedding", "weight").join(counts, "vec_id", "left").join(
        joined.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    classes = classes.select(
        F.col("label").alias("l"), F.col("embedding").alias("e"), F.xxhash64("label", "embedding").alias("h"),
        (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "vec_id").alias("c"))
    key = (F.col("same") == F.col("h")) & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")) & F.col("vec_id").isNotNull()
    return rows.join(classes, key, "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"),
        F.coalesce("c", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT *, sqrt(list_inner_product(e, e)) AS size FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND a.size > 0 AND b.size > 0 WHERE list_inner_product(a.e, b.e) / a.size / b.size >= 0.98),
reach(vec_id, r) AS (SELECT DISTINCT a, a FROM p UNION SELECT b, r FROM reach JOIN p ON reach.vec_id = a AND r < b),
c AS (SELECT vec_id, min(r) AS r FROM reach GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, least(d.vec_id, coalesce(c.r, d.vec_id)) AS component_id,
       least(d.vec_id, coalesce(c.r, d.vec_id)) = d.vec_id AS kept
FROM (SELECT DISTINCT vec_id, embedding, label FROM embeddings) d LEFT JOIN n ON n.vec_id = d.vec_id LEFT JOIN c ON c.vec_id = d.vec_id
"""
