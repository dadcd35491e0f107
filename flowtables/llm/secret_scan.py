"""Secret scans over an incremental ledger of contents (native: DataFrame functions only).

Every version of every path is addressed by the SHA-256 of its text. A ledger holds one row for each content and rule
version that has been scanned, with its spans. A run scans only contents that the ledger lacks, once each whatever the
number of paths, appends them, and joins the ledger's spans back to all paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowtables.llm.stage import new_path, stored

RULE_VERSION = "base-1"
#: kind, pattern, group whose length counts, least length; in the order that spans of one start take. A pattern's
#: matches are taken first and dropped by length then, so a short match still uses up its text.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a maximal run either way
)
LEDGER = "sha string, rule_version string, spans array<struct<start:int,kind:int,end:int>>"


def empty_ledger(spark: SparkSession) -> str:
    """The path of a new ledger."""
    path = new_path(spark, "ledger")
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def _matches(text: Column, k: int) -> Column:
    """Lengths of the text before each match, of the match and of its counted group; null where nothing matches."""
    _, pattern, group, _ = RULES[k]
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else whole
    before = F.transform(F.split(text, pattern, -1), F.length)
    found = F.zip_with(F.zip_with(before, whole, lambda b, w: F.struct(b.alias("b"), w.alias("w"))), counted,
                       lambda x, c: F.struct(x["b"].alias("before"), x["w"].alias("whole"), c.alias("counted")))
    return F.when(text.rlike(pattern), F.struct(F.lit(k).alias("kind"), F.slice(found, 1, F.size(whole)).alias("found")))


def spans_of(blobs: DataFrame) -> DataFrame:
    """``sha, spans`` of every row of ``sha, text``, spans by start, then kind; positions are code points, ends exclusive."""
    kinds = blobs.select("sha", F.array_compact(F.array(*[_matches(F.col("text"), k) for k in range(len(RULES))])).alias("kinds"))
    # Of explode() the optimiser infers that kinds must hold something, and asks that of every text before the ledger is
    # consulted; explode_outer() leaves the patterns to the texts that are left.
    each = (
        kinds.select("sha", F.explode_outer("kinds").alias("x")).filter("x is not null")
        .select("sha", "x.kind", F.posexplode("x.found").alias("n", "m"))
        .select("sha", "kind", "n", "m.*"))
    order = Window.partitionBy("sha", "kind").orderBy("n")
    end = F.sum(F.col("before") + F.col("whole")).over(order).cast("int")
    least = F.element_at(F.array(*[F.lit(r[3]) for r in RULES]), F.col("kind") + 1)
    kept = each.withColumn("end", end).filter(F.col("counted") >= least).select(
        "sha", F.struct((F.col("end") - F.col("whole")).alias("start"), "kind", "end").alias("span"))
    found = kept.groupBy("sha").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    return blobs.select("sha").join(found, "sha", "left").select(
        "sha", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("spans"))


def scan(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, ``sha`` and ``spans`` (``start, kind, end``; kind is a place in ``RULES``).

    Contents that the ledger lacks for this rule version are scanned and appended. Null texts are empty and have no span;
    rows without an id or repeated are scanned like others; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    paths = stored(texts.select("doc_id", "sha"), "paths")
    seen = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rule_version") == RULE_VERSION)
    unseen = (
        paths.groupBy("sha").agg(F.min("doc_id").alias("at_id"))
        .join(seen.select("sha"), "sha", "left_anti").withColumnRenamed("sha", "at_sha"))
    first = texts.join(unseen, (F.col("sha") == F.col("at_sha")) & F.col("doc_id").eqNullSafe(F.col("at_id")), "left_semi")
    fresh = spans_of(first.select("sha", "text")).dropDuplicates(["sha"])
    fresh.select("sha", F.lit(RULE_VERSION).alias("rule_version"), "spans").write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger).filter((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0))
    known = known.select("sha", "spans").dropDuplicates(["sha"])
    return paths.join(known, "sha", "left").select(
        "doc_id", "sha", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts by kind, the spans as text and their digest."""
    names = F.array(*[F.lit(r[0]) for r in RULES])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(k):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{RULES[k][0]}")

    return found.withColumn("listed", text).select(
        "doc_id", *map(count, range(len(RULES))), F.sha2(F.col("listed").cast("binary"), 256).alias("base_sha256"), F.col("listed").alias("spans"))


def redact(docs: DataFrame, ledger: str) -> DataFrame:
    """``documents`` with every secret's characters replaced by ``[SECRET]``; all rows and columns stay.

    Overlapping spans are replaced once. ``n_chars`` is made to fit where the table has it.
    """
    found = scan(docs, ledger).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "sha"])
    found = found.select(F.col("doc_id").alias("at_id"), F.col("sha").alias("at_sha"), "spans")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    cut = F.aggregate("spans", start, lambda a, s: F.struct(
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(F.col("_t.text"), a["at"] + 1, s["start"] - a["at"]), F.lit("[SECRET]")))
        .otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_t"))  # no column can clash
    joined = rows.join(
        found, F.col("_t.doc_id").eqNullSafe(F.col("at_id"))
        & (F.sha2(F.coalesce(F.col("_t.text"), F.lit("")).cast("binary"), 256) == F.col("at_sha")), "left")
    joined = joined.withColumn("_cut", F.when(F.col("spans").isNotNull(), cut))
    clean = F.when(F.col("_cut").isNull(), F.col("_t.text")).otherwise(
        F.concat("_cut.out", F.substring(F.col("_t.text"), F.col("_cut.at") + 1, F.length("_t.text"))))
    chars = F.when(F.col("_cut").isNull(), F.col("_t.n_chars")).otherwise(F.length(clean)) if "n_chars" in docs.columns else None
    new = {"text": clean, "n_chars": chars}
    return joined.select(*[new.get(c, F.col(f"_t.`{c}`")).alias(c) for c in docs.columns])


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
rules(k, kind, pat, grp, least) AS (VALUES
  (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]+', 0, 24)),
lists AS (
  SELECT doc_id, k, kind, least,
         CASE k WHEN 0 THEN regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0)
                WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) ELSE regexp_extract_all(t, '[0-9a-f]+', 0) END AS whole,
         CASE k WHEN 0 THEN regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)
                WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) ELSE regexp_extract_all(t, '[0-9a-f]+', 0) END AS counted,
         string_split_regex(t, pat) AS before
  FROM d, rules),
each AS (
  SELECT doc_id, k, kind, least, unnest(whole) AS w, unnest(counted) AS c, unnest(before[1:len(whole)]) AS b,
         generate_subscripts(whole, 1) AS n FROM lists WHERE len(whole) > 0),
ends AS (
  SELECT doc_id, k, kind, least, length(w) AS lw, length(c) AS lc,
         sum(length(b) + length(w)) OVER (PARTITION BY doc_id, k ORDER BY n) AS e FROM each),
kept AS (SELECT doc_id, k, kind, (e - lw)::BIGINT AS s, e::BIGINT AS e FROM ends WHERE lc >= least),
agg AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (doc_id)
"""
