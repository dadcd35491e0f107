"""Class tables: Parquet by authority, dataclass, layer and period (``dt``), sorted by id and time; a commit log names the layers.

``dt`` is the day for live classes and the first day of the year for static ones, which change rarely. Layers hold records
(``v-``) or the fields that small batches gave (``d-``), which reads put over the records until they are compacted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtables.catalog import RecordClass, authority, record_class
from flowtables.functions import fieldtext
from flowtables.functions.timecols import instant_literal, iso_text
from flowtables.operators import upsert
from flowtables.sources import commits
from flowtables.sources.commits import CommitLog, Conflict, Manifest
from flowtables.sources.scratch import remove, scratch_path

DELTA = "id string, time timestamp, fields map<string,string>"


def period(cls: RecordClass, time: Column) -> Column:
    return F.to_date(time) if cls.is_live else F.trunc(time, "year")


def log_of(spark: SparkSession, root: str, authority_name: str, dataclass: str) -> CommitLog:
    return CommitLog(spark, f"{root.rstrip('/')}/authority={authority(authority_name)}/dataclass={dataclass}")


def scan(spark: SparkSession, root: str, authority_name: str, dataclass: str, *, since=None, until=None) -> DataFrame:
    """One class of one authority; with ``since`` and ``until`` only the periods that can hold such times.

    Only the folders of those periods are listed, as the newest manifest names them. The exact time filter is the reader's. A class that was
    never written is empty.
    """
    cls = record_class(dataclass)
    log = log_of(spark, root, authority_name, dataclass)
    ends = _ends(spark, cls, since, until)
    rows = _layers(spark, log, cls, log.latest().since(*ends))
    for end, inside in zip(ends, (F.col("dt").__ge__, F.col("dt").__le__), strict=True):
        rows = rows if end is None else rows.where(inside(F.lit(end).cast("date")))
    return rows


def _ends(spark: SparkSession, cls: RecordClass, *times) -> list[str | None]:
    one = spark.sql("SELECT 1")
    return [None if x is None else str(one.select(period(cls, instant_literal(x))).first()[0]) for x in times]


def _layers(spark: SparkSession, log: CommitLog, cls: RecordClass, periods: dict[str, list[str]], files=None) -> DataFrame:
    """The records of the periods: plain reads, and a merge by key of those periods alone that have given fields on top.

    ``files``: of each layer and period the only files to read.
    """
    plain = {day: layers for day, layers in periods.items() if not any(layer.startswith("d-") for layer in layers)}
    mixed = {day: layers for day, layers in periods.items() if day not in plain}
    rows = _read(spark, log, cls.schema, plain, "v-", files).drop("layer")
    if not mixed:
        return rows
    order = list(dict.fromkeys(layer for layers in mixed.values() for layer in layers if layer.startswith("d-")))
    given = _read(spark, log, DELTA, mixed, "d-")
    place = F.create_map(*[F.lit(x) for k, layer in enumerate(_in_commit_order(mixed, order)) for x in (layer, k)])
    base = _read(spark, log, cls.schema, mixed, "v-", files).drop("layer", "dt")
    merged = upsert.merge_layers(base, given.withColumn("seq", place[F.col("layer")]), cls)
    return rows.unionByName(merged.withColumn("dt", period(cls, F.col(cls.time_field))))


def _in_commit_order(periods: dict[str, list[str]], layers: list[str]) -> list[str]:
    """Each layer's place among those committed before and after it: a layer follows all that lie under it in any period."""
    depth = dict.fromkeys(layers, 0)
    for _ in layers:
        moved = False
        for day in periods.values():
            for under, over in zip(day, day[1:], strict=False):
                if over in depth and depth[over] <= depth.get(under, -1):
                    depth[over], moved = depth.get(under, -1) + 1, True
        if not moved:
            break
    return sorted(layers, key=depth.__getitem__)


def _read(spark: SparkSession, log: CommitLog, schema: str, periods: dict[str, list[str]], kind: str, files=None) -> DataFrame:
    pairs = [(layer, day) for day, layers in periods.items() for layer in layers if layer.startswith(kind)]
    if files is None:
        paths = [log.layer_path(*pair) for pair in pairs]
    else:
        paths = [f"{log.layer_path(*pair)}/{name}" for pair in pairs for name in files.get(pair, ())]
    schema = f"{schema}, layer string, dt date"
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", log.folder).parquet(*paths)


def read_external(spark: SparkSession, source: str, **options) -> DataFrame:
    """A table behind any Spark connector on the class path."""
    return spark.read.format(source).options(**options).load()


def write_layer(rows: DataFrame, log: CommitLog, cls: RecordClass, kind: str, key: tuple[str, str]) -> tuple[str, list[str]]:
    """Write a layer that no manifest names yet: its name and its periods.

    Range partitioning on (period, id, time): even files, tight min/max, no hot task for a hot id.
    """
    layer = log.new_layer(kind)
    order = ("dt", *key)
    dated = rows.withColumn("dt", period(cls, F.col(key[1])))
    dated.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("dt").parquet(log.layer_path(layer))
    written = log.periods_of(layer)
    if kind == "v" and written:
        _index_keys(rows.sparkSession, log, layer, key[0])
    return layer, written


def _index_keys(spark: SparkSession, log: CommitLog, layer: str, id_field: str) -> None:
    """Beside a layer's data, the ids that each of its files holds: as many rows as detectors a day, not as readings."""
    data = spark.read.schema(f"`{id_field}` string, dt date").parquet(log.layer_path(layer))
    held = data.groupBy(F.col(id_field).alias("id"), "dt", F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    held.sortWithinPartitions("id").write.parquet(f"{log.layer_path(layer)}/_keys")


def scan_ids(spark: SparkSession, root: str, authority_name: str, dataclass: str, ids: DataFrame, *, since=None, until=None) -> DataFrame:
    """The records of the ids in ``ids`` (column ``id``), reading only files that hold one of them.

    The key index beside each layer says which; the driver gets the names of those files, as for any read. Fields given on top and
    not yet compacted are always read. The semi join is exact, whatever the index lets through.
    """
    cls = record_class(dataclass)
    log = log_of(spark, root, authority_name, dataclass)
    periods = log.latest().since(*_ends(spark, cls, since, until))
    wanted = ids.select(F.col("id").alias(cls.id_field)).distinct()
    layers = {layer for held in periods.values() for layer in held if layer.startswith("v-")}
    if not layers:
        return _layers(spark, log, cls, periods).join(wanted, cls.id_field, "left_semi")
    keys = spark.read.schema("id string, dt date, file string").parquet(*[f"{log.layer_path(layer)}/_keys" for layer in sorted(layers)])
    keys = keys.withColumn("layer", F.regexp_extract("_metadata.file_path", "layer=([^/]+)/", 1)).join(wanted, F.col("id") == F.col(cls.id_field), "left_semi")
    files = {(row.layer, str(row.dt), row.file) for row in keys.select("layer", "dt", "file").distinct().collect()}
    held: dict[tuple[str, str], list[str]] = {}
    for layer, day, file in sorted(files):
        held.setdefault((layer, day), []).append(file)
    return _layers(spark, log, cls, periods, held).join(wanted, cls.id_field, "left_semi")


def write(table: DataFrame, root: str, cls: RecordClass) -> None:
    """Add records whose keys the table lacks: ``table`` has the class columns and ``authority``. Nothing is read or compared."""
    names = [row.authority for row in table.select("authority").distinct().collect()]  # three at most
    for name in names:
        log = log_of(table.sparkSession, root, name, cls.name)
        layer, written = write_layer(table.where(F.col("authority") == name).drop("authority"), log, cls, "v", cls.key)
        log.commit(lambda old, layer=layer, written=written: commits.added(old, layer, written))


def _reduced(batch: DataFrame) -> tuple[DataFrame, str]:
    """The batch's accepted records as one row a key, written once: retries must not read a source that may change."""
    path = scratch_path(batch.sparkSession, "batch")
    upsert.last_fields(upsert.accepted(batch)).write.parquet(path)
    return batch.sparkSession.read.schema(DELTA).parquet(path), path


def _touched(batch: DataFrame, cls: RecordClass) -> list[str]:
    """Periods of the batch. The driver gets the dates: one a day or year of history, whatever the rows."""
    return sorted(str(row.dt) for row in batch.select(period(cls, F.col("time")).alias("dt")).distinct().collect())


def _until_committed(log: CommitLog, days: list[str], rewrite) -> None:
    """Runs ``rewrite(read, read_layers)`` and its commit until no other writer came between reading and committing."""
    for _ in range(commits.ATTEMPTS):
        read = {day: log.latest().periods.get(day, []) for day in days}
        layer, written, change = rewrite(read)
        try:
            log.commit(lambda old, read=read, layer=layer, written=written, change=change: change(old, read, layer, written))
            return
        except Conflict:
            log.remove_layer(layer)
    raise Conflict(f"no commit to {log.folder} after {commits.ATTEMPTS} attempts")


def upsert_into(spark: SparkSession, root: str, authority_name: str, dataclass: str, batch: DataFrame) -> None:
    """Upsert a keyed batch into the table, rewriting only the periods the batch touches.

    The merged periods become a new layer, which a commit puts in the place of those that were read. Killed before it, the job has
    changed nothing; where another writer was first, the merge is done again over what it left. So all given fields arrive.
    """
    cls = record_class(dataclass)
    log = log_of(spark, root, authority_name, dataclass)
    given, path = _reduced(batch)
    days = _touched(given, cls)

    def rewrite(read):
        target = _layers(spark, log, cls, {day: layers for day, layers in read.items() if layers}).drop("dt")
        merged = upsert.merge_typed(target, given.withColumn("seq", F.lit(0)), cls)
        return *write_layer(merged, log, cls, "v", cls.key), _exactly

    if days:
        _until_committed(log, days, rewrite)
    remove(spark, path)


def _exactly(old: Manifest, read: dict[str, list[str]], layer: str, written: list[str]) -> Manifest:
    commits.unchanged(old, read)
    return commits.replaced(old, read, layer, written)


def upsert_delta(spark: SparkSession, root: str, authority_name: str, dataclass: str, batch: DataFrame, *,
                 stream: str | None = None, batch_no: int = 0) -> None:
    """Upsert a small keyed batch by writing only what it gives: a layer of fields on top of the periods it touches.

    Commits of this kind never conflict: the order of commits is the order in which fields win. With ``stream``, a batch whose number is not
    above the stream's last one has been applied before and is left out.
    """
    cls = record_class(dataclass)
    log = log_of(spark, root, authority_name, dataclass)

    def applied(manifest: Manifest) -> bool:
        return stream is not None and manifest.streams.get(stream, -1) >= batch_no

    if applied(log.latest()):
        return
    given = upsert.last_fields(upsert.accepted(batch))
    layer, written = write_layer(given, log, cls, "d", ("id", "time"))

    def change(old: Manifest) -> Manifest | None:
        if applied(old):
            return None
        new = commits.added(old, layer, written)
        return new if stream is None else Manifest(new.version, new.periods, new.streams | {stream: batch_no})

    log.commit(change)


def compact(spark: SparkSession, root: str, authority_name: str, dataclass: str, *, most_layers: int = 1) -> list[str]:
    """Rewrite every period with more than ``most_layers`` layers as one layer of records; returns those periods.

    Layers that others commit meanwhile stay on top of the new one.
    """
    cls = record_class(dataclass)
    log = log_of(spark, root, authority_name, dataclass)
    days = [day for day, layers in log.latest().periods.items() if len(layers) > most_layers or layers[0].startswith("d-")]

    def rewrite(read):
        rows = _layers(spark, log, cls, {day: layers for day, layers in read.items() if layers}).drop("dt")
        return *write_layer(rows, log, cls, "v", cls.key), commits.replaced

    if days:
        _until_committed(log, days, rewrite)
    return days


def append_new(spark: SparkSession, root: str, authority_name: str, dataclass: str, batch: DataFrame) -> None:
    """Insert-if-absent: records whose key the table lacks. Only the periods that the batch touches are read.

    Of two writers that bring the same key at once the second sees the first's: keys stay unique.
    """
    cls = record_class(dataclass)
    log = log_of(spark, root, authority_name, dataclass)
    path = scratch_path(spark, "batch")
    first = upsert.accepted(batch).groupBy("id", "time").agg(F.min_by("fields", "seq").alias("fields"))
    first.write.parquet(path)
    given = spark.read.schema(DELTA).parquet(path).withColumn("seq", F.lit(0))
    days = _touched(given, cls)

    def rewrite(read):
        target = _layers(spark, log, cls, {day: layers for day, layers in read.items() if layers})
        keys = target.select(F.col(cls.id_field).alias("id"), F.col(cls.time_field).alias("time"))
        fresh = upsert.new_only(keys, given).withColumn("seq", F.lit(0))
        rows = upsert.merge_typed(spark.createDataFrame([], cls.schema), fresh, cls)

        def change(old, read, layer, written):
            commits.unchanged(old, read)
            return commits.added(old, layer, written)

        return *write_layer(rows, log, cls, "v", cls.key), change

    if days:
        _until_committed(log, days, rewrite)
    remove(spark, path)


def vacuum(spark: SparkSession, root: str, authority_name: str, dataclass: str, **limits) -> list[str]:
    """Delete layers that no recent manifest names (see :meth:`CommitLog.vacuum`)."""
    return log_of(spark, root, authority_name, dataclass).vacuum(**limits)


def json_rows(table: DataFrame, *times: str) -> DataFrame:
    """Each row as JSON text with times in local ISO form; null fields are left out.

    The fields in ``extra`` stand beside the others, as the record had them; a nested field that is there whole stands for its
    typed column. Numbers come back as numbers and texts as texts.
    """
    shown = table
    for name in times:
        shown = shown.withColumn(name, iso_text(F.col(name)))
    if dict(table.dtypes).get("extra") != "map<string,string>":
        return shown.select(F.to_json(F.struct("*")).alias("json"))
    extra = F.coalesce("extra", F.create_map().cast("map<string,string>"))
    own = F.to_json(F.struct(*[F.when(~F.map_contains_key(extra, name), F.col(name)).alias(name) for name in shown.columns if name != "extra"]))
    rest = _extra_json(extra)
    comma = F.when((own == "{}") | (rest == "{}"), "").otherwise(",")
    return shown.select(F.concat(F.substr(own, F.lit(1), F.length(own) - 1), comma, F.substr(rest, F.lit(2))).alias("json"))


def xml_rows(table: DataFrame, row_tag: str, *times: str) -> DataFrame:
    """Each row as an XML element. The fields in ``extra`` follow as elements of their own; a nested field that is there
    whole stands for its typed column."""
    shown = table
    for name in times:
        shown = shown.withColumn(name, iso_text(F.col(name)))
    options = {"rowTag": row_tag, "nullValue": ""}
    if dict(table.dtypes).get("extra") != "map<string,string>":
        return shown.select(F.to_xml(F.struct("*"), options).alias("xml"))
    own = [name for name in shown.columns if name != "extra"]
    parts = []
    for name in own:
        part = _inner(F.to_xml(F.struct(name), options), row_tag)
        parts.append(F.when(F.coalesce(F.map_contains_key("extra", name), F.lit(False)), "").otherwise(part))
    rest = _inner(F.to_xml(F.try_parse_json(_extra_json(F.col("extra"))), options | {"attributePrefix": "@", "valueTag": "#text"}), row_tag)
    return shown.select(F.concat(
        F.lit(f"<{row_tag}>"), *parts, F.coalesce(rest, F.lit("")), F.lit(f"\n</{row_tag}>")).alias("xml"))


def _inner(xml: Column, row_tag: str) -> Column:
    """What stands between the tags of the row."""
    return F.regexp_replace(xml, rf"(?s)^\s*<{row_tag}\s*/>\s*$|^\s*<{row_tag}>|\s*</{row_tag}>\s*$", "")


def _extra_json(extra: Column) -> Column:
    def member(entry):
        text = F.to_json(F.create_map(entry["key"], entry["value"]), {"ignoreNullFields": "false"})
        key = F.to_json(F.create_map(entry["key"], F.lit(0)))
        return F.when(fieldtext.is_json(entry["value"]), F.concat(F.substr(key, F.lit(2), F.length(key) - 3), entry["value"])).otherwise(
            F.substr(text, F.lit(2), F.length(text) - 2))

    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(extra), member), ","), F.lit("}"))
