"""Keyed, field-level upsert: given fields replace, absent fields stay, nested values replace whole.

A batch is reduced to one row per key with partial aggregates keyed by (key, field) before it meets the
target, so the target is shuffled once and never exploded, and a key repeated through most of a batch
is combined on the map side.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtables.catalog import RecordClass
from flowtables.functions import fieldtext
from flowtables.functions.timecols import instant_literal, parse_iso

KEY = ("id", "time")


def _put(fields: Column, name: str, value: Column) -> Column:
    kept = F.map_filter(fields, lambda k, _: k != name)
    return F.map_concat(kept, F.create_map(F.lit(name), value))


def key_batch(records: DataFrame, cls: RecordClass) -> DataFrame:
    """Batch records keyed by (id, DataCollectTime), else (id, UpdateTime), else (id, header time).

    The header time is put into records that carry no time of their own.
    """
    fields = F.col("fields")
    timeless = ~F.map_contains_key(fields, "DataCollectTime") & ~F.map_contains_key(fields, "UpdateTime")
    stamped = F.when(timeless, _put(fields, "UpdateTime", F.col("header"))).otherwise(fields)
    return _keyed(records.withColumn("fields", stamped), cls)


def key_live(records: DataFrame, cls: RecordClass) -> DataFrame:
    """Single live records: DataCollectTime when present, otherwise UpdateTime."""
    return _keyed(records, cls)


def key_static(records: DataFrame, cls: RecordClass, date: str | datetime) -> DataFrame:
    """Single static records: UpdateTime is the caller's date."""
    text = F.date_format(instant_literal(date), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return _keyed(records.withColumn("fields", _put(F.col("fields"), "UpdateTime", text)), cls, F.lit("UpdateTime"))


def _keyed(records: DataFrame, cls: RecordClass, time_field: Column | None = None) -> DataFrame:
    fields = F.col("fields")
    own = F.when(F.map_contains_key(fields, "DataCollectTime"), F.lit("DataCollectTime")).otherwise(F.lit("UpdateTime"))
    return records.withColumn("time_field", own if time_field is None else time_field).select(
        fieldtext.plain(fields[cls.id_field]).alias("id"), parse_iso(fieldtext.plain(F.element_at(fields, F.col("time_field")))).alias("time"),
        "time_field", "fields", "seq")


def accepted(keyed: DataFrame) -> DataFrame:
    return keyed.where(F.col("id").isNotNull() & F.col("time").isNotNull())


def rejected(keyed: DataFrame) -> DataFrame:
    """Records that cannot be keyed, with the reason."""
    reason = F.when(F.col("id").isNull(), F.lit("no id")).otherwise(F.lit("no time"))
    return keyed.where(F.col("id").isNull() | F.col("time").isNull()).withColumn("reason", reason)


def last_fields(batch: DataFrame) -> DataFrame:
    """One row per key: for every field given anywhere in the batch, the value given last."""
    # Not an inner explode: the optimizer would filter on the map's size, and so make the map twice.
    entries = batch.select(*KEY, "seq", F.explode_outer("fields").alias("field", "value")).where("field IS NOT NULL")
    last = entries.groupBy(*KEY, "field").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))


def overlay(old: Column, new: Column) -> Column:
    """Map ``old`` with the entries of ``new`` put over it; either may be null."""
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def merge_fields(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert into a key-unique target of (id, time, fields)."""
    given = last_fields(batch).withColumnRenamed("fields", "given")
    return target.select(*KEY, "fields").join(given, list(KEY), "full").select(
        *KEY, overlay(F.col("fields"), F.col("given")).alias("fields"))


def _typed(text: Column, kind: str) -> Column:
    if kind == "string":
        return fieldtext.plain(text)
    if kind == "timestamp":
        return parse_iso(fieldtext.plain(text))
    if kind.startswith(("array", "map", "struct")):
        # Numbers arrive quoted or not; read them as text, then cast each where it can be.
        return F.from_json(text, _texts(kind)).try_cast(kind)
    return fieldtext.plain(text).try_cast(kind)


def _texts(kind: str) -> str:
    return kind.replace(":double", ":string").replace(":bigint", ":string")


def _holds_more(text: Column, kind: str) -> Column:
    """Whether a nested field's JSON has anything that its declared type does not hold."""
    plain = lambda x: F.replace(F.to_json(F.try_parse_json(x)), F.lit('"'), F.lit(""))
    return text.isNotNull() & ~plain(text).eqNullSafe(plain(F.to_json(F.from_json(text, _texts(kind)))))


def merge_typed(target: DataFrame, batch: DataFrame, cls: RecordClass) -> DataFrame:
    """Upsert into the class's columnar table: a column changes only where the batch gives its field.

    Reads never tell a null field from an absent one, so the table needs no presence marks; the batch does.
    """
    id_field, time_field = cls.key
    given = last_fields(batch).select(F.col("id").alias(id_field), F.col("time").alias(time_field), F.col("fields").alias("_given"))
    return target.join(given, list(cls.key), "full").select(*_with_given(_columns(target, cls), cls))


def merge_layers(target: DataFrame, deltas: DataFrame, cls: RecordClass) -> DataFrame:
    """The class's table with small layers of given fields put over it in order: ``id, time, fields, seq``.

    A key has one row at most in the target and one in each layer. Records and layers meet in one grouping by key, so filters on
    the key reach all of them.
    """
    id_field, time_field = cls.key
    columns = _columns(target, cls)
    old = target.select(*cls.key, F.struct(*columns, "extra").alias("_old"), F.lit(None).cast("struct<seq:int,fields:map<string,string>>").alias("_new"))
    kind = old.schema["_old"].dataType
    new = deltas.select(
        F.col("id").alias(id_field), F.col("time").alias(time_field), F.lit(None).cast(kind).alias("_old"),
        F.struct(F.col("seq").cast("int").alias("seq"), "fields").alias("_new"))
    keyed = old.unionByName(new).groupBy(*cls.key).agg(F.first("_old", ignorenulls=True).alias("_old"), F.collect_list("_new").alias("_new"))
    in_order = F.array_sort("_new", lambda a, b: a["seq"] - b["seq"])
    given = F.aggregate(in_order, F.lit(None).cast("map<string,string>"), lambda fields, x: overlay(fields, x["fields"]))
    return keyed.select(*cls.key, "_old.*", given.alias("_given")).select(*_with_given(columns, cls))


def _columns(target: DataFrame, cls: RecordClass) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in target.schema if f.name not in (*cls.key, "extra")}


def _with_given(columns: dict[str, str], cls: RecordClass) -> list:
    """The table's columns, from the old ones beside ``_given``, the map of given fields."""
    new = F.col("_given")
    merged = [
        F.when(F.coalesce(F.map_contains_key(new, name), F.lit(False)), _typed(new[name], kind)).otherwise(F.col(name)).alias(name)
        for name, kind in columns.items()
    ]
    declared = F.array(*[F.lit(name) for name in (*cls.key, *columns)])
    unknown = F.map_filter(new, lambda k, v: ~F.array_contains(declared, k) | _more(k, v, columns | {cls.id_field: "string"}))
    old = F.when(new.isNull(), F.col("extra")).otherwise(F.map_filter("extra", lambda k, _: ~F.map_contains_key(new, k)))
    return [*cls.key, *merged, overlay(old, unknown).alias("extra")]


def _more(name: Column, text: Column, columns: dict[str, str]) -> Column:
    """Whether a declared field's value must be kept in ``extra``, beside the typed column: nested ones that hold more, and numbers
    given for a text."""
    found = F.lit(False)
    for declared, kind in columns.items():
        if kind.startswith(("array", "struct")):
            found = found | ((name == declared) & _holds_more(text, kind))
    strings = [declared for declared, kind in columns.items() if kind == "string"]
    if strings:
        found = found | (name.isin(*strings) & fieldtext.is_number(text))
    return found


def new_only(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch rows whose key the target lacks; of several with one key, the first to arrive."""
    first = batch.groupBy(*KEY).agg(F.min_by("fields", "seq").alias("fields"))
    return first.join(target.select(*KEY), list(KEY), "left_anti")


def key_violations(table: DataFrame, *key: str) -> DataFrame:
    return table.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
