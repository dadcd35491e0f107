"""XML batches: header and record elements, normalized per class to the same ``fields`` maps as JSON input.

A record is read as a variant with all its elements, in one pass: nested elements are objects, repeated
ones arrays. The lists that a class declares are arrays for one child and for many.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtables.catalog import CLASSES, RecordClass
from flowtables.functions import fieldtext
from flowtables.functions.evaluate import once, unfold
from flowtables.functions.timecols import parse_iso

# Optional elements that are dropped when they are empty or nil.
WITHOUT_SUB_AUTHORITY = ("VDLive", "CMSLive", "AVIPairLive", "ETagPairLive", "LiveTraffic")
NIL_FIELDS = {
    "CongestionLevel": ("SubAuthorityCode", "Description"),
    "News": ("SubAuthorityCode", "Department", "NewsURL", "AttachmentURL", "StartTime", "EndTime"),
}
NIL_LEVEL_FIELDS = ("TopValue", "LowValue")
HEADER = "UpdateTime string, UpdateInterval string, AuthorityCode string, LinkVersion string"
_VEHICLES = "Vehicles struct<Vehicle: array<struct<VehicleType: string, Volume: string, Speed: string>>>"
_LANES = f"Lanes struct<Lane: array<struct<LaneID: string, LaneType: string, Speed: string, Occupancy: string, {_VEHICLES}>>>"
_LINK_FLOWS = f"LinkFlows struct<LinkFlow: array<struct<LinkID: string, {_LANES}>>>"
#: Classes whose nested list is always an array.
_NESTED = ("VD", "VDLive", "AVIPair", "ETagPair", "ETagPairLive", "CongestionLevel")


def nil_fields(cls: RecordClass) -> tuple[str, ...]:
    return NIL_FIELDS.get(cls.name, () if cls.name in WITHOUT_SUB_AUTHORITY else ("SubAuthorityCode",))


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def _links(flows: Column) -> Column:
    """LinkFlows as typed arrays all the way down; typed lanes keep no lane labels."""

    def vehicle(v):
        return F.struct(v["VehicleType"].alias("VehicleType"), _typed(v["Volume"], "bigint").alias("Volume"),
                        _typed(_filled(v["Speed"]), "double").alias("Speed"))

    def lane(x):
        return F.struct(_typed(x["Speed"], "double").alias("Speed"), _typed(x["Occupancy"], "double").alias("Occupancy"),
                        F.transform(x["Vehicles"]["Vehicle"], vehicle).alias("Vehicles"))

    return F.transform(flows["LinkFlow"], lambda link: F.struct(
        link["LinkID"].alias("LinkID"), F.transform(link["Lanes"]["Lane"], lane).alias("Lanes")))


def _typed(text: Column, kind: str) -> Column:
    return text.try_cast(kind)


#: Stands around every text and before every attribute while a document is read as variants, so that none is taken for a number
#: and no space at its ends is lost. Marks in the middle of a text, say in CDATA, do no harm: all are taken out again.
_MARK = ""
_VARIANTS = "map<string,variant>"
_TAG = r"""<(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>"""


def _marked(text: Column) -> Column:
    for pattern, put in ((rf"({_TAG})(\s*+[^<]++)", f"$1{_MARK}$2{_MARK}"), (r"<!\[CDATA\[", f"<![CDATA[{_MARK}"),
                         (r"=(?<!version=)(?<!encoding=)(?<!standalone=)([\"'])", f"=$1{_MARK}")):  # looks back at an = only
        text = F.regexp_replace(text, pattern, put)
    return text


def _unmarked(text: Column) -> Column:
    return F.replace(text, F.lit(_MARK), F.lit(""))


def _value_json(value: Column) -> Column:
    """Any element as JSON: objects for nested ones, arrays for repeated ones, null for nil ones, else a string."""
    return F.coalesce(F.replace(_unmarked(F.to_json(value)), F.lit('{"@nil":"true"}'), F.lit("null")), F.lit("null"))


def _list(value: Column, path: str) -> Column:
    """The elements at ``path``, one or many, as an array; null where there is none."""
    one = F.try_variant_get(value, path, "variant")
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.when(one.isNotNull(), F.array(one)))


def _object_json(value: Column, put=None, without=()) -> Column:
    """An element's children as a JSON object; ``put`` gives the JSON text of some by name; empty ones of ``without`` go."""
    entries = F.map_entries(F.try_variant_get(value, "$", _VARIANTS))
    if without:
        entries = F.filter(entries, lambda e: ~(e["key"].isin(*without) & (_value_json(e["value"]) == "null")))

    def member(entry):
        own = [F.when(entry["key"] == name, other) for name, other in (put or {}).items()]  # each worked out once: they nest
        return F.concat(F.lit('"'), entry["key"], F.lit('":'), F.coalesce(*own, _value_json(entry["value"])))

    return F.coalesce(F.concat(F.lit("{"), F.array_join(F.transform(entries, member), ","), F.lit("}")), _value_json(value))


def _array_json(items: Column, each) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, each), ","), F.lit("]"))


def _list_json(cls: RecordClass, record: Column) -> tuple[str, Column]:
    """Name of the class's nested field and its list as JSON text, with every element of its items."""
    if cls.name == "VD":
        return "DetectionLinks", _array_json(_list(record, "$.DetectionLinks.DetectionLink"), _value_json)
    if cls.name == "VDLive":
        vehicle = lambda v: _object_json(v, without=("Speed",))
        lane = lambda x: _object_json(x, {"Vehicles": _array_json(_list(x, "$.Vehicles.Vehicle"), vehicle)})
        link = lambda k: _object_json(k, {"Lanes": _array_json(_list(k, "$.Lanes.Lane"), lane)})
        return "LinkFlows", _array_json(_list(record, "$.LinkFlows.LinkFlow"), link)
    if cls.name == "ETagPairLive":
        return "Flows", _array_json(_list(record, "$.Flows.Flow"), _value_json)
    if cls.name == "CongestionLevel":
        items = F.coalesce(_list(record, "$.Levels.LevelItem"), _list(record, "$.Levels.Level"))
        return "Levels", _array_json(items, lambda item: _object_json(item, without=NIL_LEVEL_FIELDS))
    named = lambda x: F.concat(F.lit('{"LinkID":'), _value_json(x), F.lit("}"))
    return "LinkIDs", F.coalesce(_array_json(_list(record, "$.LinkIDs.LinkIDItem"), _value_json),
                                 _array_json(_list(record, "$.LinkIDs.LinkID"), named))


def _is_nested(value: Column, single: Column) -> Column:
    """Has children, attributes or is repeated; one with no more than text, or that is nil, is not nested, nor is a ``single`` one
    that is not repeated."""
    plain = F.forall(F.map_keys(F.try_variant_get(value, "$", _VARIANTS)), lambda k: (k == "@nil") | k.startswith("@xmlns") | (k == "#text"))
    return once(F.schema_of_variant(value), lambda kind: F.coalesce(
        kind.startswith("ARRAY") | (kind.startswith("OBJECT") & ~single & ~plain), F.lit(False)))


def _text(value: Column) -> Column:
    """An element's own text."""
    inner = F.try_variant_get(value, "$['#text']", "string")
    return _filled(_unmarked(F.when(F.schema_of_variant(value).startswith("OBJECT"), inner).otherwise(F.try_variant_get(value, "$", "string"))))


def _scalar_names(cls: RecordClass) -> tuple[str, ...]:
    """Fields that are single texts or times by declaration: of these an element's attributes are not kept."""
    declared = (part.split(" ", 1) for part in re.split(r", (?=\w+ (?:string|timestamp|array|map))", cls.schema))
    return (*(name for name, kind in declared if kind in ("string", "timestamp")), "UpdateTime", "DataCollectTime")


def _record(value: Column, cls: RecordClass) -> Column:
    """A record's ``fields`` (texts, or the JSON text of nested and repeated elements) and the names of those ``nested``."""
    elements = F.coalesce(F.try_variant_get(value, "$", _VARIANTS), F.from_json(F.lit("{}"), _VARIANTS))
    scalar = _scalar_names(cls)
    name, items = _list_json(cls, value) if cls.name in _NESTED else ("", F.lit(None).cast("string"))

    def made(x):
        listed = lambda k: (k == name) & x["items"].isNotNull()
        nested = F.map_keys(F.map_filter(x["elements"], lambda k, v: F.when(listed(k), True).otherwise(_is_nested(v, k.isin(*scalar)))))
        return once(nested, lambda names: F.struct(_fields(x, listed, names).alias("fields"), names.alias("nested")))

    def _fields(x, listed, names):
        rest = F.map_filter(x["elements"], lambda k, v: ~listed(k))
        fields = F.transform_values(rest, lambda k, v: F.when(F.array_contains(names, k), _value_json(v)).otherwise(_text(v)))
        if cls.name in _NESTED:
            fields = F.map_concat(fields, F.map_filter(F.create_map(F.lit(name), x["items"]), lambda k, v: v.isNotNull()))
        nil = nil_fields(cls)
        return F.map_filter(fields, lambda k, v: ~(k.isin(*nil) & (F.coalesce(v, F.lit("")) == ""))) if nil else fields

    return once(F.struct(elements.alias("elements"), items.alias("items")), made)


def _options(cls: RecordClass) -> dict[str, str]:
    return {"rowTag": cls.root, "ignoreNamespace": "true"}


def parse_documents(texts: DataFrame, column: str, cls: RecordClass) -> DataFrame:
    """Adds ``header`` (struct), ``records`` (array of field maps) and ``nested`` (their fields that are JSON text) for a
    column of XML documents."""
    schema = f"{HEADER}, {cls.container} struct<{cls.name}: array<variant>>"
    options = _options(cls) | {"attributePrefix": "@", "valueTag": "#text"}
    parsed = texts.withColumn("_doc", F.from_xml(_marked(F.col(column)), schema, options))
    parsed = parsed.withColumn("_records", F.transform(F.col("_doc")[cls.container][cls.name], lambda r: _record(r, cls)))
    header = F.struct(*[_unmarked(F.col("_doc")[name]).alias(name) for name in (part.split()[0] for part in HEADER.split(", "))])
    return parsed.select(
        *texts.columns, header.alias("header"), F.col("_records.fields").alias("records"), F.col("_records.nested").alias("nested"))


def parse_batches(texts: DataFrame, column: str, cls: RecordClass, *, order: str) -> DataFrame:
    """Records of XML documents as header text, fields, seq: the input of the upsert operators."""
    docs = parse_documents(texts.select(F.col(order).alias("_order"), column), column, cls)
    records = F.zip_with("records", "nested", _values)
    return unfold(docs.select(F.col("header.UpdateTime").alias("header"), "_order", records.alias("_all")), "_all", "fields").select(
        "header", "fields", F.struct("_order", "_pos").alias("seq"))


def _values(fields: Column, nested: Column) -> Column:
    """A record's texts as field values: XML has no numbers, so all that is not nested is text."""
    return F.transform_values(fields, lambda k, v: F.when(F.array_contains(nested, k), v).otherwise(fieldtext.from_text(v)))


SALTS = 16


def _pieces(spark: SparkSession, path: str, cls: RecordClass) -> DataFrame:
    """Text files cut behind every end of a record element, wherever the scan splits them: a file of any size is many tasks.

    ``outside`` is the text before the record that ends a piece, ``record`` what follows ``<name``, null where no record begins.
    """
    rows = spark.read.option("lineSep", f"</{cls.name}>").text(path).select(
        "value", F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    spaced = rf"</{cls.name}\s+>"  # ends a record too, but seldom: a split makes its pattern anew for every row, so few rows are to meet it
    ends = F.when(F.col("value").rlike(spaced), F.split("value", spaced)).otherwise(F.array("value"))
    rows = rows.select(*rows.columns[1:], F.posexplode(ends).alias("part", "value"))
    cut = F.split("value", rf"<{cls.name}(?=[\s/>])", 2)
    return rows.select("time", "file", "start", "row", "part", F.get(cut, 0).alias("outside"), F.get(cut, 1).alias("record"))


def _headers(pieces: DataFrame, cls: RecordClass) -> DataFrame:
    """One row a file, from the text outside its records: header time, namespace declarations, and whether it is whole."""
    around = pieces.where("outside RLIKE '[^\\\\s]'")
    outside = F.col("outside")
    has = lambda pattern: F.max(outside.rlike(pattern))
    header = F.nullif(F.regexp_extract("outside", r"<(?:\w+:)?UpdateTime(?:\s[^>]*)?>\s*([^<]*?)\s*<", 1), F.lit(""))
    spaces = F.array_join(F.regexp_extract_all("outside", F.lit(r"""\sxmlns:\w+\s*=\s*(?:"[^"]*"|'[^']*')"""), F.lit(0)), "")
    return around.groupBy("file").agg(
        F.max(header).alias("header"), F.max(spaces).alias("spaces"),
        has(rf"<(?:\w+:)?{cls.root}[\s/>]").alias("opened"), has(rf"</(?:\w+:)?{cls.root}\s*>").alias("closed"),
        has(rf"<(?:\w+:)?{cls.container}[\s/>]").alias("contained"), has(rf"<\w+:{cls.name}[\s/>]").alias("prefixed"))


def _fault() -> Column:
    return (F.when(~F.col("opened"), "other document").when(~F.col("closed"), "cut off").when(~F.col("contained"), "no container")
            .when(F.col("prefixed"), "prefixed records"))


def _declared(record: Column) -> Column:
    """A record in an element that makes the declarations of its file's root."""
    return F.concat(F.lit("<r"), F.col("spaces"), F.lit(">"), record, F.lit("</r>"))


def _file_records(spark: SparkSession, path: str, cls: RecordClass) -> DataFrame:
    """Every record element of whole files, parsed on its own: ``header``, the place it had, ``text`` and ``x`` (null: unreadable)."""
    pieces = _pieces(spark, path, cls)
    whole = _headers(pieces, cls).withColumn("fault", _fault()).where("fault IS NULL")
    # A large file has many records and one header: each is dealt out over several tasks, or the headers go to all if they are few.
    whole = whole.select("file", "header", "spaces", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    records = pieces.where("record IS NOT NULL").withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    text = F.concat(F.lit(f"<{cls.name}"), F.col("record"), F.lit(f"</{cls.name}>"))
    found = records.join(whole, ["file", "salt"]).withColumn("text", text)
    options = {"rowTag": "r", "ignoreNamespace": "true", "attributePrefix": "@", "valueTag": "#text"}
    parsed = F.from_xml(_marked(_declared(F.col("text"))), f"{cls.name} variant", options)
    return unfold(found.withColumn("_parsed", F.array(parsed[cls.name])), "_parsed", "x")


def read_batches(spark: SparkSession, path: str, cls: RecordClass) -> DataFrame:
    """Records of XML documents, one document per file, in order of file time, name and place; files of any size are split.

    Of a file that is not whole nothing is read: see :func:`unreadable`.
    """
    found = _file_records(spark, path, cls).where("x IS NOT NULL")
    found = found.withColumn("_record", _record(F.col("x"), cls))
    fields = _values(F.col("_record.fields"), F.col("_record.nested"))
    return found.select("header", fields.alias("fields"), F.struct("time", "file", "start", "row", "part").alias("seq"))


def unreadable(spark: SparkSession, path: str, cls: RecordClass) -> DataFrame:
    """``file, offset, reason, content``: one row for each file that is cut off or something else, and each record that cannot be parsed."""
    pieces = _pieces(spark, path, cls)
    faults = _headers(pieces, cls).withColumn("reason", _fault()).where("reason IS NOT NULL")
    files = faults.select("file", F.lit(0).cast("long").alias("offset"), "reason", F.lit(None).cast("string").alias("content"))
    records = _file_records(spark, path, cls).where("x IS NULL")
    return files.unionByName(records.select("file", F.col("start").alias("offset"), F.lit("unreadable record").alias("reason"), F.col("text").alias("content")))


DETECTOR_XML = f"VDID string, SubAuthorityCode string, Status string, DataCollectTime string, {_LINK_FLOWS}"


def _detector_rows(docs: DataFrame) -> DataFrame:
    typed = F.transform("rows", lambda r: F.struct(
        r["VDID"].alias("VDID"), parse_iso(r["DataCollectTime"]).alias("DataCollectTime"),
        _filled(r["SubAuthorityCode"]).alias("SubAuthorityCode"), r["Status"].alias("Status"), _links(r["LinkFlows"]).alias("LinkFlows")))
    return unfold(docs.select("header", typed.alias("_all")), "_all", "r").select("header", "r.*")


def parse_detectors(texts: DataFrame, column: str) -> DataFrame:
    """Detector documents straight to typed nested records, in one pass over the text."""
    cls = CLASSES["VDLive"]
    schema = f"UpdateTime string, {cls.container} struct<{cls.name}: array<struct<{DETECTOR_XML}>>>"
    docs = texts.select(F.from_xml(F.col(column), schema, _options(cls)).alias("d"))
    return _detector_rows(docs.select(F.col("d.UpdateTime").alias("header"), F.col(f"d.{cls.container}.{cls.name}").alias("rows")))


def read_detectors(spark: SparkSession, path: str, *, unit: str = "file") -> DataFrame:
    """Detector documents from files.

    ``unit`` is what one row of the scan holds: "file", a whole file with one document; "line", one document per line; "record",
    one record element, wherever it begins and ends. The last two split large files over many tasks.
    """
    cls = CLASSES["VDLive"]
    if unit == "record":
        pieces = _pieces(spark, path, cls)
        headers = _headers(pieces, cls).select("file", "header", "spaces", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        records = pieces.where("record IS NOT NULL").withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(headers, ["file", "salt"])
        text = _declared(F.concat(F.lit(f"<{cls.name}"), F.col("record"), F.lit(f"</{cls.name}>")))
        one = F.from_xml(text, f"{cls.name} struct<{DETECTOR_XML}>", {"rowTag": "r", "ignoreNamespace": "true"})
        return _detector_rows(records.select("header", F.array(one[cls.name]).alias("rows")))
    reader = spark.read.format("xml").option("ignoreNamespace", True).option("multiLine", unit == "file")
    schema = f"UpdateTime string, {cls.container} struct<{cls.name}: array<struct<{DETECTOR_XML}>>>"
    docs = reader.option("rowTag", cls.root).schema(schema).load(path)
    return _detector_rows(docs.select(F.col("UpdateTime").alias("header"), F.col(f"{cls.container}.{cls.name}").alias("rows")))


def record_json(fields: Column, nested: Column) -> Column:
    """A field map as a JSON object; the fields named in ``nested`` are JSON already, everything else a string."""

    def member(entry):
        quoted = F.to_json(F.create_map(entry["key"], entry["value"]), {"ignoreNullFields": "false"})
        plain = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
        given = F.concat(F.lit('"'), entry["key"], F.lit('":'), entry["value"])
        return F.when(F.array_contains(nested, entry["key"]), given).otherwise(plain)

    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(fields), member), ","), F.lit("}"))


def document_json(docs: DataFrame, cls: RecordClass) -> DataFrame:
    """Parsed documents as JSON batch documents, one ``json`` row each; nothing is exploded or grouped."""
    header = F.to_json(F.col("header"))
    body = F.array_join(F.zip_with("records", "nested", record_json), ",")
    opening = F.substr(header, F.lit(1), F.length(header) - 1)
    comma = F.when(header == "{}", F.lit("")).otherwise(F.lit(","))
    return docs.select(F.concat(opening, comma, F.lit(f'"{cls.container}":['), body, F.lit("]}")).alias("json"))
