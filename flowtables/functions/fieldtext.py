"""Values of a record's ``fields``: JSON text, or a plain text that cannot be taken for it.

A number, truth value, list or object stands as its JSON text; a text stands as it is, unless it looks like one of these (``"5"``,
``"[x"``): then it stands in quotes. So what was a number is given back as a number, and what was a text as a text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?"
_JSON = rf'(?s)^(?:["\[{{].*|{_NUMBER}|true|false)$'
_SCALAR = rf"^(?:{_NUMBER}|true|false)$"


def from_variant(value: Column) -> Column:
    """The field value of a parsed JSON value; null for JSON's null."""
    json = F.to_json(value)
    text = F.try_variant_get(value, "$", "string")
    as_text = F.when(text.rlike(_JSON), json).otherwise(text)
    return F.when(json == "null", F.lit(None)).when(json.startswith('"'), as_text).otherwise(json)


def from_text(text: Column) -> Column:
    """The field value of a text."""
    quoted = F.to_json(F.array(text))
    return F.when(text.rlike(_JSON), F.substr(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(text)


def plain(value: Column) -> Column:
    """The text of a field value: quoted ones without their quotes, all others as they are."""
    def unquoted(x):
        inner = F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), 0)
        return F.when(x.startswith('"'), F.coalesce(inner, x)).otherwise(x)

    return F.get(F.transform(F.array(value), unquoted), 0)  # so that ``value`` is worked out once


def is_number(value: Column) -> Column:
    """Whether a field value is a JSON number or truth value."""
    return F.coalesce(value.rlike(_SCALAR), F.lit(False))


def is_json(value: Column) -> Column:
    """Whether a field value stands as JSON text; others are texts."""
    return is_number(value) | (value.rlike(r'^["\[{]') & F.try_parse_json(value).isNotNull())
