"""Strict validation of JSON documents against a schema, as column expressions.

``from_json`` is too lenient for this: it fills what it can and turns numbers
into strings.  Here one wrong or missing value rejects the whole document.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.functions.bind import let

_INTEGER = r"^[ \t\r\n]*[+-]?[0-9]+(\.0+)?[ \t\r\n]*$"
# Texts that count as a boolean.
_BOOLEAN = ["0", "f", "false", "n", "no", "1", "t", "true", "y", "yes"]


def _get(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _members(value: Column) -> Column:
    """Keys and values of an object, null for anything else."""
    return F.try_variant_get(value, "$", "map<string, variant>")


def _is(value: Column, dtype: T.DataType) -> Column:
    kind = _kind(value)
    if isinstance(dtype, T.StringType):
        return kind == "STRING"
    if isinstance(dtype, T.BooleanType):
        return (kind == "BOOLEAN") | (
            ((kind == "STRING") | (kind == "BIGINT")) & F.lower(_text(value)).isin(_BOOLEAN)
        )
    if isinstance(dtype, T.IntegerType):
        # A whole number, also when written as text, decimal or boolean.
        number = (kind == "BIGINT") | (kind == "STRING") | (kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))
        return (kind == "BOOLEAN") | (number & _text(value).rlike(_INTEGER))
    if isinstance(dtype, T.ArrayType):
        return F.forall(_items(value), lambda item: F.coalesce(_is(item, dtype.elementType), F.lit(False)))
    if isinstance(dtype, T.StructType):
        return let(_members(value), lambda members: _fits(members, dtype))
    raise TypeError(f"no rule for {dtype.simpleString()}")


def _fits(members: Column, schema: T.StructType) -> Column:
    """True when the members of an object satisfy the fields of the schema."""
    checks = members.isNotNull()
    for f in schema.fields:
        part = members[f.name]
        good = F.coalesce(_is(part, f.dataType), F.lit(False))
        checks = checks & (part.isNull() | F.is_variant_null(part) | good if f.nullable else good)
    return F.coalesce(checks, F.lit(False))


def is_valid(json: Column, schema: T.StructType) -> Column:
    """True when the text is a JSON object that fits the schema; unknown keys are ignored."""
    return let(_members(F.try_parse_json(json)), lambda members: _fits(members, schema))


def validate(json: Column, schema: T.StructType, defaults: Mapping[str, str] | None = None) -> Column:
    """The document as a struct, or null when it does not fit.

    ``defaults`` fill top-level keys that are absent; an explicit null stays null.
    """

    def checked(parsed: Column) -> Column:
        document = F.try_variant_get(parsed, "$", _plain(schema).simpleString())
        for name, default in (defaults or {}).items():
            absent = _get(parsed, f"$.{name}").isNull()
            document = document.withField(name, F.when(absent, F.lit(default)).otherwise(document[name]))
        return F.when(_is(parsed, schema), document)

    return let(F.try_parse_json(json), checked)


def _plain(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_plain(dtype.elementType))
    return dtype


def display_name(record: Column, default: str = "Unknown Company") -> Column:
    """Name of a detail record; the default stands in only when the key is absent."""
    name = _get(record, "$.name")
    return F.when(name.isNull(), F.lit(default)).otherwise(_text(name))


def display_website(record: Column, default: str = "No website found") -> Column:
    """Website of a detail record, given as an object with ``url`` or as text.

    An object shows its ``url`` as it is, and the default only without that key;
    any other empty value shows the default.
    """
    site = _get(record, "$.website")
    url = _get(site, "$.url")
    shown = F.when(F.startswith(_kind(site), F.lit("OBJECT")), F.when(url.isNull(), F.lit(default)).otherwise(_text(url)))
    kind, text = _kind(site), _text(site)
    falsy = (
        site.isNull()
        | F.is_variant_null(site)
        | (text == "")
        | ((kind == "BOOLEAN") & (text == "false"))
        | ((kind != "STRING") & text.rlike(r"^-?0+(\.0+)?$"))
        | (text == "[]")
    )
    return F.when(F.startswith(kind, F.lit("OBJECT")), shown).otherwise(
        F.when(F.coalesce(falsy, F.lit(True)), F.lit(default)).otherwise(text)
    )


def envelope_items(answer: Column) -> Column:
    """Records of an answer: a list, or an object that holds them under ``companies``."""
    parsed = F.try_parse_json(answer)
    listed = F.startswith(_kind(parsed), F.lit("ARRAY"))
    inner = F.try_variant_get(parsed, "$.companies", "array<variant>")
    return F.when(listed, _items(parsed)).otherwise(F.coalesce(inner, F.array().cast("array<variant>")))
