"""Checking JSON values against a subset of JSON Schema, compiled to column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LONG = float(2**63)


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def json_type(value: Column) -> Column:
    """null, boolean, object, array, string, integer or number.

    Numbers written with a fraction or an exponent are no integers, even if whole.  Variants keep whole
    numbers of up to 38 digits; longer ones are numbers.
    """

    def named(kind: Column) -> Column:
        whole = kind.startswith("DECIMAL") & kind.endswith(",0)")
        number = F.when(whole & (F.abs(_as(value, "double")) >= _LONG), "integer").otherwise("number")
        out = F.when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").when(kind == "STRING", "string").when(kind.startswith("OBJECT"), "object")
        return out.when(kind.startswith("ARRAY"), "array").when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").otherwise(number)

    return _let(F.schema_of_variant(value), named)


def _is_type(kind: Column, expected: Any) -> Column:
    if isinstance(expected, list):
        out = F.lit(False)
        for one in expected:
            out = out | _is_type(kind, one)
        return out
    if expected == "number":
        return kind.isin("number", "integer")
    known = ("object", "array", "string", "integer", "boolean", "null")
    return kind == expected if expected in known else F.lit(True)


def _listed(value: Column, kind: Column, number: Column, wanted: list[Any]) -> Column:
    """Whether a value is one of ``wanted``; true and false are 1 and 0 here, whichever side they are on."""
    numbers = [float(w) for w in wanted if isinstance(w, (bool, int, float))]
    texts = [w for w in wanted if isinstance(w, str)]
    others = [w for w in wanted if w is None or isinstance(w, (dict, list))]
    found = F.lit(False)
    if numbers:
        known = F.when(kind == "boolean", _as(value, "boolean").cast("double")).otherwise(number)
        found = found | F.coalesce(known.isin(numbers), F.lit(False))
    if texts:
        found = found | F.coalesce((kind == "string") & _as(value, "string").isin(texts), F.lit(False))
    for other in others:
        found = found | F.coalesce(F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(other)))), F.lit(False))
    return found


_NONE = "array<string>"


def _one(when: Column, *text: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.array(F.concat(*text))).otherwise(F.array().cast(_NONE))


def _number_issues(value: Column, kind: Column, schema: dict[str, Any], path: Column) -> Column:
    def told(number: Column) -> Column:
        parts = [F.array().cast(_NONE)]
        if isinstance(schema.get("enum"), list):
            parts.append(_one(~_listed(value, kind, number, schema["enum"]), path, F.lit(": value is not in enum")))
        for keyword, wrong, name in (("minimum", lambda v, x: v < x, "below minimum"), ("maximum", lambda v, x: v > x, "above maximum")):
            bound = schema.get(keyword)
            if isinstance(bound, (int, float)):
                parts.append(_one(wrong(number, F.lit(float(bound))), path, F.lit(f": value is {name} {bound}")))
        return F.concat(*parts)

    return _let(F.when(kind.isin("number", "integer"), _as(value, "double")), told)


def _member_issues(value: Column, kind: Column, schema: dict[str, Any], path: Column) -> Column:
    properties = schema["properties"] if isinstance(schema.get("properties"), dict) else {}
    required = [name for name in schema["required"] if isinstance(name, str)] if isinstance(schema.get("required"), list) else []

    def told(members: Column) -> Column:
        parts = [_one(~F.map_contains_key(members, name), path, F.lit(f".{name}: required property is missing")) for name in required]
        if schema.get("additionalProperties") is False:
            names = F.map_keys(members)
            others = F.filter(names, lambda n: ~n.isin(list(properties))) if properties else names
            parts.append(F.transform(others, lambda n: F.concat(path, F.lit("."), n, F.lit(": additional property is not allowed"))))
        for name, child in properties.items():
            if isinstance(child, dict):
                parts.append(_let(F.try_element_at(members, F.lit(name)), _checked(child, F.concat(path, F.lit(f".{name}")))))
        return F.coalesce(F.when(members.isNotNull(), F.concat(*parts)), F.array().cast(_NONE)) if parts else F.array().cast(_NONE)

    return _let(F.when(kind == "object", _as(value, "map<string,variant>")), told)


def _checked(schema: dict[str, Any], path: Column) -> Callable[[Column], Column]:
    return lambda value: issues(value, schema, path)


def issues(value: Column, schema: dict[str, Any], path: Column | None = None) -> Column:
    """An array of what is wrong with a variant: type, enum, minimum, maximum, required, properties, additionalProperties, items.

    A value of a wrong type has that one issue.  Keywords that are not of the subset are ignored.  A
    null column value has no issues, as there is nothing to check; a JSON null is a value.
    """
    path = F.lit("$") if path is None else path

    def told(kind: Column) -> Column:
        parts = [F.array().cast(_NONE)]
        if {"enum", "minimum", "maximum"} & schema.keys():
            parts.append(_number_issues(value, kind, schema, path))
        if {"properties", "required", "additionalProperties"} & schema.keys():
            parts.append(_member_issues(value, kind, schema, path))
        if isinstance(schema.get("items"), dict):
            elements = F.when(kind == "array", _as(value, "array<variant>"))
            found = F.transform(elements, lambda x, i: issues(x, schema["items"], F.concat(path, F.lit("["), i, F.lit("]"))))
            parts.append(F.coalesce(F.flatten(found), F.array().cast(_NONE)))
        expected = schema.get("type")
        inner = F.concat(*parts)
        if expected is not None:
            inner = F.when(~_is_type(kind, expected), F.array(F.concat(path, F.lit(f": expected {expected}, got "), kind))).otherwise(inner)
        return inner

    return F.when(value.isNotNull(), _let(json_type(value), told)).otherwise(F.array().cast(_NONE))


def validated(rows: DataFrame, json_column: str, schema: dict[str, Any]) -> DataFrame:
    """``rows`` with ``errors``, an array, and ``valid``; a text that is no JSON, or names a member twice, has one error."""
    unreadable = F.array(F.lit("$: not readable as JSON"))
    errors = _let(F.try_parse_json(F.col(json_column)), lambda value: F.when(value.isNull(), unreadable).otherwise(issues(value, schema)))
    return rows.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
