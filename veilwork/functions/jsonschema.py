"""Check a VARIANT against a JSON schema, compiled into one Column."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.let import let
from veilwork.functions.regex import jvm_pattern

ERRORS_TYPE = (
    "array<struct<path:string,rule:string,expected:string,actual:string,message:string>>"
)

# --- fixed values: which kinds satisfy a schema type, and how a wrong one is named ---
TYPE_KINDS = {
    "null": ("null",),
    "boolean": ("boolean",),
    "integer": ("integer",),
    "number": ("integer", "float"),
    "string": ("string",),
    "array": ("array",),
    "object": ("object",),
}
KIND_NAMES = {
    "null": "null",
    "boolean": "boolean",
    "integer": "int",
    "float": "float",
    "string": "str",
    "array": "list",
    "object": "dict",
}
MESSAGES = {
    "type": ": expected type '{expected}', got '{actual}'",
    "enum": ": value {actual} is not in allowed enum {expected}",
    "minLength": ": string length {actual} is less than minLength {expected}",
    "maxLength": ": string length {actual} exceeds maxLength {expected}",
    "pattern": ": string does not match required regex pattern '{expected}'",
    "minimum": ": number {actual} is less than minimum {expected}",
    "maximum": ": number {actual} is greater than maximum {expected}",
    "required": ": required field is missing",
    "additionalProperties": ": additional property is not allowed",
    "minItems": ": array length {actual} is less than minItems {expected}",
    "maxItems": ": array length {actual} exceeds maxItems {expected}",
}
# --- end of fixed values ---


def json_kind(value: Column) -> Column:
    """null, boolean, integer, float, string, array or object."""
    return let(F.schema_of_variant(value), _kind_of_shape)


def _kind_of_shape(shape: Column) -> Column:
    # integers beyond 64 bits are stored as wide decimals; 1.0 is a narrow one
    wide_integer = shape.rlike(r"^DECIMAL\((?:19|[23][0-9]),0\)$")
    return (
        F.when(shape == "VOID", "null")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "STRING", "string")
        .when((shape == "BIGINT") | wide_integer, "integer")
        .when(shape.startswith("ARRAY<"), "array")
        .when(shape.startswith("OBJECT<"), "object")
        .otherwise("float")
    )


def _as_text(value: Column, kind: Column) -> Column:
    """The value as Python would print it; nested values as JSON."""
    text = F.try_variant_get(value, "$", "string")
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    quote = F.when(single & ~double, '"').otherwise("'")
    for raw, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    text = F.when(single & double, F.replace(text, F.lit("'"), F.lit("\\'"))).otherwise(text)
    number = F.to_json(value)
    return (
        F.when(kind == "string", F.concat(quote, text, quote))
        .when(kind == "boolean", F.initcap(number))
        .when((kind == "float") & ~number.rlike("[.eE]"), F.concat(number, F.lit(".0")))
        .otherwise(number)
    )


def _none() -> Column:
    return F.array().cast(ERRORS_TYPE)


def _error(path: Column, rule: str, expected: Any, actual: Column) -> Column:
    """One error, with its message."""
    actual = actual.cast("string")
    said: list[Column] = [path]
    for i, part in enumerate(MESSAGES[rule].split("{actual}")):
        if i:
            said.append(actual)
        said.append(F.lit(part.replace("{expected}", str(expected))))
    return F.struct(
        path.alias("path"),
        F.lit(rule).alias("rule"),
        (expected if isinstance(expected, Column) else F.lit(str(expected))).alias("expected"),
        actual.alias("actual"),
        F.concat(*said).alias("message"),
    )


def _if(condition: Column, error: Column) -> Column:
    return F.when(condition, F.array(error).cast(ERRORS_TYPE)).otherwise(_none())


def _below(value: Column, kind: Column, bound: float) -> Column:
    """value < bound, exact for 64-bit integers."""
    number = F.try_variant_get(value, "$", "double")
    if isinstance(bound, int):
        whole = F.try_variant_get(value, "$", "bigint")
        return F.when((kind == "integer") & whole.isNotNull(), whole < bound).otherwise(
            number < float(bound)
        )
    return number < bound


def _above(value: Column, kind: Column, bound: float) -> Column:
    number = F.try_variant_get(value, "$", "double")
    if isinstance(bound, int):
        whole = F.try_variant_get(value, "$", "bigint")
        return F.when((kind == "integer") & whole.isNotNull(), whole > bound).otherwise(
            number > float(bound)
        )
    return number > bound


def _in_enum(value: Column, kind: Column, allowed: Sequence[Any]) -> Column:
    """Membership by Python equality: 1, 1.0 and True are the same."""
    texts = [a for a in allowed if isinstance(a, str)]
    numbers = [float(a) for a in allowed if isinstance(a, (bool, int, float))]
    nested = [a for a in allowed if isinstance(a, (list, dict))]
    found = F.lit(False)
    if texts:
        found = found | ((kind == "string") & F.try_variant_get(value, "$", "string").isin(texts))
    if numbers:
        as_number = F.when(
            kind == "boolean", F.try_variant_get(value, "$", "boolean").cast("double")
        ).otherwise(F.try_variant_get(value, "$", "double"))
        found = found | (kind.isin("integer", "float", "boolean") & as_number.isin(numbers))
    for a in nested:
        same = F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(a))))
        found = found | (kind.isin("array", "object") & same)
    return F.coalesce(found, F.lit(False))


def validate_json(value: Column, schema: Mapping[str, Any], path: Column | str = "root") -> Column:
    """All violations as an array of structs; empty if valid, null if ``value`` is."""
    start = F.lit(path) if isinstance(path, str) else path
    return F.when(value.isNotNull(), _node(value, schema, start))


def _node(value: Column, schema: Mapping[str, Any], path: Column) -> Column:
    def checked(node: Column) -> Column:
        v, kind = node["v"], node["kind"]
        checks: list[Column] = []
        if "enum" in schema:
            shown = _as_text(v, kind)
            checks.append(
                _if(
                    ~_in_enum(v, kind, schema["enum"]),
                    _error(path, "enum", schema["enum"], shown),
                )
            )
        checks += _string_checks(v, kind, schema, path)
        checks += _number_checks(v, kind, schema, path)
        if any(k in schema for k in ("required", "properties")) or (
            schema.get("additionalProperties") is False
        ):
            checks.append(
                F.when(
                    kind == "object",
                    let(
                        F.try_variant_get(v, "$", "map<string,variant>"),
                        lambda m: _object_errors(m, schema, path),
                    ),
                ).otherwise(_none())
            )
        if any(k in schema for k in ("minItems", "maxItems", "items")):
            checks.append(
                F.when(
                    kind == "array",
                    let(
                        F.try_variant_get(v, "$", "array<variant>"),
                        lambda items: _array_errors(items, schema, path),
                    ),
                ).otherwise(_none())
            )
        result = F.concat(*checks) if checks else _none()
        result = F.when(kind == "null", _none()).otherwise(result)
        expected = schema.get("type")
        if expected:
            names = [expected] if isinstance(expected, str) else list(expected)
            kinds = sorted({k for n in names for k in TYPE_KINDS.get(n, ())})
            fits = kind.isin(kinds) if kinds else F.lit(False)
            actual = F.element_at(
                F.create_map(*[F.lit(x) for pair in KIND_NAMES.items() for x in pair]), kind
            )
            wrong = F.array(_error(path, "type", expected, actual)).cast(ERRORS_TYPE)
            result = F.when(fits, result).otherwise(wrong)
        return result

    return let(F.struct(value.alias("v"), json_kind(value).alias("kind")), checked)


def _string_checks(v: Column, kind: Column, schema: Mapping[str, Any], path: Column):
    text = F.when(kind == "string", F.try_variant_get(v, "$", "string"))
    size = F.length(text)
    if "minLength" in schema:
        least = schema["minLength"]
        yield _if(size < least, _error(path, "minLength", least, size))
    if "maxLength" in schema:
        most = schema["maxLength"]
        yield _if(size > most, _error(path, "maxLength", most, size))
    if "pattern" in schema:
        pattern = schema["pattern"]
        yield _if(~text.rlike(jvm_pattern(pattern)), _error(path, "pattern", pattern, text))


def _number_checks(v: Column, kind: Column, schema: Mapping[str, Any], path: Column):
    is_number = kind.isin("integer", "float")
    shown = _as_text(v, kind)
    if "minimum" in schema:
        least = schema["minimum"]
        yield _if(is_number & _below(v, kind, least), _error(path, "minimum", least, shown))
    if "maximum" in schema:
        most = schema["maximum"]
        yield _if(is_number & _above(v, kind, most), _error(path, "maximum", most, shown))


def _names(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _object_errors(members: Column, schema: Mapping[str, Any], path: Column) -> Column:
    keys = F.map_keys(members)
    properties = schema.get("properties", {})
    parts = []
    if schema.get("required"):
        parts.append(
            F.transform(
                F.array_except(_names(schema["required"]), keys),
                lambda k: _error(F.concat(path, F.lit("."), k), "required", k, F.lit(None)),
            )
        )
    for name, sub in properties.items():
        here = F.concat(path, F.lit("." + name))
        parts.append(
            F.when(
                F.map_contains_key(members, name), _node(F.element_at(members, name), sub, here)
            ).otherwise(_none())
        )
    if schema.get("additionalProperties") is False:
        parts.append(
            F.transform(
                F.array_except(keys, _names(list(properties))),
                lambda k: _error(F.concat(path, F.lit("."), k), "additionalProperties", False, k),
            )
        )
    return F.concat(*[p.cast(ERRORS_TYPE) for p in parts]) if parts else _none()


def _array_errors(items: Column, schema: Mapping[str, Any], path: Column) -> Column:
    size = F.size(items)
    parts = []
    if "minItems" in schema:
        least = schema["minItems"]
        parts.append(_if(size < least, _error(path, "minItems", least, size)))
    if "maxItems" in schema:
        most = schema["maxItems"]
        parts.append(_if(size > most, _error(path, "maxItems", most, size)))
    sub = schema.get("items")
    if sub and isinstance(sub, Mapping):
        parts.append(
            F.flatten(
                F.transform(
                    items,
                    lambda x, i: _node(
                        x, sub, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
                    ),
                )
            )
        )
    return F.concat(*parts) if parts else _none()
