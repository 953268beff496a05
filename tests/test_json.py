from __future__ import annotations

import json
import random

import plain
import pytest
from pyspark.sql import functions as F

from veilwork.functions import jsonfix
from veilwork.operators import replies
from veilwork.operators.replies import SchemaRules

PASSES = [
    (jsonfix.extract_json_block, plain.block),
    (jsonfix.strip_json_comments, plain.comments),
    (jsonfix.fix_python_literals, plain.literals),
    (jsonfix.fix_single_quotes, plain.quotes),
    (jsonfix.fix_trailing_commas, plain.commas),
    (jsonfix.close_structures, plain.closers),
    (jsonfix.repair_json, plain.repair),
]
BITS = [
    "{", "}", "[", "]", '"', '"', "'", "'", ",", ":", "\\", '\\"', "//", "/*", "*/", "\n", " ", "True",
    "False", "None", "x", "1", "2.50", "null", "true", '"a":', '"b": "c"', "'k': 'v'", "```json\n", "```",
    "Text ", '{"a": 1}', '{"a": [1, 2,],}', "é", "_", "　", "1e5", "-", '"x": None', "\t", "1],[2", "1} x",
]
LONG = ['{"a": "' + "x\\n" * 50000 + '"}', '{"a": "' + "y" * 300000, "{'a': '" + 'q"' * 20000 + "'}",
        "{" * 500 + "}" * 200, '{"berth": "quay nine, no', '"abc\\', "", "   ", '{"a":1,"a":2}']


@pytest.fixture(scope="module")
def dirty(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 10))) for _ in range(12000)]
    rows = list(enumerate(texts + LONG))
    return spark.createDataFrame(rows, "id int, t string").repartition(8).cache()


def test_every_pass_on_random_texts(dirty):
    names = [f"p{i}" for i in range(len(PASSES))]
    fixed = dirty.select("t", *[f(F.col("t")).alias(n) for n, (f, _) in zip(names, PASSES)])
    for row in fixed.collect():
        for name, (_, expected) in zip(names, PASSES):
            assert row[name] == expected(row.t), (name, row.t[:200])


def shown(value):
    """A number beyond the double range is written out as the text "Infinity"."""
    if isinstance(value, float) and value in (float("inf"), float("-inf")):
        return "Infinity" if value > 0 else "-Infinity"
    if isinstance(value, list):
        return [shown(v) for v in value]
    if isinstance(value, dict):
        return {k: shown(v) for k, v in value.items()}
    return value


def test_parse_or_repair_on_random_texts(dirty):
    parsed = dirty.select("t", jsonfix.parse_or_repair(F.col("t")).alias("p"))
    for row in parsed.select("t", F.to_json("p.value").alias("v"), "p.tier").collect():
        value, tier = plain.parse(row.t)
        assert row.tier == tier, row.t[:200]
        if tier is not None:
            assert json.loads(row.v) == shown(value), row.t[:200]


def outcome(spark, rules, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    rows = replies.enforce_schema(df, rules).orderBy("id").select("enforced").collect()
    return [r.enforced for r in rows]


def messages(result):
    return sorted(e.message for e in result.errors)


PARCEL = {
    "type": "object",
    "required": ["label", "grams", "stops"],
    "properties": {
        "label": {"type": "string", "minLength": 5, "maxLength": 9},
        "grams": {"type": "integer", "minimum": 50, "maximum": 900},
        "lane": {"enum": ["sea", "rail", 7]},
        "stops": {"type": "array", "minItems": 2, "items": {"type": "string"}},
    },
}


def test_schema_errors_read_like_python(spark):
    good, bad = outcome(
        spark,
        SchemaRules(schema=PARCEL),
        '{"stops": ["Oslo", "Kiel"], "label": "crate-4", "lane": 7, "grams": 50}',
        '{"stops": ["Oslo", false, null], "label": "box", "lane": "pilot\'s", "grams": 41.5}',
    )
    assert (good.status, good.errors) == ("ok", [])
    assert messages(bad) == [
        "root.grams: expected type 'integer', got 'float'",
        "root.label: string length 3 is less than minLength 5",
        "root.lane: value \"pilot's\" is not in allowed enum ['sea', 'rail', 7]",
        "root.stops[1]: expected type 'string', got 'boolean'",
        "root.stops[2]: expected type 'string', got 'null'",
    ]


@pytest.mark.parametrize(
    "schema, passes, fails, rule",
    [
        ({"type": "boolean"}, "false", '"false"', "type"),
        ({"type": "number", "minimum": -2.5}, "-2.5", "-2.75", "minimum"),
        ({"type": "number", "maximum": 1e3}, "1000", "1000.5", "maximum"),
        ({"type": "string", "pattern": "^[A-F]{2}/[0-9]+$"}, '"BE/07"', '"BG/07"', "pattern"),
        ({"type": "string", "maxLength": 2}, '"öß"', '"abc"', "maxLength"),
        ({"type": "null"}, "null", "0", "type"),
        ({"type": "array", "maxItems": 1}, "[[]]", "[0, 0]", "maxItems"),
        ({"type": "array", "minItems": 1}, "[null]", "[]", "minItems"),
        ({"type": ["string", "null"]}, "null", "[1]", "type"),
        ({"properties": {"x": {}}, "additionalProperties": False}, '{"x": {"y": 1}}', '{"y": 1}', "additionalProperties"),
        ({"required": ["x"]}, '{"x": null}', '{"X": 1}', "required"),
    ],
)
def test_rule_by_rule(spark, schema, passes, fails, rule):
    good, bad = outcome(spark, SchemaRules(schema=schema), passes, fails)
    assert good.status == "ok" and [e.rule for e in bad.errors] == [rule]


def test_numbers_equal_across_types_in_enum(spark):
    rules = SchemaRules(schema={"enum": [1, "a", [1, 2], {"k": True}]})
    got = outcome(spark, rules, "1.0", "true", '"a"', "[1,2]", '{"k": true}', "2", '"1"', "null")
    assert [r.status for r in got] == ["ok"] * 5 + ["schema_failed"] * 2 + ["ok"]


def test_wide_integers(spark):
    rules = SchemaRules(schema={"type": "integer", "minimum": 9007199254740993})
    got = outcome(spark, rules, "9007199254740992", "9007199254740993", "12345678901234567890123", "1.0")
    assert [r.status for r in got] == ["schema_failed", "ok", "ok", "schema_failed"]


def test_inactive_passes_through(spark):
    (got,) = outcome(spark, SchemaRules(), "anything")
    assert (got.status, got.json) == ("inactive", "anything")


def test_no_json_is_a_parse_failure_with_a_body(spark):
    df = spark.createDataFrame([(1, "no json at all")], "id int, content string")
    done = replies.enforce_schema(df, SchemaRules(schema={"type": "object"}, on_failure="error"))
    body = done.select(replies.error_body(F.col("enforced"), F.col("content")).alias("b")).first().b
    assert (body.code, body.raw_content) == ("schema_validation_failed", "no json at all")
    assert body.message.startswith("Failed to parse")


def test_one_retry(spark):
    rules = SchemaRules(schema={"properties": {"tide": {"type": "number", "maximum": 9}}, "required": ["tide"]})
    first = '{"tide": 12.5}'
    df = spark.createDataFrame([(i, first) for i in "abcd"] + [("e", '{"tide": 3}')], "id string, content string")
    retries = spark.createDataFrame(
        [("b", '{"ebb": 2}'), ("a", "{'tide': 8.5,}"), ("e", "not looked at"), ("c", "sorry, no")],
        "id string, retry_content string",
    )
    got = {r.id: r for r in replies.enforce_with_retry(df, retries, ["id"], rules).collect()}
    assert (got["a"].status, got["a"].was_repaired, json.loads(got["a"].json)) == ("repaired", True, {"tide": 8.5})
    assert (got["b"].status, got["b"].raw_content, len(got["b"].errors)) == ("schema_failed", '{"ebb": 2}', 1)
    assert (got["c"].status, len(got["c"].errors)) == ("parse_failed", 2)
    assert (got["d"].status, got["d"].raw_content) == ("schema_failed", first)
    assert got["e"].status == "ok"
    off = SchemaRules(schema=rules.schema, on_failure="error")
    assert {r.status for r in replies.enforce_with_retry(df, retries, ["id"], off).collect()} == {"schema_failed", "ok"}


def test_options():
    assert SchemaRules.from_dict({"strict_json": True, "other": 1}).active
    assert not SchemaRules.from_dict({}).active
    with pytest.raises(ValueError):
        SchemaRules.from_dict({"on_failure": "shrug"})
