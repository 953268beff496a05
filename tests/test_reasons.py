"""Why a text isn't JSON: against Python's parser."""

from __future__ import annotations

import json
import random

import plain
from pyspark.sql import functions as F

from veilwork.functions.jsonreason import parse_reason, scan_json


def reason_of(text):
    def refuse(_):
        raise AssertionError

    try:
        json.loads(text, parse_constant=refuse)
    except json.JSONDecodeError as e:
        return e.msg, e.pos
    return None, None


def some_text(rng):
    good = json.dumps(
        rng.choice([{"a": [1, -2.5e3, {"b": None}], "c": "x\n\"é\" \\ 日", "d": {}}, [[], {}, "", True, [False]], "s", 12, {"k": "v"}]),
        ensure_ascii=rng.random() < 0.5,
        indent=rng.choice([None, 1]),
    )
    for _ in range(rng.randrange(3)):
        at = rng.randrange(len(good) + 1)
        cut = rng.randrange(3)
        good = good[:at] + rng.choice(["", "", "{", "}", "[", "]", ",", ":", '"', "x", "\\", "\\u12", "\t", "\x01", "0", "-", " nul"]) + good[at + cut :]
    return good


def test_first_wrong_character(spark):
    rng = random.Random(5)
    texts = [some_text(rng) for _ in range(1500)] + ["", " ", "[", "{", '{"a"', '{"a":', '{"a":1', "[1", "01", "1 2", "-", '"\\', '"\\x"', '"\\u1']
    # newer parsers have a word of their own for a comma before a closer, which repairs leave none of
    texts = [t for t in texts if not any(c in "".join(t.split()) for c in (",}", ",]"))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    wrong = 0
    for r in df.select("i", scan_json(F.col("t")).alias("s")).collect():
        expected = reason_of(texts[r["i"]])
        assert tuple(r["s"]) == expected, texts[r["i"]]
        wrong += expected[0] is not None
    assert wrong > 500


def test_reasons_of_replies(spark):
    texts = ["", " \n", "no json", '{"a" 1}', "text {\n'a': [1, 2 3]\n} more", '{"a": "x" "y"}', "[1, @]", '{"ok": True,}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["r"] for r in df.orderBy("i").select(parse_reason(F.col("t")).alias("r")).collect()]
    for text, reason in zip(texts, got):
        if not (text or "").strip():
            assert reason == "Empty or whitespace-only JSON input"
            continue
        try:
            json.loads(plain.repair(text))
            assert reason is None
        except json.JSONDecodeError as e:
            assert reason == str(e)
