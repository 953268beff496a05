"""Masked request bodies: every other key stays; against plain Python."""

from __future__ import annotations

import copy
import json
import random

import plain
from pyspark.sql import functions as F

from veilwork.functions.bodies import mask_body
from veilwork.operators.budgets import Limits
from veilwork.plans import guard
from veilwork.rules import ScrubRules

RULES = ScrubRules(custom_patterns={"ticket": r"\bTCK-\d{3}\b"})
TEXTS = ["", "call u1@corp.io", "u2@corp.io and u1@corp.io", "TCK-123 \"quoted\" \\ back\nslash\t\u000b", "ip 10.1.2.3 é 日本", "nothing"]


def leaves(body):
    """Containers and keys of the strings that are masked, in order."""
    if isinstance(body.get("messages"), list):
        for message in body["messages"]:
            content = message.get("content") if isinstance(message, dict) else None
            if isinstance(content, str):
                yield message, "content"
            for part in content if isinstance(content, list) else []:
                if isinstance(part, dict) and part.get("type") == "text" and isinstance(part.get("text"), str):
                    yield part, "text"
    elif isinstance(body.get("prompt"), str):
        yield body, "prompt"
    else:
        prompt = body.get("prompt")
        yield from ((prompt, i) for i, p in enumerate(prompt if isinstance(prompt, list) else []) if isinstance(p, str))


def masked_by_hand(body):
    body = copy.deepcopy(body)
    places = list(leaves(body))
    masked, back = plain.mask_session([holder[key] for holder, key in places], RULES)
    for (holder, key), text in zip(places, masked):
        holder[key] = text
    return body, back


def some_body(rng):
    def part():
        return rng.choice(
            [
                {"type": "text", "text": rng.choice(TEXTS), "cache": {"u": "k@corp.io"}},
                {"type": "image_url", "image_url": {"url": "u1@corp.io"}, "text": "u1@corp.io"},
                {"type": "text", "text": 5}, {"type": "text"}, "u1@corp.io", None, 7,
            ]
        )

    def message():
        content = rng.choice([rng.choice(TEXTS), [part() for _ in range(rng.randrange(4))], None, 3.5, {"text": "u1@corp.io"}])
        extra = rng.choice([{}, {"name": "u1@corp.io"}, {"tool_calls": [{"id": 1, "arguments": "{\"to\": \"u1@corp.io\"}"}]}])
        return rng.choice([{"role": "user", "content": content, **extra}] * 6 + [{"role": "tool"}, "u1@corp.io", None])

    body = rng.choice(
        [
            {"messages": [message() for _ in range(rng.randrange(5))]},
            {"messages": [message()], "prompt": "u1@corp.io"},
            {"messages": None, "prompt": rng.choice(TEXTS)},
            {"prompt": [rng.choice([*TEXTS, 4, None, {"role": "user", "content": "u1@corp.io"}]) for _ in range(rng.randrange(4))]},
            {"prompt": rng.choice(TEXTS)}, {"prompt": 12}, {"input": ["u1@corp.io"]}, {},
        ]
    )
    return {"model": "m", "user": "u1@corp.io", "big": 12345678901234567890123, "f": 0.125, "stop": ["u1@corp.io", None], **body}


def test_bodies_against_plain_python(spark):
    rng = random.Random(4)
    bodies = [some_body(rng) for _ in range(300)]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "id int, body string")
    masked = df.select("id", mask_body(F.try_parse_json("body"), RULES).alias("m")).select("id", F.to_json("m.body").alias("body"), "m.map")
    changed = 0
    for r in masked.collect():
        expected, back = masked_by_hand(bodies[r["id"]])
        assert json.loads(r["body"]) == expected
        assert {e["mask"]: e["original"] for e in r["map"]} == back
        changed += bool(back)
    assert changed > 60


def test_guarded_bodies(spark):
    rows = [
        (1, "a", 1, '{"messages": [{"role": "user", "content": "u1@corp.io"}], "n": 1}'),
        (2, "a", 2, '{"prompt": "u2@corp.io", "n": 2}'),
        (3, "a", 3, '{"n": 3, "messages": [], "prompt": ""}'),
        (4, "a", 4, "not json u1@corp.io"),
        (5, "a", 5, '["u1@corp.io"]'),
        (6, "b", 6, None),
    ]
    df = spark.createDataFrame(rows, "request_id bigint, client_id string, ts_us bigint, body string")
    options = guard.GuardOptions(budget=Limits(max_requests_per_minute=1))
    got = {r["request_id"]: r for r in guard.guard_bodies(df, options).collect()}
    assert json.loads(got[1]["body"]) == {"messages": [{"role": "user", "content": "[EMAIL_1]"}], "n": 1}
    assert got[2]["decision"] == "requests" and got[2]["body"] is None and got[2]["map"] is None
    assert json.loads(got[3]["body"]) == {"n": 3, "messages": [], "prompt": ""} and got[3]["decision"] == "ok"
    assert got[4]["body"] == "not json u1@corp.io" and json.loads(got[5]["body"]) == ["u1@corp.io"] and got[6]["body"] is None
    assert [got[i]["estimated_tokens"] for i in range(1, 7)] == [plain.body_tokens(json.loads(rows[0][3])), plain.tokens("u2@corp.io"), 0, 0, 0, 0]
