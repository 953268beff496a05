from __future__ import annotations

import json

import plain
import pytest
from pyspark.sql import functions as F

from veilwork.functions.masking import MESSAGE_TYPE
from veilwork.operators import telemetry
from veilwork.operators.replies import SchemaRules
from veilwork.operators.budgets import Limits
from veilwork.plans import guard
from veilwork.rules import ScrubRules
from veilwork.sources import requests as source
from veilwork.sources import sse


@pytest.mark.parametrize(
    "auth, x, host, key",
    [
        ("Bearer sk-1", "team", "10.0.0.1", "team"),
        ("Bearer sk-1", "", "10.0.0.1", "sk-1"),
        ("", None, "10.0.0.1", "10.0.0.1"),
        ("Bearer ", None, "10.0.0.1", ""),
        (None, None, None, "anonymous_client"),
    ],
)
def test_client_key(spark, auth, x, host, key):
    df = spark.createDataFrame([(auth, x, host)], "a string, x string, h string")
    assert df.select(source.client_key(F.col("a"), F.col("x"), F.col("h"))).first()[0] == key


def test_request_bodies(spark):
    bodies = [
        {"model": "m", "messages": [{"role": "user", "content": "hi"}], "stream": True},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "t"}, {"type": "image_url", "image_url": {"url": "u"}}]}]},
        {"messages": [], "prompt": "p"},
        {"prompt": ["a", "b"]},
        {"model": "m"},
        {"messages": [{"role": "user", "content": "[1, 2]"}]},
        {"prompt": '["a", "b"]'},
        {"messages": [{"role": "user", "content": '[{"type": "text", "text": "x"}]'}]},
        {"prompt": [{"role": "user", "name": "Kim", "content": "to the pier"}]},
        {"prompt": ""},
        {"prompt": [""]},
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "id int, body string")
    rows = source.read_request_lines(df).orderBy("id").collect()
    assert (rows[0].model, rows[0].stream, rows[0].messages[0].content) == ("m", True, "hi")
    assert [p.text for p in rows[1].messages[0].parts] == ["t", None]
    assert rows[1].messages[0].parts[1].image_url == "u" and rows[1].messages[0].content is None
    assert (rows[2].is_chat, rows[2].has_prompt, rows[2].prompt) == (True, True, ["p"])
    assert (rows[3].is_chat, rows[3].prompt) == (False, ["a", "b"])
    assert not rows[4].has_prompt
    assert rows[5].messages[0].content == "[1, 2]"
    assert rows[6].prompt == ['["a", "b"]'] and rows[7].messages[0].parts is None
    assert rows[7].messages[0].content == '[{"type": "text", "text": "x"}]'
    assert rows[8].prompt == ["to the pier"]
    assert [r.has_prompt for r in rows[9:]] == [False, True]
    for row, body in zip(rows, bodies):
        assert row.estimated_tokens == plain.body_tokens(body), body


def test_request_and_reply_tables(spark, tmp_path):
    requests = spark.createDataFrame(
        [("r1", "c", None, "m", False, [("user", "hi", None)], None)], source.REQUEST_SCHEMA
    )
    requests.write.json(str(tmp_path / "q"))
    assert source.read_requests(spark, str(tmp_path / "q"), "json").first().has_prompt
    replies = spark.createDataFrame([("r1", [(0, ("assistant", "x"), None, "stop")], (1, 2, 3))], source.REPLY_SCHEMA)
    replies.write.parquet(str(tmp_path / "p"))
    assert source.read_replies(spark, str(tmp_path / "p")).first().usage.total_tokens == 3


def test_sse_lines(spark):
    lines = [
        "", ": ping", 'data: {"choices": [{"delta": {"content": "He"}}]}', 'data:{"choices":[{"text":"old"}]}',
        'data: {"choices": [{"delta": {"content": ""}}]}', "data: {oops", "data:  [DONE] ",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq int, line string")
    rows = sse.parse_sse_lines(df).orderBy("seq").collect()
    assert [r.kind for r in rows] == ["blank", "other", "piece", "text", "data", "broken", "done"]
    assert [r.piece for r in rows] == [None, None, "He", "old", None, None, None]
    assert [r.is_done for r in rows] == [False] * 6 + [True]


def outcomes(spark, rows):
    return spark.createDataFrame(
        rows,
        "seq long, outcome string, duration_ms double, prompt_tokens long, estimated_tokens long, "
        "completion_tokens long, repaired boolean, violation boolean",
    )


def test_summary(spark):
    log = outcomes(
        spark,
        [(1, "success", 81.25, 310, 900, 44, True, False), (2, "blocked", 0.5, None, 12, None, False, False),
         (3, "failed", 700.0, 8, 8, 8, False, True), (4, "success", 30.5, None, 57, None, False, False)],
    )
    redactions = spark.createDataFrame([("ssn", 6), ("ipv4", 5)], "category string, n_values long")
    row = telemetry.metrics_summary(log, ["seq"], redactions).first()
    assert (row.total, row.successful, row.failed, row.blocked_rate_limit) == (4, 2, 2, 1)
    assert (row.prompt_total, row.completion_total, row.overall_total) == (367, 44, 411)
    assert (row.schema_repairs, row.schema_violations) == (1, 1)
    assert (row.pii_redactions_total, row.pii_redactions_by_type) == (11, {"ipv4": 5, "ssn": 6})
    assert (row.latency_count, row.latency_average, row.latency_p50, row.latency_p99) == (2, 55.88, 81.25, 81.25)
    text = telemetry.summary_json(telemetry.metrics_summary(log, ["seq"], redactions)).first().metrics
    assert json.loads(text)["safeguards"]["pii_redactions_by_type"]["ssn"] == 6
    totals = {r.category: r.n_redactions for r in telemetry.redaction_totals(redactions).collect()}
    assert totals == {None: 11, "ssn": 6, "ipv4": 5}


def test_latency_keeps_the_last_1000(spark):
    rows = [(i, "success", float(i), None, 0, None, False, False) for i in range(1500)]
    row = telemetry.latency_stats(outcomes(spark, rows), ["seq"]).first()
    assert tuple(row) == (1000, 999.5, 1000.0, 1400.0, 1490.0)
    empty = telemetry.latency_stats(outcomes(spark, rows).where("seq < 0"), ["seq"]).first()
    assert tuple(empty) == (0, 0.0, 0.0, 0.0, 0.0)


def test_outcomes_are_written(spark, tmp_path):
    path = str(tmp_path / "o")
    log = outcomes(spark, [(i, "failed", 60.0 + i, None, 31, None, False, True) for i in range(7)])
    for batch in (0, 1, 1, 0):  # the last two are retries
        telemetry.write_outcomes(log.where(f"seq % 2 = {batch}"), path, batch)
    assert sorted(r.seq for r in spark.read.parquet(path).collect()) == list(range(7))
    stream = spark.readStream.schema(log.schema).parquet(path)
    out = str(tmp_path / "again")
    for attempt in ("a", "b"):  # a second run from the start repeats its batches
        query = stream.writeStream.foreachBatch(telemetry.outcome_sink(out)).trigger(availableNow=True)
        query.option("checkpointLocation", str(tmp_path / attempt)).start().awaitTermination(120)
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == list(range(7))


def test_round_trip_through_both_plans(spark):
    options = guard.GuardOptions.from_dict(
        {
            "pii": {"reversible": True},
            "schema": {"schema": {"type": "object", "required": ["to"]}},
            "budget": {"max_requests_per_minute": 2},
        }
    )
    requests = spark.createDataFrame(
        [(i, "c", i * 1_000_000, [("user", f"Write to u{i}@corp.io", None)], None) for i in range(3)]
        + [(9, "d", 0, None, ["call 212-555-0100"])],
        f"request_id long, client_id string, ts_us long, messages array<{MESSAGE_TYPE}>, prompt array<string>",
    )
    guarded = guard.guard_requests(requests, options)
    rows = {r.request_id: r for r in guarded.collect()}
    assert [rows[i].decision for i in (0, 1, 2, 9)] == ["ok", "ok", "requests", "ok"]
    assert rows[0].messages[0].content == "Write to [EMAIL_1]"
    assert rows[2].messages is None and rows[2].status == 429
    assert rows[9].prompt == ["call [PHONE_1]"]
    replies = spark.createDataFrame(
        [(0, [(("assistant", "{'to': '[EMAIL_1]',}"), None)], (7,)), (1, [(("assistant", "nothing"), None)], None),
         (9, [(None, '{"to": "[PHONE_1]"}')], None)],
        "request_id long, choices array<struct<message:struct<role:string,content:string>,text:string>>, "
        "usage struct<total_tokens:long>",
    )
    done = guard.guard_replies(guarded, replies, options)
    got = {r.request_id: (r.status, r.content) for r in done.collect()}
    assert got == {0: ("repaired", '{"to":"u0@corp.io"}'), 1: ("parse_failed", None), 9: ("ok", '{"to":"212-555-0100"}')}
    settled = {r.request_id: r.settled_tokens for r in guard.settle(guarded, replies, done).collect()}
    assert settled == {0: 7, 9: rows[9].estimated_tokens}
    kept = guard.GuardOptions(ScrubRules(reversible=False), SchemaRules(), Limits())
    irreversible = guard.guard_replies(guard.guard_requests(requests, kept), replies, kept)
    assert "[EMAIL_1]" in irreversible.where("request_id = 0").first().content
