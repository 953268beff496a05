from __future__ import annotations

import random

import plain
import pytest
from pyspark.sql import functions as F

from veilwork.functions.tokens import (
    count_tokens,
    estimate_tokens,
    request_tokens,
)
from veilwork.functions.masking import MESSAGE_TYPE
from veilwork.operators import budgets
from veilwork.operators.budgets import SECOND, Limits


def test_estimate_matches_plain(spark):
    rng = random.Random(1)
    bits = ["a", "Z", "9", "_", " ", " ", "\n", "\n", "\t", "é", "²", ".", "-", "　", "abcdefgh",
            " " * 8, "\n" * 8, "\x1c", "foo_bar"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(8000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", estimate_tokens(F.col("t")).alias("n")).collect():
        assert row.n == plain.tokens(row.t)


def test_messages_before_prompts(spark):
    df = spark.createDataFrame(
        [
            ([("user", "What is it?", None), ("user", None, [("text", "two words", None), ("image", "no", "u")])], None),
            ([], ["Prompt 1", "Prompt 2"]),
            (None, None),
        ],
        f"m array<{MESSAGE_TYPE}>, p array<string>",
    )
    got = [r[0] for r in df.select(request_tokens(F.col("m"), F.col("p"))).collect()]
    t = plain.tokens
    assert got == [
        3 + 3 + t("user") + t("What is it?") + 3 + t("user") + t("two words"),
        t("Prompt 1") + t("Prompt 2"),
        0,
    ]


def test_encoder_with_fallback(spark):
    def encode(text):
        if "!" in text:
            raise ValueError
        return list(text)

    df = spark.createDataFrame([("abc",), ("hi !",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(count_tokens(F.col("t"), encode)).collect()]
    assert got == [3, plain.tokens("hi !"), 0, 0]


def log(spark, rows):
    return spark.createDataFrame(rows, "request_id long, client_id int, ts_us long, tokens long")


LIMITS = [
    Limits(max_tokens_per_request=55, max_requests_per_minute=12, max_tokens_per_minute=300),
    Limits(max_tokens_per_request=0, max_requests_per_minute=0, max_tokens_per_minute=500),
    Limits(max_requests_per_minute=30, max_tokens_per_minute=-1),
    Limits(max_tokens_per_minute=40, max_requests_per_minute=3),
    Limits(),
]


def traffic(n=3000, seed=2):
    rng = random.Random(seed)
    # client 0 sends half of everything
    return [
        (i, rng.choice([0, 0, 0, 1, 2, 3]), rng.choice([1, 1, 5]) * rng.randint(0, 20000) * 100_000,
         rng.randint(0, 60))
        for i in range(n)
    ]


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("rows_per_task", [10_000_000, 200])
def test_admission_matches_plain(spark, limits, rows_per_task):
    rows = traffic()
    got = budgets.admit_requests(log(spark, rows), limits, rows_per_task=rows_per_task).collect()
    assert {r.request_id: r.decision for r in got} == plain.admit(rows, limits)
    assert len(got) == len(rows)


@pytest.mark.parametrize("rows_per_task", [1, 2, 3, 7])
def test_admission_in_small_parts(spark, rows_per_task):
    """Quiet slots that alone fill a part, and parts shorter than the window."""
    limits = Limits(max_requests_per_minute=5, max_tokens_per_minute=0)
    rows = [(i, 1, (50 + i) * SECOND, 1) for i in range(4)] + [(10 + i, 1, (60 + i) * SECOND, 1) for i in range(6)]
    rows += [(20 + i, 2, i * 7 * SECOND, 1) for i in range(12)]
    got = budgets.admit_requests(log(spark, rows), limits, rows_per_task=rows_per_task).collect()
    assert {r.request_id: r.decision for r in got} == plain.admit(rows, limits)
    assert sum(r.decision == "requests" for r in got if r.client_id == 1) == 5


def decide(spark, limits, *amounts):
    rows = [(i, 1, i * SECOND, k) for i, k in enumerate(amounts)]
    got = budgets.admit_requests(log(spark, rows), limits).orderBy("request_id").collect()
    return [(r.decision, r.status) for r in got]


def test_request_cap(spark):
    limits = Limits(max_tokens_per_request=100, max_requests_per_minute=2, max_tokens_per_minute=150)
    assert decide(spark, limits, 50, 60, 10) == [("ok", 200), ("ok", 200), ("requests", 429)]


def test_token_cap_with_402(spark):
    limits = Limits(1, 1000, 100, 200, reject_status_code=402)
    assert decide(spark, limits, 150, 60) == [("ok", 200), ("tokens", 402)]


def test_oversize_is_always_400(spark):
    assert decide(spark, Limits(max_tokens_per_request=50, reject_status_code=402), 60) == [("oversize", 400)]


def test_disabled_admits_all(spark):
    assert decide(spark, Limits(enabled=False, max_tokens_per_request=1), 60, 70) == [("ok", 200)] * 2


def test_window_edge_is_inclusive(spark):
    limits = Limits(max_requests_per_minute=1)
    rows = [(0, 1, 0, 1), (1, 1, 60 * SECOND, 1), (2, 1, 60 * SECOND + 1, 1)]
    got = budgets.admit_requests(log(spark, rows), limits).orderBy("request_id").collect()
    assert [r.decision for r in got] == ["ok", "requests", "ok"]


def test_rejection_detail(spark):
    limits = Limits(max_requests_per_minute=1, max_tokens_per_request=50, reject_status_code=402)
    decided = budgets.admit_requests(log(spark, [(0, 1, 0, 9), (1, 1, 1, 9), (2, 1, 2, 99)]), limits)
    columns = [F.col(c) for c in ("decision", "tokens", "current_requests", "current_tokens")]
    got = {r[0]: r[1] for r in decided.select("request_id", budgets.rejection_detail(*columns, limits)).collect()}
    assert got[0] is None
    assert got[1].message == "Request rate limit exceeded. Max 1 requests per 60s."
    assert (got[1].type, got[1].code) == ("budget_exhausted_error", "insufficient_quota")
    assert got[1].details.current_requests == 1
    assert got[2].message == "Estimated prompt tokens (99) exceeds max allowed per request (50)."


@pytest.mark.parametrize("seconds, bucket", [(60, 600), (60, 7), (600, 1), (10**7, 60)])
def test_window_usage(spark, seconds, bucket):
    rows = traffic(800, 3)
    got = {r.request_id: r for r in budgets.window_usage(log(spark, rows), seconds, bucket_seconds=bucket).collect()}
    assert len(got) == len(rows)
    for request, client, ts, _ in rows:
        past = [r for r in rows if r[1] == client and r[2] <= ts]
        inside = [r for r in past if r[2] >= ts - seconds * SECOND]
        r = got[request]
        assert (r.window_requests, r.window_tokens) == (len(inside), sum(x[3] for x in inside))
        assert (r.lifetime_requests, r.lifetime_tokens) == (len(past), sum(x[3] for x in past))


def test_usage_at_and_totals(spark):
    df = log(spark, [(0, 1, 0, 5), (1, 1, 50 * SECOND, 7), (2, 2, 90 * SECOND, 9)])
    got = {r.client_id: tuple(r)[1:] for r in budgets.usage_at(df, 100 * SECOND, 60).collect()}
    assert got == {1: (1, 7, 2, 12), 2: (1, 9, 1, 9)}
    assert {r.client_id: r.lifetime_tokens for r in budgets.client_totals(df).collect()} == {1: 12, 2: 9}


def test_settlement(spark):
    requests = log(spark, [(0, 1, 0, 5), (1, 1, 1, 5), (2, 1, 2, 0), (3, 1, 3, 4), (4, 1, 4, 6)])
    replies = spark.createDataFrame(
        [(0, 40, None), (1, None, None), (2, None, None), (4, None, 3)],
        "request_id long, total_tokens long, n_chunks long",
    )
    got = budgets.settle_usage(requests, replies, chunks="n_chunks").collect()
    assert {r.request_id: r.settled_tokens for r in got} == {0: 40, 1: 5, 4: 9}
