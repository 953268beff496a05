"""Admission with settle times: against an event-by-event walk."""

from __future__ import annotations

import random

import pytest

from veilwork.operators.budgets import Limits, admit_requests
from veilwork.operators.settlement import admit_settled


def walk(rows, limits):
    """rows: request, client, ts, tokens, settled, recorded. Decision, requests and tokens seen per request."""
    window = limits.sliding_window_seconds * 1_000_000
    kept, out = {}, {}
    for request, client, ts, tokens, settled, recorded in sorted(rows, key=lambda r: (r[2], r[0])):
        if limits.max_tokens_per_request > 0 and tokens > limits.max_tokens_per_request:
            out[request] = ("oversize", None, None)
            continue
        seen = [k for t, k in kept.setdefault(client, []) if ts - window <= t <= ts]
        if 0 < limits.max_requests_per_minute <= len(seen):
            verdict = "requests"
        elif 0 < limits.max_tokens_per_minute < sum(seen) + tokens:
            verdict = "tokens"
        else:
            verdict = "ok"
            if settled is not None:
                kept[client].append((max(ts, settled), recorded))
        out[request] = (verdict, len(seen), sum(seen))
    return out


COLUMNS = "request_id bigint, client_id string, ts_us bigint, tokens bigint, settled_us bigint, recorded bigint"


def log(rng, n, longest):
    rows, ts = [], 1_700_000_000_000_000
    for i in range(n):
        ts += rng.choice([0, 0, 1, 300_000, 900_000, 4_000_000, rng.choice([20_000_000, 90_000_000])])
        wait = rng.choice([-5, 0, 1, rng.randrange(longest)])
        rows.append((i, rng.choice("aaab"), ts, rng.randrange(60), None if rng.random() < 0.1 else ts + wait, rng.randrange(80)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "seed, longest, rows_per_task",
    [(1, 2_000_000, 50), (1, 30_000_000, 1), (2, 30_000_000, 10**6), (2, 400_000_000, 9), (3, 400_000_000, 60), (3, 2_000_000, 10**6)],
)
def test_against_a_walk(spark, seed, longest, rows_per_task):
    rows = log(random.Random(seed), 90 if rows_per_task < 10 else 700, longest)
    limits = Limits(max_tokens_per_request=55, max_requests_per_minute=4, max_tokens_per_minute=150, sliding_window_seconds=10)
    if rows_per_task == 1:
        rows = [r for r in rows if r[0] < 40]
    df = spark.createDataFrame(rows, COLUMNS)
    got = admit_settled(df, limits, recorded="recorded", rows_per_task=rows_per_task).collect()
    expected = walk(rows, limits)
    assert {r["request_id"]: r["decision"] for r in got} == {k: v[0] for k, v in expected.items()} and len(got) == len(rows)
    for r in got:
        if r["current_requests"] is not None:  # replayed
            assert (r["current_requests"], r["current_tokens"]) == expected[r["request_id"]][1:]
    assert {r["status"] for r in got} <= {200, 400, 429}


def test_settled_on_arrival_is_plain_admission(spark):
    rows = [(i, c, t, k, t, k) for i, c, t, k, _, _ in log(random.Random(7), 600, 10)]
    limits = Limits(max_tokens_per_request=55, max_requests_per_minute=3, max_tokens_per_minute=90, sliding_window_seconds=20)
    df = spark.createDataFrame(rows, COLUMNS)
    pick = lambda found: sorted((r["request_id"], r["decision"], r["status"]) for r in found.collect())
    assert pick(admit_settled(df, limits)) == pick(admit_requests(df, limits))


def test_switches_and_failures(spark):
    df = spark.createDataFrame([(i, "a", 10 + i, 50, None, 50) for i in range(9)], COLUMNS)
    one = Limits(max_requests_per_minute=1, max_tokens_per_minute=60)
    assert {r["decision"] for r in admit_settled(df, one).collect()} == {"ok"}  # failed replies record nothing
    off = admit_settled(df, Limits(enabled=False)).collect()
    assert len(off) == 9 and {r["decision"] for r in off} == {"ok"}
    assert admit_settled(df.where("false"), one).count() == 0
