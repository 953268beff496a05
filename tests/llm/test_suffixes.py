"""Repeated byte runs: against plain Python over whole texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.llm import suffixes

MOST = (1 << 63) - 1


def slow(rows):
    """doc_id, bytes, removed, spans and the digest of what is left, per row."""
    least = {}
    raws = [((MOST if k is None else k), (t or "").encode()) for k, t in rows]
    for doc, raw in raws:
        for p in range(len(raw) - 49):
            s = raw[p : p + 50]
            least[s] = min(doc, least.get(s, MOST))
    out = []
    for (key, _), (doc, raw) in zip(rows, raws):
        gone = [False] * len(raw)
        for p in range(len(raw) - 49):
            if least[raw[p : p + 50]] < doc:
                gone[p : p + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((key, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, parts=3, **options):
    docs = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "n int, doc_id bigint, text string, row string")
    docs = docs.repartition(parts, "n").checkpoint()
    found = suffixes.without_repeats(docs, **options).select(
        "doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.begin)"), F.size("spans"), F.sha2("kept", 256)
    )
    return sorted(map(tuple, found.collect()), key=repr)


def prose(rng, n, words=("the", "of", "Ähre", "lorem", "a", "été", "quick", "日本")):
    return rng.choice([" ", ", "]).join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


def planted(seed):
    rng = random.Random(seed)
    shared = [prose(rng, n) for n in (9, 12, 30, 200)]
    tight = "".join(rng.choices("abcdefgh", k=50))
    rows = []
    for i in range(90):
        text = prose(rng, rng.choice([0, 3, 20, 80]))
        for _ in range(rng.randrange(3)):
            cut = rng.randrange(len(text) + 1)
            passage = rng.choice(shared)
            if rng.random() < 0.5:  # a part of it
                a = rng.randrange(len(passage))
                passage = passage[a : a + rng.randrange(30, 120)]
            text = text[:cut] + passage + text[cut:]
        rows.append((rng.randrange(120), text))
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [rows[3], rows[3], (None, rows[4][1]), (None, shared[3]), (None, shared[3])]
    rows += [(300, None), (301, ""), (302, "x" * 49), (303, "x" * 50), (304, "x" * 51), (305, "y" * 3000), (306, "z" + "y" * 400)]
    rows += [(310, tight), (309, "-" + tight + "+"), (308, tight[1:] + "?"), (307, tight[:-1]), (311, "ab" * 300), (312, "ab" * 90 + "c" * 60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_plain_python(spark, seed):
    rows = planted(seed)
    expected = slow(rows)
    assert sum(r[2] for r in expected) > 5000
    assert got(spark, rows) == expected
    assert got(spark, rows, parts=40) == expected  # hashes meet across batches


def test_large_groups_are_not_gathered(spark):
    rows = planted(4)
    assert got(spark, rows, group=1) == slow(rows)
    rng = random.Random(6)
    passage = prose(rng, 14)
    rows = [(i, prose(rng, 3) + passage + prose(rng, 3)) for i in range(700)]
    assert got(spark, rows, parts=5) == slow(rows)


def test_very_long_texts(spark, monkeypatch):
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefghij ", k=150_000))
    rows = [(1, long), (2, "q" + long[70_000:140_000] + "q" + long[:100]), (3, long[-51:]), (0, long[5000:5060])]
    expected = slow(rows)
    assert got(spark, rows) == expected
    data = np.frombuffer((long * 10).encode(), np.uint8)  # longer than a piece
    found = list(suffixes.stretches(data, np.array([0, 10, 10, len(data)])))
    strings = np.concatenate([np.arange(a, b + 1) for _, first, last, _ in found for a, b in zip(first, last)])
    assert (strings == np.arange(10, len(data) - 49)).all()


def test_empty_table_and_other_columns(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, None)]) == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest()), (2, 0, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_kept_and_spans(spark):
    passage = "".join(random.Random(3).choices("abcdefgh ", k=80))
    docs = spark.createDataFrame([(1, "x" + passage), (2, "Ä" + passage + "ö")], "doc_id bigint, text string").checkpoint()
    rows = {r["doc_id"]: r for r in suffixes.without_repeats(docs).collect()}
    assert bytes(rows[1]["kept"]).decode() == "x" + passage and rows[1]["spans"] == []
    assert bytes(rows[2]["kept"]).decode() == "Äö" and [tuple(s) for s in rows[2]["spans"]] == [(2, 82)]


def test_sorting_against_python():
    rng = random.Random(1)
    for alphabet in (b"a", b"ab", b"abc\x00\xff", bytes(range(256))):
        raw = bytes(rng.choices(alphabet, k=600)) + bytes(rng.choices(alphabet, k=100)) * 4
        data = np.frombuffer(raw, np.uint8)
        starts = np.array(rng.sample(range(len(raw) - 50), 700))
        order, fresh = suffixes.deep_shallow_sort(data, starts)
        texts = [raw[s : s + 50] for s in starts[order]]
        assert texts == sorted(texts) and sorted(order) == list(range(700))
        assert fresh.tolist() == [i == 0 or texts[i] != texts[i - 1] for i in range(700)]
        values = np.array([rng.randrange(99) for _ in starts])
        least = {}
        for s, v in zip(starts, values):
            least[raw[s : s + 50]] = min(v, least.get(raw[s : s + 50], 999))
        assert suffixes.least_of_classes(data, starts, values).tolist() == [least[raw[s : s + 50]] for s in starts]
    empty = np.zeros(0, np.int64)
    assert len(suffixes.deep_shallow_sort(np.zeros(0, np.uint8), empty)[0]) == 0
