"""Centroid clustering and ranked search: against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np

from veilwork.llm import clustering, search


def slow_clusters(rows, clusters=40, rounds=5):
    kept = []
    for key, vector in rows:
        if vector is not None and len(vector) == 64 and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((key, [max(-(1 << 26), min(1 << 26, math.floor(256 * x))) for x in vector]))

    def digest(key):
        return hashlib.sha256(f"2:{'' if key is None else key}".encode()).hexdigest()

    def apart(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    centroids = [v for _, v in sorted((digest(k), v) for k, v in kept)[:clusters]]

    def nearest(v):
        return min(range(len(centroids)), key=lambda k: (apart(v, centroids[k]), k))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, centroids)]
    out = []
    for key, v in kept:
        k = nearest(v)
        out.append((key, k, apart(v, centroids[k]), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()))
    inertia = Counter()
    for _, k, d, _ in out:
        inertia[k] += d
    return sorted(((key, k, d, inertia[k], sum(inertia.values()), sha) for key, k, d, sha in out), key=repr)


def clustered(spark, rows, **options):
    vectors = spark.createDataFrame([(k, v, 7) for k, v in rows], "vec_id bigint, embedding array<double>, cluster int")
    return sorted(map(tuple, clustering.cluster_vectors(vectors, **options).collect()), key=repr)


def test_clusters_against_plain_python(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) + i % 5 for _ in range(64)]) for i in range(150)]
    rows += [(i, list(rows[3][1])) for i in (900, 901, 3)]  # copies, one with the id of another row
    rows += [(None, [0.5] * 64), (None, [0.25] * 64), (10, None), (11, [1.0] * 63), (12, []), (13, [None] + [1.0] * 63)]
    rows += [(14, [math.nan] + [0.0] * 63), (15, [math.inf] + [0.0] * 63), (16, [1e300, -1e300] + [0.0] * 62), (17, [1e7] * 64)]
    assert clustered(spark, rows) == slow_clusters(rows)
    assert clustered(spark, rows[:7], clusters=40) == slow_clusters(rows[:7])
    assert clustered(spark, [(1, [0.1] * 64)] * 50, clusters=4) == slow_clusters([(1, [0.1] * 64)] * 50, clusters=4)
    assert clustered(spark, []) == [] and clustered(spark, [(1, None), (2, [1.0])]) == []


def test_tournament_gives_ties_to_the_smaller_number():
    rng = np.random.default_rng(1)
    for spread in (2, 3, 1 << 25):
        centroids = rng.integers(-spread, spread, (40, 64))
        centroids[20:30] = centroids[5:15]
        vectors = np.concatenate([rng.integers(-spread, spread, (200, 64)), (centroids[:20] + centroids[20:]) // 2])
        apart = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        tournament = clustering.Tournament(centroids)
        won = tournament.nearest(vectors)
        assert (won == apart.argmin(axis=1)).all()  # argmin takes the first
        assert (tournament.distances(vectors, won) == apart.min(axis=1)).all()


WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_ranks(docs, items, top=20):
    held = [(k, WORD.findall((t or "").translate(LOWER))) for k, t in docs]
    held = [(k, t) for k, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    out = []
    for item, text in items:
        scores = []
        for key, terms in held:
            tf, m = Counter(terms), 75 + (25 * len(terms) * n) // total
            score = 0
            for w in WORD.findall((text or "").translate(LOWER)):
                if tf[w]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * m))
            if score > 0:
                scores.append((-score, key is None, key))
        out += [(item, r + 1, k, -s) for r, (s, _, k) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **options):
    left = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id bigint, text string, rank int, query string")
    right = spark.createDataFrame([(k, t, 2) for k, t in items], "item_id bigint, text string, score int")
    return sorted(map(tuple, search.rank_documents(left, right, **options).collect()), key=repr)


def test_ranks_against_plain_python(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"W{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["Ähre", "ähre", "x-y", "été", "z_z", "日本"]

    def text(n):
        return rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(n))

    docs = [(i, text(rng.choice([1, 3, 30, 200]))) for i in range(1500)]
    docs += [(i + 2000, docs[7][1]) for i in range(60)] + [(7, docs[7][1]), (None, docs[7][1]), (None, None), (3000, ""), (3001, " -- ")]
    docs.append((3002, text(40_000)))
    items = [(i, text(rng.choice([1, 5, 60]))) for i in range(30)] + [(0, docs[7][1]), (40, docs[7][1]), (41, None), (42, "-"), (43, "nowhere")]
    items += [(None, docs[9][1]), (44, text(3000))]
    expected = slow_ranks(docs, items)
    assert ranked(spark, docs, items) == expected
    monkeypatch.setattr(search, "BLOCK_BYTES", 400)  # many blocks
    assert ranked(spark, docs[:300], items[:9]) == slow_ranks(docs[:300], items[:9])
    assert ranked(spark, docs, items[:9], top=1) == slow_ranks(docs, items[:9], top=1)
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == [] and ranked(spark, [(1, None)], items) == []


def test_buckets_and_bounds_lose_nothing():
    """Many buckets, of which the bounds leave out most."""
    rng = random.Random(2)
    common = [f"c{i}" for i in range(20)]
    rare = [f"r{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(common, k=50) + rng.choices(rare, k=10 if i % 9 else 1)) for i in range(4000)]
    tokens = [search.terms_of(t) for t in texts]
    df = Counter(w for t in tokens for w in set(t))
    queries = search.Queries([tokens[5], tokens[77]], len(texts), sum(map(len, tokens)), df)
    held = search.Documents(texts, queries)
    assert len(held.buckets) > 4
    for number in (0, 1):
        got = search.best_of(held, queries, number, np.arange(len(texts)))
        scores = sorted(((s, -d) for d, s in enumerate(plain_scores(tokens, tokens[(5, 77)[number]], df))), reverse=True)
        assert got == [(s, -d) for s, d in scores[:20] if s > 0]


def plain_scores(tokens, asked, df):
    n, total = len(tokens), sum(map(len, tokens))
    for t in tokens:
        tf, m = Counter(t), search.length_factor(len(t), n, total)
        yield sum(search.weight(n, df[w]) * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in asked if tf[w])
