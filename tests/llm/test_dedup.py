"""Fingerprints and components, repeated passages, shards: against brute force and laws."""

from __future__ import annotations

import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilwork.llm import lines, sharding, simhash
from veilwork.llm.components import components


def slow_fingerprint(text, size=3):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, bits=3):
    """fps: fingerprint per id; the least id reachable, per id."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_of_texts():
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "Ähre", "x", "été", "ZZ9", " wide", "\x1cunit"]
    for n in [0, 1, 2, 3, 4, 40, 400]:
        text = rng.choice([" ", "\n", "\t "]).join(rng.choice(vocabulary) for _ in range(n))
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n\t") == 0
    assert simhash.fingerprint("a b c " * 70_000) == slow_fingerprint("a b c " * 70_000)


def test_chains_pass_every_close_pair():
    rng = random.Random(8)
    for _ in range(3000):
        a = rng.getrandbits(64)
        flips = rng.sample(range(64), rng.randint(0, 5))
        b = a
        for f in flips:
            b ^= 1 << f
        near = bool(simhash._ring_near(np.array([a ^ b], np.uint64), 3)[0])
        assert near == (len(flips) <= 3)
        if near:
            assert any(not (a ^ b) & simhash._head_mask(s, q) for s, q in simhash._chain_heads())
            mask = next(simhash._head_mask(s, q) for s, q in simhash._chain_heads() if not (a ^ b) & simhash._head_mask(s, q))
            while finer := simhash._refined(mask):
                mask = next(m for m in finer if not (a ^ b) & m)  # some finer key is shared as well


def test_links_connect_a_dense_ball(spark):
    """Many fingerprints under one key: keyed anew until blocks are small, with the same components."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:
        x = centre
        for f in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << f
        fps.add(x)
    for _ in range(150):
        fps.add(rng.getrandbits(64))
    ordered = sorted(fps)
    df = spark.createDataFrame([(signed(f),) for f in ordered], "fp long").repartition(4)
    roots = {r["node"]: r["root"] for r in components(simhash.near_links(df, block=12)).collect()}
    got = defaultdict(set)
    for f in ordered:
        got[roots.get(signed(f), signed(f))].add(f)
    want = defaultdict(set)
    for f, root in slow_components({f: f for f in ordered}).items():
        want[root].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(60)] + [(7, 7), (500, 501), (501, 500)]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(60)) and got[501] == 500
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_components(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        rows.append((3 * i + 5, " ".join(base)))
        if i % 3 == 0:
            rows.append((3 * i + 6, " ".join(base).upper()))
        if i % 4 == 0 and len(base) > 60:
            base[10] = "changed"
            rows.append((3 * i + 7, "\n".join(base)))
    rows += [(900, None), (901, ""), (902, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).repartition(3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(df).collect()}
    fps = {i: slow_fingerprint(t) for i, t in rows}
    want = slow_components(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_simhash_odd_rows(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, None), (9, "q r s t u")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.simhash_components(df).collect())
    assert got == {(None, 4): 1, (4, 4): 2, (None, None): 1, (9, 9): 1}
    extra = df.withColumn("row_no", F.lit("mine")).withColumn("fp", F.lit(1))
    kept = simhash.drop_near_copies(extra).collect()
    assert sorted((r["doc_id"] or 0, r["row_no"], r["fp"]) for r in kept) == [(0, "mine", 1), (4, "mine", 1), (9, "mine", 1)]
    assert simhash.simhash_components(df.where("false")).count() == 0
    assert simhash.drop_near_copies(df.where("false")).count() == 0


SENTENCES = [f"Sentence {chr(97 + i)} has some {i} words of its very own kind{i}." for i in range(26)]
PASSAGE = (
    "Here begins a passage that many pages share, with a clause or two, and with lines of its own.\nIt goes on for a while, "
    "as such passages do, so that a hash of lines finds it wherever it stands; then it adds one more clause, and another one. "
    "After that comes a last sentence, which nobody reads, and which ends the passage for good."
)


def test_chunks_cover_and_resist_shifts():
    for text in ["", " ", "one", "a, b. c\n\n\nd; e", PASSAGE, "x" * 5000, "\n" * 40 + "end"]:
        spans = lines.chunks(text)
        assert "".join(text[a:b] for a, b in spans) == (text if text.strip() else "")
    own = {PASSAGE[a:b].strip() for a, b in lines.chunks(PASSAGE)}
    moved = "Something before it, and more of it here " + PASSAGE + " and after it."
    shared = own & {moved[a:b].strip() for a, b in lines.chunks(moved)}
    assert len(shared) >= len(own) - 3


def test_repeated_passages_go_once(spark):
    rows = [
        (0, f"{SENTENCES[0]} {SENTENCES[1]} head {PASSAGE} tail {SENTENCES[2]}"),
        (1, f"{SENTENCES[3]} other {PASSAGE} rest {SENTENCES[4]}\n{SENTENCES[5]}"),
        (2, f"{SENTENCES[6]}\n{SENTENCES[7]}"),
        (3, f"{PASSAGE} {SENTENCES[8]}"),
        (4, None),
        (5, ""),
        (6, f"{SENTENCES[0]} short repeat only."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in lines.drop_repeats(df).collect()}
    assert got[0]["text"] == rows[0][1] and got[0]["lost_words"] == 0
    assert got[1]["text"] == f"{SENTENCES[3]} other\nrest {SENTENCES[4]}\n{SENTENCES[5]}"
    assert got[1]["lost_words"] == len(PASSAGE.split()) and got[1]["lost_passages"] == 1
    assert got[3]["text"] == SENTENCES[8]
    assert all(got[i]["text"] == rows[i][1] and got[i]["lost_passages"] == 0 for i in (2, 4, 5, 6))


def test_passages_cut_in_anywhere_are_found(spark):
    """Fifty to sixty words, or twenty, within texts without line ends; blanks of any kind; longer than any context."""
    rng = random.Random(6)
    own = lambda n: " ".join(f"{rng.choice('abcdefghé')}{rng.randrange(10**6)}" for _ in range(n))
    shared = [own(n) for n in (*rng.choices(range(50, 61), k=30), 20, 20, 20, 3000)] + [own(25).replace(" ", "\xa0")]
    first = [(i, f"{own(rng.randint(0, 40))} {p} {own(30)}") for i, p in enumerate(shared)]
    parts = [(own(rng.randint(1, 60)), own(rng.randint(1, 60))) for _ in shared]
    again = [(100 + i, f"{a} {p} {b}") for i, (p, (a, b)) in enumerate(zip(shared, parts))]
    loop = own(30)
    df = spark.createDataFrame([*first, *again, (200, " ".join([loop] * 9)), (201, "la " * 90)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in lines.drop_repeats(df).collect()}
    assert all(got[i]["text"] == t and not got[i]["lost_words"] for i, t in first)
    assert [got[100 + i]["text"] for i in range(len(shared))] == [f"{a} {b}" for a, b in parts]
    assert [got[100 + i]["lost_words"] for i in range(len(shared))] == [len(p.split()) for p in shared]
    assert got[200]["text"].startswith(loop) and got[200]["lost_words"] >= 30 * 8 - 20
    assert 20 <= 90 - got[201]["lost_words"] <= 60


def test_repeated_rows_and_other_columns(spark):
    long = " ".join(SENTENCES)
    rows = [(1, long, "a"), (1, long, "a"), (None, long, None), (2, PASSAGE, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").coalesce(1)
    got = lines.drop_repeats(df).collect()
    assert Counter((r["doc_id"], r["row"], bool(r["text"])) for r in got) == {
        (1, "a", True): 1, (1, "a", False): 1, (None, None, False): 1, (2, "b", True): 1,
    }
    kept = lines.keep_first_passages(df)
    assert kept.columns == df.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, long), (2, PASSAGE)]
    assert lines.drop_repeats(df.where("false")).count() == 0


def test_own_rest_of_a_document_stays(spark):
    rng = random.Random(12)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    licence = own(400)
    rests = [own(n) for n in (90, 30, 5)]
    rows = [(0, licence), *[(i + 1, f"{licence} {r}") for i, r in enumerate(rests)], (9, licence), (10, ""), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = {r["doc_id"]: r["text"] for r in lines.keep_first_passages(df).collect()}
    assert kept == {0: licence, **{i + 1: r for i, r in enumerate(rests)}, 10: "", 11: None}


def long_runs(rows, size=50):
    """Per id, places of the runs of ``size`` words or more that an earlier row has, byte for byte."""
    seen = set()
    for key, text in rows:
        words = [m.span() for m in re.finditer(r"\S+", text or "")]
        parts = [text[words[i][0] : words[i + size - 1][1]] for i in range(len(words) - size + 1)]
        at = [i for i, part in enumerate(parts) if part in seen]
        for i in at:
            if i - 1 not in at[max(0, at.index(i) - 1) : at.index(i)]:
                yield key, text[words[i + 15][0] : words[i + size - 16][1]]  # the middle of the run's first part
        seen.update(parts)


def test_runs_of_fifty_words_in_the_tables_go(spark):
    """Recall against brute force, on whole texts of a given table."""
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").coalesce(1).sortWithinPartitions("doc_id")
    docs = docs.checkpoint()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    left = {r["doc_id"]: r["text"] for r in lines.drop_repeats(docs).collect()}
    whole = dict(rows)
    runs = list(long_runs(rows))
    stayed = [k for k, part in runs if (left[k] or "").count(part) >= whole[k].count(part)]
    assert len(runs) > 50 and len(stayed) <= 0.01 * len(runs)


def test_clashing_columns_stay_as_they_are(spark):
    rows = [(1, PASSAGE, "mine", 7, None), (2, f"own words {PASSAGE}", "yours", 8, "x"), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, TEXT string, words string, LOST_words int, origins string").coalesce(1).checkpoint()
    found = lines.drop_repeats(df)
    assert found.columns == [*df.columns, "words_", "lost_words_", "lost_passages"]
    got = {r["doc_id"]: tuple(r) for r in found.collect()}
    size = len(PASSAGE.split())
    assert got[1] == (1, PASSAGE, "mine", 7, None, size, 0, 0)
    assert got[2] == (2, "own words", "yours", 8, "x", size + 2, size, 1)
    assert got[3] == (3, None, None, None, None, 0, 0, 0)
    assert lines.keep_first_passages(df).columns == df.columns


def test_short_lines_and_verses(spark):
    """Lines of a word or two end no chunk each, and a passage of them is found all the same."""
    rng = random.Random(21)
    own = lambda n: "".join(f"v{rng.randrange(10**6)}" + rng.choice([",\n", " ", ". ", "\n"]) for _ in range(n))
    verses = [own(60) for _ in range(40)]
    first = [(i, own(9) + v + own(9)) for i, v in enumerate(verses)]
    again = [(100 + i, own(rng.randint(1, 30)) + v + own(rng.randint(1, 30))) for i, v in enumerate(verses)]
    df = spark.createDataFrame([*first, *again], "doc_id long, text string").coalesce(1).checkpoint()
    got = {r["doc_id"]: r for r in lines.drop_repeats(df).collect()}
    assert all(got[i]["lost_words"] == 0 for i in range(40))
    assert sum(got[100 + i]["lost_words"] >= 58 for i in range(40)) >= 39


def test_hash_alone_removes_nothing():
    text = SENTENCES[0] + " " + SENTENCES[1]
    origin = {"first": 0, "size": len(lines.chunks(text)), "from_row": 9, "from_end": 0, "body": "another text", "before": "", "after": ""}
    assert lines.passages(text, [origin], 1) == []


def test_shards(spark):
    rows = [(i if i % 7 else None, None if i % 11 == 0 else "é" * (i % 50), "keep") for i in range(503)] + [(1, "same", "keep")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, position string").repartition(5)
    df = df.checkpoint()
    got = sharding.shuffle_into_shards(df, shards=7, bucket_bytes=4000).collect()
    assert Counter((r["doc_id"], r["text"], r["position"]) for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    copies = Counter(r["shard"] for r in got if r["text"] == "same")
    assert min(copies.values()) > 30  # copies spread like all rows
    assert sharding.shuffle_into_shards(df.where("false"), shards=7).count() == 0
    few = sharding.shuffle_into_shards(df.limit(3).checkpoint(), shards=7).collect()
    assert len(few) == 3 and len({r["shard"] for r in few}) == 3


def test_written_shards(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.groupBy("shard").count().where("count = 25").count() == 4


def test_simhash_tasks_need_no_pandas():
    """A worker that imports it keeps it from stage to stage."""
    code = "import sys, veilwork.llm.simhash; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], timeout=60).returncode == 0


def test_packing_tasks_need_no_pandas():
    code = "import sys, veilwork.llm.packing; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], timeout=60).returncode == 0


def test_texts_are_packed_and_shuffled_once(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(40)) + f" own{i}.") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").checkpoint()
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan is known before it runs
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = lines.drop_repeats(docs)
        assert found._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") == 1
        assert sum(r["lost_passages"] for r in found.collect()) == 19
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
