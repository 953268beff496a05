"""Language, quality, benchmark passages, toxicity, language model, packing and pages: against brute force."""

from __future__ import annotations

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.llm import decontam, extraction, langid, lines, lm, packing, quality, simhash, toxicity
from veilwork.llm.base import lean

SF_DIR = os.environ.get("VEILWORK_SF_DIR", "/root/testdata/sf0.001")
has_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "the word"), (5, "12 34 !!"), (5, "12 34 !!"), (7, "a" * 30_000), (8, "x y " * 8000)]


def odd_rows(spark):
    """Null, blank, long and repeated rows, and a column whose name an operator might use."""
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("score", F.lit("mine"))


def number(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


# language


def test_word_first_then_longer_grams_first():
    counts = [(0, "a", "tree", 2), (0, "b", "baum", 2), (1, "a", "t", 9), (1, "b", "x", 9), (2, "a", "tr", 3), (2, "b", "ba", 3)]
    model = langid.Model(["a", "b"], counts)
    assert np.argmax(model.word("tree")) == 0 and np.argmax(model.word("baum")) == 1
    assert np.argmax(model.word("bat")) == 1  # two letters known in b go before one in a
    assert np.argmax(model.word("t")) == 0
    assert len(set(model.word("zzz"))) == 1
    score = langid.Scorer(model)
    assert score("Tree, TREE!")[0] == "a" and score("12 %")[0] == score(None)[0] == "und"
    assert langid.Scorer(langid.Model([], []))("text") == ("und", 0.0)


@has_tables
def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (number(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


def test_language_odd_rows(spark):
    df = odd_rows(spark)
    got = Counter((r["doc_id"], r["lang_pred"]) for r in langid.identify(df).collect())
    und = {(1, "und"): 1, (2, "und"): 1, (3, "und"): 1, (5, "und"): 2}
    assert got == {**und, (None, "en"): 1, (7, "en"): 1, (8, "en"): 1}
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {None, 7, 8}
    assert langid.identify(df.where("false")).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# quality


def slow_rules(text):
    blanks = " \t\n\r\x0b\x0c"
    text = text or ""
    for b in blanks[1:]:
        text_words = text = text.replace(b, " ") if b != "\n" else text
    words = text_words.replace("\n", " ").split(" ")
    words = [w for w in words if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(again)


def test_counted_rules(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "a b c a b c", "x " * 90, "a b c d a b c", "#*$%&|<> é ü", "l\nl\n\nl\n \n \nm"]
    texts += [" ".join(rng.choice("abcd#") for _ in range(rng.randint(1, 200))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(9, 1, 0), (9, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.judge(df, labels).collect()}
    for i, text in enumerate(texts):
        n, chars, symbols, again = slow_rules(text)
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_repeat_words"]) == (n, chars, symbols, again)
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n)
        assert not (r["kept"] and r["base_failed"])
    assert rows[7]["n_dup_lines"] == 2


def test_ratio_prefers_what_trusted_documents_hold(spark):
    good = ["clean prose about rivers and hills " + " ".join(f"w{i}{j}" for j in range(60)) for i in range(30)]
    bad = ["buy cheap pills now now " + " ".join(f"z{i}{j}" for j in range(60)) for i in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    scores = {r["doc_id"]: r["llr"] for r in quality.judge(df, labels).collect()}
    assert min(scores[i] for i in range(30)) > max(scores[i] for i in range(30, 60))
    even = quality.judge(df, labels.where("false")).collect()
    assert {r["llr"] for r in even} == {0.0} and quality.judge(df.where("false"), labels).count() == 0
    assert quality.judge(odd_rows(spark), labels).count() == len(ODD)


def test_quality_learns_from_every_trusted_document(spark):
    assert not hasattr(quality, "TRUSTED")
    ids = spark.range(30_000).selectExpr("id AS doc_id", "1 AS quality")
    assert quality.trusted_ids(ids.unionByName(ids)).count() == 30_000


def test_trusted_documents_are_scored_once_with_all_others(spark, monkeypatch):
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(1, 80 + i)) for i in range(40)]
    df = spark.createDataFrame([*enumerate(texts), (3, texts[5])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int")
    scored, all_scores = [], quality._scored
    monkeypatch.setattr(quality, "_scored", lambda docs, weights: scored.append(docs) or all_scores(docs, weights))
    rows = quality.judge(df, labels).collect()
    assert len(scored) == 1 and len(rows) == 41
    own = sorted(r["llr"] for r in rows if r["doc_id"] % 2 == 0 and not r["base_failed"])
    rank = lambda x: own[int(x)] + (x % 1) * (own[min(int(x) + 1, len(own) - 1)] - own[int(x)])
    middle, low = rank(0.5 * (len(own) - 1)), rank(0.05 * (len(own) - 1))
    least = middle - quality.SPREADS * (middle - low)
    assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= least - 1e-9) for r in rows)


def test_values_by_rank(spark):
    numbers = [0.0] * 700 + [float(i * i % 1009) / 7 for i in range(900)] + [1e9, -1e-9]
    df = spark.createDataFrame([(x,) for x in numbers], "x double").repartition(5).cache()
    ordered = sorted(numbers)
    for rank in (0, 1, 300, 701, 850, len(numbers) - 2, len(numbers) - 1):
        assert quality.ranked(df, rank, held=10) == ordered[rank]
    assert abs(quality.quantile(df, len(numbers), 0.9) - df.agg(F.percentile("x", 0.9)).first()[0]) < 1e-9



# benchmark passages


def index_of(texts):
    items = [decontam.Item(i, t) for i, t in enumerate(texts)]
    frequency = Counter(w for item in items for w in set(item.words))
    parts = [s for item in items for s in item.segments()]
    return decontam.Index(items, frequency, len(items), sum(map(len, parts)) / len(parts))


def test_search_finds_what_brute_force_finds():
    rng = random.Random(5)
    words = [f"t{i}".encode() for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [b" ".join(rng.choices(words, weights, k=rng.randint(1, 90))).decode() for _ in range(120)]
    index = index_of(texts)
    for _ in range(150):
        terms = {index.term[w] for w in rng.choices(words, weights, k=rng.randint(1, 100)) if w in index.term}
        if rng.random() < 0.5:
            terms |= set(rng.choice(index.whole))
        want = sorted(d for d, own in enumerate(index.whole) if sum(v for t, v in own.items() if t in terms) >= 0.6 - 1e-9)
        assert sorted(index.search(sorted(terms), 0.6)) == want


ITEM = "What is the tallest of the seven hills near the old town of the north? It is the one that people call the bald head."


def test_question_and_answer_must_both_stand():
    index = index_of([ITEM, "unrelated words of another item that nobody quotes.", "", None, "Two words"])
    filler = " ".join(f"filler{i}" for i in range(300))
    found = lambda text: [n for n, *_ in index.matches(text)]
    assert found(f"{filler} {ITEM} {filler}") == [0] == found(ITEM.upper())
    question, answer = ITEM.split("? ")
    assert found(f"{filler} {question}?") == [] == found(f"{filler} {answer}")
    assert found(f"{filler} two words {filler}") == [4] and found("words two") == []
    assert found(None) == found("") == found(filler) == []


def test_text_glued_to_a_passage_loses_no_item():
    short = ITEM.split("? ")[0] + "? Anhaat."
    four = ITEM.split("? ")[0] + "? Nobody knows about it."
    index = index_of([short, four, "«Où est» la rivière du vieux moulin? Là."])
    found = lambda text: [n for n, *_ in index.matches(text)]
    filler = " ".join(f"filler{i}" for i in range(300))
    for before, after in [("&&&", "&&& inor"), ("end.", "### nd"), ("(", ")"), ("so", "or"), ("\u2014", "\u2026and"), (" ", "_x")]:
        assert 0 in found(f"{filler}{before}{short}{after} {filler}")
        assert 1 in found(f"{filler}{before}{four[:-1]}{after} {filler}")
    assert found(f"{filler} OÙ est la rivière, du vieux moulin \u2013 là") == [2]
    question = short.split("? ")[0]
    assert found(f"{filler} {question}? {filler}") == [] == found(f"{filler} {question}? Nobody cares at all. {filler}")


def test_leaks_over_tables(spark):
    filler = " ".join(f"filler{i}" for i in range(200))
    docs = spark.createDataFrame([(1, f"{filler} {ITEM}"), (1, f"{filler} {ITEM}"), (2, filler), (None, ITEM), (3, None)], "doc_id long, text string")
    docs = docs.withColumn("item_id", F.lit("mine"))
    items = spark.createDataFrame([(7, ITEM), (8, "not there at all, nor anywhere else. Really."), (None, None)], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect())
    assert got == {(1, 7): 2, (None, 7): 1}
    kept = decontam.drop_leaks(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 3}
    for empty in (docs.where("false"), docs):
        assert decontam.leaks(empty, items.where("false")).count() == 0
    assert decontam.drop_leaks(docs, items.where("false")).count() == 5 and decontam.leaks(odd_rows(spark), items).count() == 0


def test_index_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"item number {i} with words a{i} b{i} c{i}. And answer d{i} e{i}.") for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before item number {i} with words a{i} b{i} c{i}. And answer d{i} e{i}. after") for i in range(12)], "doc_id long, text string")
    monkeypatch.setattr(decontam, "INDEX_BYTES", 200)
    assert len(list(decontam.indexes(items))) > 2
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()) == [(i, i) for i in range(12)]


# toxicity


def test_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    for sizes in [(1,), (3, 1, 4), (2, 5), (6,)]:
        moves = rng.normal(size=(2, 2))
        emit = rng.normal(scale=2, size=sum(sizes))
        first = np.zeros(sum(sizes), bool)
        first[np.cumsum((0,) + sizes)[:-1]] = True
        want, steps_want, at = [], [], 0
        for size in sizes:
            total, on = 0.0, np.zeros(size)
            pair = np.zeros((size, 2, 2))
            for path in itertools.product((0, 1), repeat=size):
                weight = sum(emit[at + i] for i in range(size) if path[i]) + sum(moves[a, b] for a, b in zip(path, path[1:]))
                weight = math.exp(weight)
                total += weight
                on += weight * np.array(path)
                for i in range(1, size):
                    pair[i, path[i - 1], path[i]] += weight
            want.append(on / total)
            steps_want.append(pair / total)
            at += size
        chance, steps = toxicity.marginals(emit, first, moves, pairs=True)
        assert np.allclose(chance, np.concatenate(want))
        assert np.allclose(steps[~first], np.concatenate(steps_want)[~first])


def test_spans_and_score():
    text = "you  utter idiot and\nclown go"
    chance = np.array([0.1, 0.9, 0.8, 0.2, 0.7, 0.0])
    assert [text[a:b] for a, b in toxicity.spans_of(text, chance)] == ["utter idiot", "clown"]
    field = toxicity.Field(np.zeros(4), 0.0, np.zeros((2, 2)), 2.0, -1.0)
    odds = 1 / 9 + 9 + 4 + 0.25 + 0.7 / 0.3
    assert math.isclose(toxicity.document_score(field, chance), 1 / (1 + math.exp(1 - 2 * math.log(odds))))
    assert toxicity.document_score(field, np.zeros(0)) == 0.0
    slope, shift = toxicity.logistic_curve(np.array([-3.0, -2.5, -2.0, 2.0, 2.5, 3.0]), np.array([0, 0, 0, 1, 1, 1]), 0.5)
    assert slope > 0.5 and abs(shift) < 1e-6


def test_toxic_words_are_learned(spark):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(400):
        words = [f"word{rng.randint(0, 80)}" for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for w in ("grumble", "vexendo", "vexenda"):
                words.insert(rng.randint(0, 60), w)
        rows.append((i, " ".join(words)))
        marks.append((i, None, int(bad)))
    rows += [(900, None), (901, ""), (None, "grumble word1"), (902, "word1 vexendor word2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("predicted", F.lit("mine"))
    labels = spark.createDataFrame(marks + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.tag(df, labels).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(400))
    assert all(got[i]["held_out"] == (number(i, 5) == 0) for i in range(400))
    assert got[900]["score"] == got[901]["score"] == 0.0 and got[None]["predicted"] == 1
    assert [tuple(s) for s in got[902]["spans"]] == [(6, 14)]  # an unseen form of a known stem
    for none in (labels.where("false"), labels.where("toxic = 0")):
        assert {r["predicted"] for r in toxicity.tag(df, none).collect()} == {0}
    assert toxicity.tag(df.where("false"), labels).count() == 0 and toxicity.tag(odd_rows(spark), labels).count() == len(ODD)


# language model


def test_slopes_against_differences():
    rng = np.random.default_rng(3)
    gru = lm.Gru(5, 3)
    gru.parts = [p.astype(np.float64) for p in gru.parts]
    inputs, targets = rng.integers(0, 6, (4, 3)), rng.integers(0, 5, (4, 3))
    starts, real = np.zeros((4, 3), bool), np.ones((4, 3), bool)
    starts[0] = starts[2, 1] = True
    real[3, 2] = False

    def loss():
        states = []
        state = np.zeros((3, 3))
        for k in range(4):
            state = np.where(starts[k][:, None], 0.0, state)
            into, over = gru.parts[0][inputs[k]], state @ gru.parts[1]
            z, r = (1 / (1 + np.exp(-(into[:, s] + over[:, s]))) for s in (slice(0, 3), slice(3, 6)))
            new = np.tanh(into[:, 6:] + r * over[:, 6:])
            state = (1 - z) * new + z * state
            states.append(state)
        logs = gru.logs(np.stack(states), targets)
        return -logs[real.ravel()].sum() / (lm.WINDOW * lm.TRAIN_LANES)

    states, _, notes = gru.window(inputs, starts, np.zeros((3, 3)), keep=True)
    slopes = gru.slopes(inputs, starts, states, notes, targets, real)
    for part, slope in zip(gru.parts, slopes):
        for at in [tuple(rng.integers(0, n) for n in part.shape) for _ in range(6)]:
            keep = part[at]
            part[at] = keep + 1e-4
            up = loss()
            part[at] = keep - 1e-4
            down = loss()
            part[at] = keep
            assert math.isclose((up - down) / 2e-4, slope[at], rel_tol=1e-2, abs_tol=2e-7)


def test_state_is_carried_over_windows():
    rng = np.random.default_rng(2)
    documents = [rng.integers(0, 6, n) for n in (1, 70, 3, 200, 33, 32)]
    gru = lm.Gru(6, 4)
    got = lm.class_scores(gru, documents)
    for doc, score in zip(documents, got):
        state, total = np.zeros((1, 4), np.float32), 0.0
        for x, y in zip(np.append(6, doc[:-1]), doc):
            states, state, _ = gru.window(np.array([[x]]), np.zeros((1, 1), bool), state)
            total += gru.logs(states, np.array([[y]]))[0]
        assert math.isclose(total / math.log(10), score, rel_tol=1e-4)


def slow_base(rows):
    tokens = {i: [w.encode() for w in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").split(" ") if w] + [b""] for i, t in rows}
    counts = Counter(w for i, own in tokens.items() if number(i, 7) != 2 for w in own)
    n, v = sum(counts.values()), len(counts)
    return {i: (len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)) for i, own in tokens.items()}


@pytest.mark.parametrize("top", [3, 200_000])
def test_base_and_score(spark, monkeypatch, top):
    monkeypatch.setattr(lm, "TOP", top)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["The", "the", "cat", "dog\tran", f"own{i}"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "never seen")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("mine"))
    want = slow_base(rows)
    for r in lm.score(df).collect():
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
        assert r["held_out"] == (number(r["doc_id"], 7) == 2)


def test_language_model_odd_rows(spark):
    assert lm.score(odd_rows(spark)).count() == len(ODD)
    assert lm.score(odd_rows(spark).where("false")).count() == 0


def of_two_kinds(spark, n=120):
    rng = random.Random(4)
    kinds = [[f"{k}{i}" for i in range(30)] for k in "ab"]
    rows = [(i, " ".join([*rng.choices(kinds[i % 2], k=rng.randint(5, 40)), f"own{i}"])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").localCheckpoint()


def test_groups_count_all_training_documents(spark):
    docs = of_two_kinds(spark).selectExpr("doc_id AS row", "doc_id", "doc_id % 7 = 2 AS held_out", "text")
    words = sorted({w for r in docs.where("not held_out").collect() for w in lm.tokens_of(r["text"])})
    training = lm.encoded(docs, words).where("not held_out")
    centres = lm.centres_of(training)
    counts = np.zeros((lm.GROUPS, len(words)))
    for r in training.collect():
        group = lm.nearest(np.frombuffer(r["sketch"], np.float32)[None], centres)[0]
        np.add.at(counts[group], np.frombuffer(r["ids"], "<i4"), 1)
    home = lm.homes(training, words, centres)
    assert home.tolist() == np.argmax(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1), axis=0).tolist()
    # the words of one kind are never at home with those of the other
    of = {k: {g for w, g in zip(words, home) if w[:1] == k and w[1:].isdigit()} for k in (b"a", b"b")}
    assert not of[b"a"] & of[b"b"]


def test_model_knows_no_sample(spark, monkeypatch):
    docs = of_two_kinds(spark)

    def scores():
        return [r["score"] for r in lm.score(docs).orderBy("doc_id").collect()]

    want = scores()
    for name in ("SAMPLE", "EPOCHS"):
        monkeypatch.setattr(lm, name, 2, raising=False)
    assert np.allclose(scores(), want, rtol=1e-4)


def pairs_of_words(n_pairs=60):
    """A vocabulary of words that come in fixed pairs, the model before it learned, and documents of such pairs."""
    rng = np.random.default_rng(6)
    names = [f"{k}{i}".encode() for i in range(n_pairs) for k in "ab"]
    known = lm.Vocabulary(names, [5000 - i for i in range(len(names))], 7, rng.integers(0, 2, len(names)))
    gru = lm.Gru(known.size)
    gru.parts[3][:], gru.parts[2][:] = known.prior, 0
    gru.parts[5][:, :-1], gru.parts[5][:, -1] = 0, known.slice_prior
    documents = [np.repeat(rng.integers(0, n_pairs, 60), 2).astype(np.int32) * 2 for _ in range(1500)]
    for d in documents:
        d[1::2] += 1
    return known, gru, documents


def test_shares_begin_with_counts_and_always_add_up():
    known, gru, _ = pairs_of_words(600)
    assert len(known.odds) and len(known.way)
    words, every = lm.Words(known), np.arange(len(known.classes))
    start = words.logs(gru, every, np.zeros((len(every), lm.HIDDEN), np.float32)) / math.log(10)
    assert np.allclose(start, known.shares, atol=1e-5)
    assert words.logs(gru, np.array([len(every)]), np.ones((1, lm.HIDDEN), np.float32)).tolist() == [0]
    rng = np.random.default_rng(1)
    words.nodes[:] = rng.normal(0, 1, words.nodes.shape)
    gru.parts[5][:, :-1] = rng.normal(0, 1, gru.parts[5][:, :-1].shape)
    for state in rng.uniform(-1, 1, (3, lm.HIDDEN)).astype(np.float32):
        shares = np.exp(words.logs(gru, every, np.tile(state, (len(every), 1))))
        assert np.allclose(np.bincount(known.classes, shares)[np.unique(known.classes)], 1, atol=1e-4)


def test_shares_slopes_against_differences():
    known, gru, _ = pairs_of_words(600)
    rng = np.random.default_rng(2)
    gru.parts[5] = gru.parts[5].astype(np.float64)
    gru.parts[5][:, :-1] = rng.normal(0, 1, gru.parts[5][:, :-1].shape)
    words = lm.Words(known, np.zeros((1, lm.EMBEDDED)), rng.normal(0, 1, (len(known.odds), lm.HIDDEN + 1)))
    places, states = rng.integers(0, len(known.classes) + 1, 50), rng.uniform(-1, 1, (50, lm.HIDDEN))
    down, of_slices, node, of_nodes = words.slopes(gru, places, states)
    sums = np.zeros_like(words.nodes)
    np.add.at(sums, node, np.stack(of_nodes, axis=1))
    met = [(node[0], 3), (node[-1], lm.HIDDEN), (0, 0)]
    c = known.classes[places[places < len(known.classes)][0]]
    for part, slope, ats in ((states, down, [(0, 1), (7, 5), (49, 11)]), (words.nodes, sums, met), (gru.parts[5], of_slices, [(c, 2, 0), (c, lm.HIDDEN, 1)])):
        for at in ats:
            keep, losses = part[at], []
            for move in (1e-3, -1e-3):
                part[at] = keep + move
                losses.append(-words.logs(gru, places, states).sum())
            part[at] = keep
            assert math.isclose((losses[0] - losses[1]) / 2e-3, slope[at], rel_tol=2e-2, abs_tol=2e-3)


def test_words_follow_words():
    known, gru, documents = pairs_of_words()
    read, nodes = lm.Rows(lm.Words(known).read), lm.Rows(lm.Words(known).nodes)
    words = lm.Words(known, read.rows, nodes.rows)
    adam = lm.Adam(gru.parts, lm.RATE)
    for _ in range(12):
        lm.train(gru, documents, adam, words, read, nodes, lm.ROW_RATE)
    assert (read.met[:-2] > 0).all() and (nodes.met > 0).all()
    score = lm.class_scores(gru, documents[:50], words).sum() / sum(map(len, documents[:50]))
    # at best, the first of a pair is one of 60, and the second is known: -0.89. Were a word's share of its class that by count, even a
    # network that knows the next class for sure would lose this much on top:
    lost = -np.mean(known.shares[np.concatenate(documents[:50])])
    assert score > -0.89 - 0.6 * lost


@has_tables
def test_recurrent_beats_single_words(spark):
    held = lm.score(spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


# packing

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_encoder_is_given_up():
    with open(TOKENIZER, encoding="utf-8") as file:
        packing.encoder(file.read())
    assert packing._encoders
    packing.forget_words()
    assert not packing._encoders


def test_workers_give_back_memory():
    top = []

    def work(batches):
        held = []
        for batch in batches:
            held += [b"x" * (2000 + i % 7) for i in range(50_000)]
            top.append(b"y" * 2000)  # lies above the others and stays
            yield batch

    def resident():
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * 4096 / 1e6

    before = resident()
    assert list(lean(work)(iter([1, 2, 3]))) == [1, 2, 3]
    assert resident() - before < 50  # of 300 MB, of which some 100 stay otherwise
    for module in (decontam, langid, lines, lm, packing, simhash):
        with open(module.__file__, encoding="utf-8") as file:
            lines_of = file.read().split("\n")
        assert all("@lean" in before for before, line in zip(lines_of, lines_of[1:]) if re.search(r"def \w+\(batches: Iterator", line))


def test_words_outlast_the_bound(monkeypatch):
    from tokenizers import Tokenizer

    with open(TOKENIZER, encoding="utf-8") as file:
        tokenizer_json = file.read()
    monkeypatch.setattr(packing, "CACHE", 2400)
    encode, whole, merged, odd = packing.WordIds(tokenizer_json), Tokenizer.from_str(tokenizer_json), Counter(), []
    merge, apart = encode.merge, encode._whole
    encode.merge = lambda signs: merged.update([signs]) or merge(signs)
    encode._whole = lambda words: odd.extend(words) or apart(words)
    rng = random.Random(4)
    letters = "abcdefghij\u00e9\u00dfK"
    signs = ["", "", "***", "$$$", ".", "!?", "'", "<|", "%%%,"]
    for n in range(400):
        words = ["Always***", "always"] + ["".join(rng.choices(letters, k=8)) + rng.choice(signs) for _ in range(10)] + ["***", ""]
        assert encode(" ".join(words)) == np.array(whole.encode(" ".join(words), add_special_tokens=False).ids, "<u4").tobytes()
    assert merged["always"] == 1  # met in every text, so it stays when others go
    assert len(merged) > 3000 and set(odd) <= set(signs)  # punctuation goes apart
    assert all(r.held <= r.bound + 200 for r in (encode.words, encode.parts))
    assert sum(len(w) for r in (encode.words, encode.parts) for d in (r.now, r.before) for w in d) <= packing.CACHE + 800


def check_packed(rows, limit):
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    return len(by_seq)


def test_pieces_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(12)
    signs = ["Wörter", "don't", "x́y", " ́z", " ", "\t", "\r\n", "12,5%", "ﬁ", "日本語", "<|endoftext|>", "\x1c", "a" * 90, "İstanbul", "…"]
    texts = [None, "", " "] + ["".join(rng.choice([*signs, " ", " ", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    texts.append("many words of text " * 900)
    rows = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TOKENIZER, 100).collect()
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want = [(k, 100 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k in range(-(-len(ids) // 100)) if (p := ids[100 * k : 100 * k + 100])]
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert got == want


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = rng.integers(1, 100, rng.integers(1, 80))
        one, two = (packing.fresh(lengths, 100, rng, j) for j in (0.0, 0.3))
        child = packing.crossover(lengths, one, two, 100, rng)
        fills = np.bincount(child, lengths)
        assert len(child) == len(lengths) and child.min() == 0 and fills.max() <= 100 and fills.min() > 0
        best = packing.evolve(lengths, [one, two], 100, rng)[0]
        assert packing.fitness(lengths, best, 100) >= max(packing.fitness(lengths, g, 100) for g in (one, two))


@pytest.mark.parametrize("block", [40, 5000])
def test_packing_is_tight(spark, block):
    rng = random.Random(7)
    sizes = [rng.randint(1, 100) for _ in range(500)] + [100] * 20
    df = spark.createDataFrame([(i % 50, n, "keep") for i, n in enumerate(sizes)], "doc_id long, length long, item string")
    rows = packing.pack(df, 100, block).collect()
    assert Counter((r["doc_id"], r["length"], r["item"]) for r in rows) == Counter((i % 50, n, "keep") for i, n in enumerate(sizes))
    loose = 1.04 if block > 1000 else 1.06  # tiny blocks leave more behind
    assert check_packed(rows, 100) <= loose * -(-sum(sizes) // 100) + 1
    assert packing.pack(df.where("false"), 100).count() == 0


def test_packing_odd_rows(spark):
    rows = packing.pack_documents(odd_rows(spark), TOKENIZER).collect()
    check_packed(rows, packing.LIMIT)
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(i for i, _ in ODD)
    assert [(r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 1] == [(1, zlib.crc32(bytes(4)))]


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/{n}">Menu {n}</a></li></ul></nav><div class="box">Same on all pages of the host</div>
<div id="cookie-notice">We use cookies</div><article><h1>Title &amp; {n}</h1><p><b>First   line {n}<br>and more<p>Second &lt;{n}&gt; line
continued</p><table><tr><td>cell {n}</td></tr></table><p>All articles here end so.</p><section class="comments"><p>Nice {n}!</p></section>
</article><aside>See also</aside><form><input name="q"><button>Go</button></form><footer>&copy; host</footer></body></html>"""


def test_article_text():
    want = "Title & 5\nFirst line 5 and more\nSecond <5> line continued\ncell 5\nAll articles here end so."
    assert extraction.main_text(PAGE.format(n=5)) == want
    assert extraction.main_text(None) == extraction.main_text("") == extraction.main_text("<nav>x</nav>") == ""
    assert extraction.main_text("plain <b>text") == "plain text"
    assert extraction.main_text("<p>a<script>never closed") == "a"
    assert extraction.main_text("<div>" * 3000 + "deep") == "deep"
    assert extraction.main_text("<main><p>kept</p></main><p>beside") == "kept"
    assert extraction.main_text("a < b and <!-- gone --> c &eacute;&#233; &nosuch;") == "a < b and c éé &nosuch;"


def test_host():
    urls = ["http://A.example.com/x", "https://u:p@b.example:80?q", "", None, "no address", "http://"]
    assert [extraction.host_of(u) for u in urls] == ["a.example.com", "b.example", "", "", "", ""]


def test_templates_are_deleted_per_host(spark):
    plain = "<html><body><div class='top'>Welcome to the site</div><div><p>Own text {n}</p></div><div>All rights kept</div></body></html>"
    rows = [(i, f"http://one.example/{i}", plain.format(n=i)) for i in range(40)]
    rows += [(100, "http://two.example/", plain.format(n=100)), (101, None, None), (102, "http://one.example/x", ""), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    got = extraction.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    texts = defaultdict(set)
    for r in got:
        texts[r["page_id"]].add(r["text"])
    assert all(texts[i] == {f"Own text {i}"} for i in range(40))
    assert texts[100] == {"Welcome to the site\nOwn text 100\nAll rights kept"} and texts[101] == texts[102] == {""}
    assert extraction.extract(df.where("false")).count() == 0


def test_host_column_is_the_function(spark):
    urls = ["http://A.example.com/x", "https://u:p@b.example:80?q", "", None, "no address", "ftp://ü.example", "http:///p"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(extraction._host_column()).collect()] == [extraction.host_of(u) for u in urls]
