"""Toxic spans by a linear-chain conditional random field, and what they say of a document.

Labels are given for documents, so the tokens to learn from are labelled first: in a toxic
document, those words and stems that stand in toxic documents far more often than chance allows.
The field has two states and features of the word, its stems and its neighbours. It is fitted
by gradient ascent on a bounded sample of labelled documents; forward and backward passes give
each token's marginal. A document's evidence is the log of the sum of its tokens' odds; a logistic
curve through the sample's evidence, set to the labels' base rate, turns it into a score. The
offending offsets are those of tokens more likely toxic than not.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.base import query, remainder, table

FIT_TOXIC, FIT_CLEAN = 3000, 6000  # labelled documents, at most, that words are counted in
TRAIN_EACH = 700  # of those, documents of either label that the field is fitted on
EVIDENCE = 12.0  # nats by which a word must prefer toxic documents
WEIGHTS = 1 << 18
STEMS = (4, 5, 6)
ROUNDS = 90
RATE = 0.5
SHRINK = 3e-4
CACHE = 150_000
TOKENS = 400_000  # scored at a time
_EDGE = re.compile(r"^\W+|\W+$")


def plain(word: str) -> str:
    return _EDGE.sub("", word.lower())


def own_features(word: str) -> list[str]:
    """Of a plain word: itself and its stems."""
    return [f"w={word}"] + [f"s={word[:n]}" for n in STEMS if len(word) > n]


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (WEIGHTS - 1)


def slots_of(raw: str) -> tuple[list[int], int, int]:
    """Weights of a token's own features, of its being the word before, and the word after."""
    word = plain(raw)
    return [_slot(f) for f in own_features(word)], _slot(f"before={word}"), _slot(f"after={word}")


def marginals(emit: np.ndarray, first: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Chance of the toxic state per token; with ``pairs``, also that of each step between states.

    emit: log weight of the toxic state. first: which tokens begin a document. moves: log weights
    [[clean to clean, to toxic], [toxic to clean, to toxic]]. Tokens lie in lanes that are
    passed side by side; a first pass finds what each lane does to any state on entry.
    """
    n = len(emit)
    if not n:
        return (np.zeros(0), np.zeros((0, 2, 2))) if pairs else np.zeros(0)
    lanes = max(1, int(math.sqrt(n)))
    steps = -(-n // lanes)
    size = lanes * steps
    up = np.exp(np.clip(np.pad(emit, (0, size - n)), -40, 40)).reshape(lanes, steps).T.copy()
    new = np.pad(first, (0, size - n), constant_values=True).reshape(lanes, steps).T.copy()
    t = np.exp(moves)
    # a document's first token forgets the state before it
    m00, m01 = np.where(new, 1.0, t[0, 0]), np.where(new, 1.0, t[0, 1]) * up
    m10, m11 = np.where(new, 1.0, t[1, 0]), np.where(new, 1.0, t[1, 1]) * up
    p = [np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)]
    for k in range(steps):
        a, b, c, d = p
        p = [a * m00[k] + b * m10[k], a * m01[k] + b * m11[k], c * m00[k] + d * m10[k], c * m01[k] + d * m11[k]]
        total = p[0] + p[1] + p[2] + p[3]
        p = [x / total for x in p]
    whole = np.stack(p, axis=1).tolist()
    entry, state = [], (0.5, 0.5)
    for a, b, c, d in whole:
        entry.append(state)
        x, y = state[0] * a + state[1] * c, state[0] * b + state[1] * d
        state = (x / (x + y), y / (x + y))
    leave, state = [], (0.5, 0.5)
    for a, b, c, d in reversed(whole):
        leave.append(state)
        x, y = a * state[0] + b * state[1], c * state[0] + d * state[1]
        state = (x / (x + y), y / (x + y))
    x, y = (np.array(v) for v in zip(*entry))
    before = np.empty((2, steps, lanes))
    ahead = np.empty((2, steps, lanes))
    for k in range(steps):
        before[0, k], before[1, k] = x, y
        x, y = x * m00[k] + y * m10[k], x * m01[k] + y * m11[k]
        total = x + y
        x, y = x / total, y / total
        ahead[0, k], ahead[1, k] = x, y
    x, y = (np.array(v) for v in zip(*reversed(leave)))
    behind = np.empty((2, steps, lanes))
    for k in range(steps - 1, -1, -1):
        behind[0, k], behind[1, k] = x, y
        x, y = m00[k] * x + m01[k] * y, m10[k] * x + m11[k] * y
        total = x + y
        x, y = x / total, y / total
    joint = ahead * behind
    chance = (joint[1] / joint.sum(axis=0)).T.reshape(-1)[:n]
    if not pairs:
        return chance
    step = np.empty((size, 2, 2))
    for i, row in enumerate(((m00, m01), (m10, m11))):
        for j, m in enumerate(row):
            step[:, i, j] = (before[i] * m * behind[j]).T.reshape(-1)
    step /= step.sum(axis=(1, 2), keepdims=True)
    return chance, step[:n]


class Field:
    """Weights of the fitted field, and of the curve from a document's evidence to its score."""

    def __init__(self, weights: np.ndarray, bias: float, moves: np.ndarray, slope: float = 1.0, shift: float = 0.0) -> None:
        self.weights, self.bias, self.moves = weights.astype(np.float32), bias, moves
        self.slope, self.shift = slope, shift


def evidence_of(chance: np.ndarray) -> float:
    """Log of the sum of the tokens' odds."""
    return float(np.log((chance / np.maximum(1 - chance, 1e-12)).sum() + 1e-12))


def logistic_curve(evidence: np.ndarray, toxic: np.ndarray, base: float) -> tuple[float, float]:
    """Slope and shift by Newton's steps; targets keep off 0 and 1, and ``base`` replaces the sample's share."""
    bad, good = toxic.sum(), (1 - toxic).sum()
    target = np.where(toxic == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    x = np.stack([evidence, np.ones(len(evidence))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (target - p) - 1e-3 * w)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return float(max(w[0], 0.0)), float(w[1] + math.log(base / (1 - base)) - math.log(bad / good))


def train(texts: list[str], toxic: list[int], lexicon: set[str], base: float) -> Field:
    """Fits the field to texts whose tokens are labelled by the lexicon; ``base``: share of toxic documents at large."""
    raw = [t.split() for t in texts]
    labels, first, own, owner, before, after = [], [], [], [], [], []
    known: dict[str, tuple] = {}
    count = 0
    for words, bad in zip(raw, toxic):
        for i, word in enumerate(words):
            if word not in known:
                known[word] = (*slots_of(word), any(f in lexicon for f in own_features(plain(word))))
            slots, _, _, hit = known[word]
            own += slots
            owner += [count] * len(slots)
            before.append(known[words[i - 1]][1] if i else -1)
            if i:
                after.append(known[word][2])
            labels.append(bool(bad) and hit)
            first.append(i == 0)
            count += 1
        if words:
            after.append(-1)
    if not any(labels):
        return Field(np.zeros(WEIGHTS), -20.0, np.zeros((2, 2)))
    y, starts = np.array(labels, float), np.array(first)
    own, owner = np.array(own), np.array(owner)
    before, after = np.array(before), np.array(after)
    sides = [(v[v >= 0], np.flatnonzero(v >= 0)) for v in (before, after)]
    weights, bias, moves = np.zeros(WEIGHTS), math.log(y.mean() / (1 - y.mean())), np.zeros((2, 2))
    pairs_true = np.zeros((2, 2))
    inner = ~starts
    np.add.at(pairs_true, (y[:-1][inner[1:]].astype(int), y[1:][inner[1:]].astype(int)), 1)
    speed_w, speed_b, speed_m = np.full(WEIGHTS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(ROUNDS):
        emit = np.bincount(owner, weights[own], count) + bias
        for slots, at in sides:
            emit[at] += weights[slots]
        chance, steps = marginals(emit, starts, moves, pairs=True)
        off = y - chance
        slope = np.bincount(own, off[owner], WEIGHTS)
        for slots, at in sides:
            slope += np.bincount(slots, off[at], WEIGHTS)
        slope -= SHRINK * count * 1e-3 * weights
        slope_b, slope_m = off.sum(), pairs_true - steps[inner].sum(axis=0)
        slope_m[0, 0] = 0.0  # the others are relative to staying clean
        speed_w += slope**2
        speed_b += slope_b**2
        speed_m += slope_m**2
        weights += RATE * slope / np.sqrt(speed_w)
        bias += RATE * slope_b / math.sqrt(speed_b)
        moves += RATE * slope_m / np.sqrt(speed_m)
    ends = np.cumsum([len(words) for words in raw])
    evidence = np.array([evidence_of(c) for c in np.split(chance, ends[:-1])])
    return Field(weights, bias, moves, *logistic_curve(evidence, np.array(toxic), base))


class Tagger:
    """Applies a field; remembers the weights of a bounded number of words."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.places: dict[str, int] = {}
        self.table = np.zeros((3, CACHE), np.float32)

    def _look(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.places)
        if len(self.places) + len(new) > CACHE:
            self.places.clear()
            new = set(words)
        weights = self.field.weights
        for word in new:
            own, before, after = slots_of(word)
            at = len(self.places)
            self.table[:, at] = weights[own].sum(), weights[before], weights[after]
            self.places[word] = at
        return self.table[:, np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))]

    def chances(self, documents: list[list[str]]) -> list[np.ndarray]:
        """Marginals of each document's tokens."""
        parts = []
        for words in documents:
            for at in range(0, len(words), CACHE // 2):
                parts.append(self._look(words[at : at + CACHE // 2]))
        sizes = np.array([len(d) for d in documents])
        if not sizes.sum():
            return [np.zeros(0)] * len(documents)
        own, before, after = np.concatenate(parts, axis=1).astype(float)
        first = np.zeros(len(own), bool)
        ends = np.cumsum(sizes)
        first[(ends - sizes)[sizes > 0]] = True
        emit = own + self.field.bias
        emit[1:] += np.where(first[1:], 0.0, before[:-1])
        emit[:-1] += np.where(first[1:], 0.0, after[1:])
        return np.split(marginals(emit, first, self.field.moves), ends[:-1])


def document_score(field: Field, chance: np.ndarray) -> float:
    """Chance that a document with these marginals is toxic; 0 without tokens."""
    if not len(chance):
        return 0.0
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, field.slope * evidence_of(chance) + field.shift))))


def spans_of(text: str, chance: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets of runs of tokens more likely toxic than not."""
    hit = (chance >= 0.5).tolist()
    if not any(hit):
        return []
    out: list[tuple[int, int]] = []
    at, joined = 0, False
    for word, bad in zip(text.split(), hit):
        at = text.index(word, at)
        if bad:
            if joined:
                out[-1] = (out[-1][0], at + len(word))
            else:
                out.append((at, at + len(word)))
        joined = bad
        at += len(word)
    return out


def lexicon_of(sample: DataFrame, toxic: int, clean: int) -> set[str]:
    """Features that prefer toxic documents of ``sample`` (``text``, ``toxic``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad, good = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {plain(w) for w in text.split()}
                (bad if label else good).update({f for w in words if w for f in own_features(w)})
            features = list(bad.keys() | good.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(features, pa.string()), pa.array([bad[f] for f in features], pa.int64()), pa.array([good[f] for f in features], pa.int64())],
                names=["feature", "bad", "good"],
            )

    base = toxic / (toxic + clean)
    share = F.col("bad") / (F.col("bad") + F.col("good"))
    gain = F.col("bad") * F.log(share / base) + F.when(
        F.col("good") > 0, F.col("good") * F.log((1 - share) / (1 - base))
    ).otherwise(0.0)
    counted = sample.mapInArrow(count, "feature string, bad bigint, good bigint").groupBy("feature").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    strong = counted.where((F.col("bad") > 0) & (gain >= EVIDENCE) & (share > F.lit(max(0.8, base))))
    return {r["feature"] for r in strong.select("feature").collect()}  # bounded by the sample


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """A field from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``toxic``).

    An id labelled twice counts as toxic if any label says so.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(remainder(5) != 0)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_TOXIC).union(
        known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_CLEAN)
    )
    chosen = [(r["doc_id"], int(r["toxic"])) for r in drawn.collect()]
    kind = labels.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    ids = spark.createDataFrame(chosen, f"doc_id {kind}, toxic int")
    sample = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    toxic = sum(t for _, t in chosen)
    if not toxic or toxic == len(chosen):
        return Field(np.zeros(WEIGHTS), -20.0, np.zeros((2, 2)))
    lexicon = lexicon_of(sample.select("text", "toxic"), toxic, len(chosen) - toxic)
    few = [d for d, t in chosen if t][:TRAIN_EACH] + [d for d, t in chosen if not t][:TRAIN_EACH]
    rows = sample.where(F.col("doc_id").isin(few)).select("text", "toxic").orderBy("toxic", "text").collect()
    labels_of = [r["toxic"] for r in rows]
    if len(set(labels_of)) < 2:
        return Field(np.zeros(WEIGHTS), -20.0, np.zeros((2, 2)))
    return train([r["text"] for r in rows], labels_of, lexicon, counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, field: Field, ids: list[str]) -> DataFrame:
    """The columns ``ids`` with ``score``, ``predicted`` and ``spans`` (start and end offsets in the text)."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(sent.value)
        for batch in batches:
            scores, spans = [], []
            texts, words, held = [], [], 0
            column = batch.column(len(ids)).to_pylist()
            for i, text in enumerate(column):
                texts.append(text or "")
                words.append(texts[-1].split())
                held += len(words[-1])
                if held >= TOKENS or i + 1 == len(column):
                    for t, chance in zip(texts, tagger.chances(words)):
                        scores.append(document_score(tagger.field, chance))
                        spans.append([{"start": a, "end": b} for a, b in spans_of(t, chance)])
                    texts, words, held = [], [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(ids))]
                + [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, span_type)],
                names=[*ids, "score", "predicted", "spans"],
            )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids)
    return docs.select(*ids, F.col("text").cast("string").alias("the_text")).mapInArrow(
        work, f"{schema}, score double, predicted int, spans array<struct<start:int,end:int>>"
    )


def tag(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` per row of ``docs``.

    Learns from labelled rows that aren't held out. A null or blank text scores 0; without labels of both
    kinds nothing is toxic. A null id isn't held out and has no label. Repeated rows come out each.
    """
    field = fit(docs, labels)
    held = docs.select("doc_id", "text", (remainder(5) == 0).alias("held_out"))
    return score(held, field, ["doc_id", "held_out"])


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
