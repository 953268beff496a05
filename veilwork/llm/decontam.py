"""Benchmark passages in training texts: BM25 with block-max WAND, then word overlap.

Test items are cut into segments of at most ``SEGMENT`` words, and an inverted index of the
segments holds each posting's BM25 impact as a share of what the segment scores against
itself. So one threshold serves all. Every training text is cut into windows of two segments'
length, a segment apart, so that any segment lies whole in some window, and every window is a
query: block-max WAND retrieves all segments above the threshold. A window whose terms'
greatest impacts don't add up to the threshold can't have any and ends there.

An item found this way is verified in the whole text, by its runs of five words: those of
the question (all but the last sentence) and those that reach into the answer (the last one).
Words are runs of letters and digits, so punctuation at a passage's edge doesn't matter. Text
around it may be glued to the first and the last word: segments leave these two out, and the runs
that hold them are looked for with an open edge.

The index is built per block of items of at most ``INDEX_BYTES`` of text, whatever the
number of items, and sent to the tasks block by block; term statistics are those of all items.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.base import lean, query, table

SEGMENT = 64
THRESHOLD = 0.6  # of a segment's own score
OVERLAP = 0.8
SHINGLE = 5
COMMON_SHARE = 0.4  # of a segment's own score, left to common terms that aren't searched by
K1, B = 1.2, 0.75
POSTINGS = 16  # of one block of a posting list
INDEX_BYTES = 16 << 20
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"[^\W_]+")
_PLAIN = bytes(ord(c.lower()) if (c := chr(i)).isascii() and c.isalnum() else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, in lower case."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_PLAIN).split()
    return " ".join(_WORD.findall(text.lower())).encode().split()


def shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    """Runs of five words; of fewer words the whole."""
    if not words:
        return []
    size = min(SHINGLE, len(words))
    return list(zip(*[words[i:] for i in range(size)]))


class Item:
    """A test item's words, and its runs of words split into question and answer."""

    def __init__(self, item_id, text: str | None) -> None:
        self.item_id = item_id
        self.words = words_of(text)
        sentences = _SENTENCE.split((text or "").strip())
        answer = len(words_of(sentences[-1])) if len(sentences) > 1 else 0
        runs = shingles(self.words)
        cut = len(runs) - min(answer, len(runs))
        self.question, self.answer = set(runs[:cut]), set(runs[cut:])
        self.size = len(runs[0]) if runs else 0
        # runs at the passage's edges, as they stand when the text around is glued to them
        self.edges = []
        if len(self.words) > SHINGLE:
            self.edges = [(runs[0], b" ".join(runs[0]) + b" "), (runs[-1], b" " + b" ".join(runs[-1]))]

    def segments(self) -> list[list[bytes]]:
        words = self.words[1:-1] if self.edges else self.words
        count = -(-len(words) // SEGMENT)
        bounds = [len(words) * k // count for k in range(count + 1)] if count else []
        return [words[a:b] for a, b in zip(bounds, bounds[1:])]

    def overlaps(self, seen: set, line: bytes) -> tuple[float, float]:
        """Shares of question and answer among the runs ``seen`` and the words in ``line``; a missing part counts as found."""
        glued = {run for run, edge in self.edges if run not in seen and edge in line}
        return tuple(
            (len(part & seen) + len(part & glued)) / len(part) if part else 1.0 for part in (self.question, self.answer)
        )


class Index:
    """Posting lists in blocks, with the greatest impact of each block and list.

    Of a segment, the terms that the most segments have stay out of its postings while they are at
    most ``COMMON_SHARE`` of its own score: whatever reaches the threshold has the rest of it from
    the other terms. Segments so retrieved are scored by all their terms.
    """

    def __init__(self, items: list[Item], frequency: dict[bytes, int], total: int, mean_words: float) -> None:
        self.items = items
        self.owner: list[int] = []
        self.whole: list[dict[int, float]] = []  # by segment: share of its own score by term
        self.term: dict[bytes, int] = {}
        rows: dict[int, list[tuple[int, float]]] = {}
        for number, item in enumerate(items):
            for segment in item.segments():
                norm = K1 * (1 - B + B * len(segment) / max(mean_words, 1e-9))
                impact = {
                    t: math.log(1 + (total - frequency[t] + 0.5) / (frequency[t] + 0.5)) * n * (K1 + 1) / (n + norm)
                    for t, n in Counter(segment).items()
                }
                own, common = sum(impact.values()), 0.0
                place = len(self.owner)
                self.owner.append(number)
                self.whole.append({})
                for t in sorted(impact, key=lambda t: (-frequency[t], t)):
                    share = impact[t] / own
                    common += share
                    term = self.term.setdefault(t, len(self.term))
                    self.whole[place][term] = share
                    if common > COMMON_SHARE:
                        rows.setdefault(term, []).append((place, share))
        self.docs = {t: [d for d, _ in r] for t, r in rows.items()}
        self.impacts = {t: [v for _, v in r] for t, r in rows.items()}
        self.most = np.zeros(len(self.term) + 1)
        for t, v in self.impacts.items():
            self.most[t] = max(v)
        self.block_most = {t: [max(v[i : i + POSTINGS]) for i in range(0, len(v), POSTINGS)] for t, v in self.impacts.items()}
        self.block_last = {t: [d[min(i + POSTINGS, len(d)) - 1] for i in range(0, len(d), POSTINGS)] for t, d in self.docs.items()}

    def search(self, terms: list[int], threshold: float) -> list[int]:
        """All segments that score at least ``threshold`` for the terms, by block-max WAND."""
        found = []
        held, most = set(terms), self.most
        listed = [t for t in terms if t in self.docs]
        at = dict.fromkeys(listed, 0)
        live = sorted(listed, key=lambda t: self.docs[t][0])
        slack = threshold - COMMON_SHARE - 1e-9
        while live:
            # pivot: the first segment that the lists up to it could lift above the threshold
            bound, pivot = 0.0, -1
            for k, t in enumerate(live):
                bound += most[t]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            target = self.docs[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and self.docs[live[pivot + 1]][at[live[pivot + 1]]] == target:
                pivot += 1
            # blocks that could hold the target, and where the first of them ends
            ceiling, ends = 0.0, None
            for t in live[: pivot + 1]:
                block = at[t] // POSTINGS
                lasts = self.block_last[t]
                while block < len(lasts) and lasts[block] < target:
                    block += 1
                if block < len(lasts):
                    ceiling += self.block_most[t][block]
                    ends = lasts[block] if ends is None else min(ends, lasts[block])
            if ceiling >= slack:
                goal = target
                if self.docs[live[0]][at[live[0]]] == target:
                    score = sum(self.impacts[t][at[t]] for t in live[: pivot + 1])
                    if score >= slack and sum(v for t, v in self.whole[target].items() if t in held) >= threshold - 1e-9:
                        found.append(target)
                    goal = target + 1
            else:
                goal = (ends if ends is not None else target) + 1
                if pivot + 1 < len(live):
                    goal = min(goal, self.docs[live[pivot + 1]][at[live[pivot + 1]]])
                goal = max(goal, target + 1) if self.docs[live[0]][at[live[0]]] == target else max(goal, target)
            moved = []
            for t in live[: pivot + 1]:
                docs, i = self.docs[t], at[t]
                while i < len(docs) and docs[i] < goal:
                    block = i // POSTINGS
                    i = (block + 1) * POSTINGS if self.block_last[t][block] < goal else i + 1
                at[t] = i
                if i < len(docs):
                    moved.append(t)
            live = sorted(moved + live[pivot + 1 :], key=lambda t: self.docs[t][at[t]])
        return found

    def candidates(self, words: list[bytes], threshold: float = THRESHOLD) -> set[int]:
        """Items of which a segment is retrieved by some window of the text."""
        none = len(self.term)
        ids = np.fromiter((self.term.get(w, none) for w in words), np.int64, len(words))
        gains = np.concatenate([[0.0], np.cumsum(self.most[ids])])
        least = threshold - COMMON_SHARE - 1e-6
        starts = np.arange(0, max(1, len(words) - SEGMENT), SEGMENT)
        ends = np.minimum(starts + 2 * SEGMENT, len(words))
        out: set[int] = set()
        likely = gains[ends] - gains[starts] >= least
        for s, e in zip(starts[likely].tolist(), ends[likely].tolist()):
            terms = np.unique(ids[s:e])
            terms = terms[terms < none]
            if self.most[terms].sum() >= least:
                out.update(self.owner[d] for d in self.search(terms.tolist(), threshold))
        return out

    def matches(self, text: str | None) -> list[tuple[int, float, float]]:
        """Verified items: number, share of the question and of the answer."""
        words = words_of(text)
        out = []
        seen: dict[int, set] = {}
        found = sorted(self.candidates(words)) if words else []
        line = b" %b " % b" ".join(words) if found else b""
        for number in found:
            item = self.items[number]
            if item.size not in seen:
                seen[item.size] = set(zip(*[words[i:] for i in range(item.size)]))
            shares = item.overlaps(seen[item.size], line)
            if min(shares) >= OVERLAP:
                out.append((number, *shares))
        return out


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes that together hold all of ``items`` (``item_id``, ``text``), each of bounded size."""
    texts = items.where("text is not null").select("item_id", F.col("text").cast("string").alias("text"))
    stats = (
        texts.select("text")
        .mapInArrow(_counts, "bytes bigint, words bigint, segments bigint")
        .agg(*[F.sum(c).alias(c) for c in ("bytes", "words", "segments")], F.count(F.lit(1)).alias("n"))
        .first()
    )
    if not stats["words"]:
        return
    blocks = -(-stats["bytes"] // INDEX_BYTES)
    spread = texts.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    # in how many items a term stands, of all items
    terms = spread.select("block", "text").mapInArrow(_terms, "block bigint, term binary")
    frequency = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for block in range(blocks):
        held = [Item(r["item_id"], r["text"]) for r in spread.where(F.col("block") == block).collect()]
        own = terms.where(F.col("block") == block).select("term").distinct()
        df = {bytes(r["term"]): r["df"] for r in frequency.join(own, "term").collect()}
        held.sort(key=lambda x: (str(x.item_id), x.words))
        yield Index(held, df, max(stats["n"], 1), stats["words"] / max(stats["segments"], 1))


@lean
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = [(len(t.encode("utf-8", "surrogatepass")), Item(None, t)) for t in batch.column(0).to_pylist()]
        counts = [(size, len(x.words), len(x.segments())) for size, x in items]
        columns = np.array(counts, np.int64).reshape(-1, 3).T
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bytes", "words", "segments"])


@lean
def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [sorted(set(words_of(t))) for t in batch.column(1).to_pylist()]
        block = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(h) for h in held])
        terms = pa.array([t for h in held for t in h], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), terms], names=["block", "term"])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, question_overlap, answer_overlap`` for each row of ``docs`` and item it holds.

    Null and empty texts on either side match nothing; items shorter than five words must
    stand in the text as they are. Repeated rows of either table are reported each. Other
    columns are not read. Without items, or documents, the result is empty.
    """
    doc_kind, item_kind = (t.schema[c].dataType for t, c in ((docs, "doc_id"), (items, "item_id")))
    schema = f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, question_overlap double, answer_overlap double"
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    for index in indexes(items):
        sent = spark.sparkContext.broadcast(index)

        @lean
        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                rows, found = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for match in index.matches(text):
                        rows.append(i)
                        found.append(match)
                ids = pa.array([index.items[n].item_id for n, _, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int32())),
                        ids.cast(_arrow(item_kind)),
                        pa.array([q for _, q, _ in found], pa.float64()),
                        pa.array([a for _, _, a in found], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "question_overlap", "answer_overlap"],
                )

        out = out.union(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(work, schema))
    return out


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no item, with all columns; rows without text stay."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    for index in indexes(items):
        sent = spark.sparkContext.broadcast(index)

        @lean
        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not sent.value.matches(t) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
    return docs


@query()
def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
