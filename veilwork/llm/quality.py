"""Quality by a likelihood ratio of hashed n-grams, beside counted rules.

Words and pairs of words are hashed into buckets. One multinomial over the buckets is counted
from all documents, another from all trusted ones; a document's score is the mean over its n-grams
of log(trusted / raw). The threshold is one number for the table, read off the scores of the
trusted documents: as far below their median as ``SPREADS`` times their median is above
their 5 % quantile. Documents below it are dropped.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.base import checkpointed, query, table
from veilwork.session import as_long, written

BUCKETS = 1 << 14
HELD = 10_000  # scores the driver sorts at a time
BINS = 256
SPREADS = 5.0
MIN_WORDS = 50
REPEAT_PERCENT = 50
SMOOTH = 1.0
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_BLANKS = b" \t\n\r\x0b\x0c"


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _numbers(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each word as a number below the count of words, and the words they stand for."""
    last = dict(zip(words, range(len(words))))
    own = {w: i for i, w in enumerate(last)}
    return np.fromiter(map(own.__getitem__, words), np.int64, len(words)), list(own)


def repeat_words(numbers: np.ndarray) -> int:
    """Words that stand in a window of three words found twice or more."""
    n = len(numbers)
    if n < 4:
        return 0
    _, pairs = np.unique(numbers[:-1] * n + numbers[1:], return_inverse=True)
    _, which, counts = np.unique(pairs[:-1] * n + numbers[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : shift + len(again)] |= again
    return int(inside.sum())


def buckets(numbers: np.ndarray, vocabulary: list[bytes]) -> np.ndarray:
    """Buckets of a document's words and pairs of neighbouring words."""
    hashes = np.fromiter(map(zlib.crc32, vocabulary), np.uint64, len(vocabulary))[numbers]
    singles = hashes * np.uint64(0x9E3779B97F4A7C15)
    pairs = (singles[:-1] ^ (hashes[1:] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(65 - BUCKETS.bit_length())
    return (np.concatenate([singles, pairs]) >> shift).astype(np.int64)


def rules(text: str | None, numbers: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    blanks = sum(text.count(chr(b)) for b in _BLANKS)
    seen: set[str] = set()
    doubled = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            doubled += line in seen
            seen.add(line)
    symbols = sum(text.count(s) for s in SYMBOLS)
    return len(numbers), len(text) - blanks, symbols, doubled, repeat_words(numbers)


def ngram_counts(docs: DataFrame) -> np.ndarray:
    """Bucket counts of all ``docs``: an array of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = _encoded(text).split()
                if words:
                    own += np.bincount(buckets(*_numbers(words)), minlength=BUCKETS)
        held = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(own[held])], names=["b", "n"])

    sums = docs.select(F.col("text").cast("string")).mapInArrow(count, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS)
    for b, n in sums.collect():  # a row per bucket
        counts[b] = n
    return counts


def ratio_weights(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    p = (target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS)
    q = (raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS)
    return np.log(p / q)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All ids labelled as good."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def _scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Id, counts and score of each row of ``docs``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted, scores = [], []
            for text in batch.column(1).to_pylist():
                numbers, vocabulary = _numbers(_encoded(text).split())
                counted.append(rules(text, numbers))
                scores.append(float(weights[buckets(numbers, vocabulary)].mean()) if len(numbers) else 0.0)
            columns = np.array(counted, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, columns), pa.array(scores, pa.float64())], names=["doc_id", *COUNTS, "llr"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        score, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in COUNTS) + ", llr double"
    )


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def ranked(values: DataFrame, rank: int, held: int = HELD) -> float:
    """The value of that rank, from 0, in the one column ``x``: exact, by counts in ever narrower ranges.

    At most ``held`` values come to the driver. Equal ones need no narrowing, however many.
    """
    least, most, n = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
    while least < most and n > held:
        place = F.floor((F.col("x") - least) / (most - least) * BINS)
        bins = values.groupBy(F.least(place, F.lit(BINS - 1)).alias("bin")).agg(
            F.min("x").alias("least"), F.max("x").alias("most"), F.count("x").alias("n")
        )
        for part in sorted(bins.collect()):
            if rank < part["n"]:
                break
            rank -= part["n"]
        least, most, n = part["least"], part["most"], part["n"]
        values = values.where(F.col("x").between(least, most))
    return least if least == most else sorted(r["x"] for r in values.collect())[rank]


def quantile(values: DataFrame, n: int, share: float) -> float:
    """The quantile of ``n`` values, between two ranks in proportion."""
    below, part = divmod(share * (n - 1), 1)
    low = ranked(values, int(below))
    return low if not part else (1 - part) * low + part * ranked(values, int(below) + 1)


def threshold_of(scores: DataFrame) -> float:
    """The least score that passes, by those of the trusted documents (``x``); without any that passes the base rules, any does."""
    n = scores.count()
    if not n:
        return -math.inf
    middle, low = quantile(scores, n, 0.5), quantile(scores, n, 0.05)
    return middle - SPREADS * (middle - low) - 1e-12


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, score and verdict per row of ``docs`` (``doc_id``, ``text``).

    A null text has no words: its counts are 0, its score is 0 and the base rules fail it. Without
    any trusted label all weights are even and only the base rules decide. Repeated rows are judged
    each; a null id is never trusted; other columns are not read.

    Every document is scored once, and the scores are written. Texts are shuffled once, for the counts of trusted
    ones, always in the same way: a broadcast of few ids would give way to a shuffle at some size.
    """
    ids = as_long(checkpointed(trusted_ids(labels)))
    raw = ngram_counts(docs)
    target = ngram_counts(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"))
    weights = ratio_weights(raw, target) if target.any() else np.zeros(BUCKETS)
    scored = written(_scored(docs, weights))
    passed = scored.where(~_failed()).select("doc_id", F.col("llr").alias("x"))
    least = threshold_of(checkpointed(passed.join(ids, "doc_id", "left_semi").select("x")))
    return scored.select(
        "doc_id", *COUNTS, _failed().alias("base_failed"), (~_failed() & (F.col("llr") >= F.lit(least))).alias("kept"), "llr"
    )


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
