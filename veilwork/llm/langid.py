"""Language of a text, word first with backoff to shorter and shorter character n-grams.

A word that the model knows scores by its log frequency in each language. Any other word is
scored by its n-grams of the greatest length at which one is known, down to single letters.
A text's score in a language is the mean over its words.

The model is fitted on a bounded sample: about ``FIT_ROWS`` documents a language, drawn by a
hash, and of what they hold the ``WORDS`` most frequent words and ``GRAMS`` most frequent
n-grams of each length. So its size has a bound for any corpus, and it is sent to all tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwork.llm.base import lean, query, remainder, table

FIT_ROWS = 2500
WORDS = 20_000
GRAMS = 6_000
LONGEST = 5
UNKNOWN = "und"
CACHE = 100_000  # words whose scores a task keeps
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Model:
    """Log10 frequencies per language: of words, and of n-grams by length. A row of the table per item."""

    def __init__(self, languages: list[str], counts: list[tuple[int, str, str, int]]) -> None:
        """counts: length (0: a word), language, item, count."""
        self.languages = languages
        self.places: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        number = {x: k for k, x in enumerate(languages)}
        rows, size = [], 0
        for n, language, item, count in counts:
            level = self.places[n]
            if item not in level:
                level[item] = size
                size += 1
            rows.append((level[item], number[language], n, count))
        at, of, length, count = np.array(rows, np.int64).reshape(-1, 4).T
        totals = np.zeros((LONGEST + 1, len(languages)))
        np.add.at(totals, (length, of), count)
        # an item that a language lacks counts as half of one that it has once
        absent = np.log10(0.5 / np.maximum(totals, 1.0))
        self.table = np.zeros((size + 1, len(languages)), np.float32)
        self.table[at] = absent[length]
        self.table[at, of] = np.log10(count / totals[length, of])
        self.table[size] = absent[1]  # nothing known, not even a letter

    def word(self, word: str) -> np.ndarray:
        known = self.places[0].get(word)
        if known is not None:
            return self.table[known]
        padded = f" {word} "
        for n in range(min(LONGEST, len(padded)), 0, -1):
            level = self.places[n]
            found = [v for i in range(len(padded) - n + 1) if (v := level.get(padded[i : i + n])) is not None]
            if found:
                return self.table[found[0]] if len(found) == 1 else self.table[found].mean(axis=0)
        return self.table[-1]


class Scorer:
    """Scores texts; remembers a bounded number of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.places: dict[str, int] = {}
        self.table = np.empty((CACHE, max(1, len(model.languages))))

    def _forget(self) -> None:
        self.places.clear()

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not self.model.languages or not (any(map(str.isalpha, words)) or any(map(str.isalpha, chain.from_iterable(words)))):
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.languages))
        for at in range(0, len(words), CACHE // 2):
            part = words[at : at + CACHE // 2]
            new = set(part).difference(self.places)
            if len(self.places) + len(new) > CACHE:
                self._forget()
                new = set(part)
            for w in new:
                self.table[len(self.places)] = self.model.word(w)
                self.places[w] = len(self.places)
            total += self.table[np.fromiter(map(self.places.__getitem__, part), np.int64, len(part))].sum(axis=0)
        mean = total / len(words)
        best = int(np.argmax(mean))
        share = np.power(10.0, mean - mean[best])
        return self.model.languages[best], float(1 / share.sum())


def fit(docs: DataFrame) -> Model:
    """Model of the languages in ``docs`` (``doc_id``, ``text``, ``lang``); rows without text or language say nothing."""
    usable = docs.where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)).alias("draw")
    )
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], [])
    share = F.create_map(*chain.from_iterable((F.lit(x), F.lit(FIT_ROWS / n)) for x, n in sizes.items()))
    sample = usable.where(F.col("draw") < share[F.col("lang")] * 1_000_000).select("lang", "text")

    @lean
    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update(zip([language] * len(words := words_of(text)), words))
            yield pa.RecordBatch.from_pylist(
                [{"lang": x, "item": w, "n": n} for (x, w), n in counts.items()],
                schema=pa.schema([("lang", pa.string()), ("item", pa.string()), ("n", pa.int64())]),
            )

    words = (
        sample.mapInArrow(count_words, "lang string, item string, n bigint")
        .groupBy("lang", "item")
        .agg(F.sum("n").alias("n"))
    )
    padded = F.concat(F.lit(" "), F.col("item"), F.lit(" "))

    def grams_of(size: int) -> Column:
        cut = lambda i: F.struct(F.lit(size).alias("size"), padded.substr(i, F.lit(size)).alias("item"))
        places = F.sequence(F.lit(1), F.length(padded) - size + 1)
        return F.transform(F.when(F.length(padded) >= size, places).otherwise(F.array().cast("array<int>")), cut)

    grams = words.select(
        "lang", "n", F.explode(F.concat(*[grams_of(size) for size in range(1, LONGEST + 1)])).alias("gram")
    ).select("lang", "n", "gram.size", "gram.item")
    items = words.select("lang", F.lit(0).alias("size"), "item", "n").union(
        grams.where("item <> ' '").groupBy("lang", "size", "item").agg(F.sum("n").alias("n")).select("lang", "size", "item", "n")
    )
    rank = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "item"))
    top = items.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("size") == 0, WORDS).otherwise(GRAMS))
    found = top.select("size", "lang", "item", "n").toArrow()  # bounded by the sample, WORDS and GRAMS
    return Model(sorted(sizes), list(zip(*(column.to_pylist() for column in found.columns))))


def predict(docs: DataFrame, model: Model, ids: list[str], text: str = "text") -> DataFrame:
    """The columns ``ids`` with ``lang_pred`` and ``score``; only the text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(sent.value)
        for batch in batches:
            found = [score(t) for t in batch.column(len(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(ids))]
                + [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=[*ids, "lang_pred", "score"],
            )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids)
    return docs.select(*ids, F.col(text).cast("string").alias("the_text")).mapInArrow(
        work, f"{schema}, lang_pred string, score double"
    )


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs`` (``doc_id``, ``text``, ``lang``).

    Learns from rows that aren't held out and have a language. A null text or one without a letter is
    ``und`` with score 0; so is every text if nothing could be learned. Ties go to the language
    that sorts first. A null id counts as not held out; repeated rows come out each.
    """
    model = fit(docs.where(remainder(4) != 2))
    return predict(docs.select("doc_id", "text", (remainder(4) == 2).alias("held_out")), model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text has a language, with all columns as they are."""
    model = fit(docs.where(remainder(4) != 2))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([score(t)[0] != UNKNOWN for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


@query()
def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
