"""Ranked lexical search with norm buckets: the best documents for each query, exactly.

A document is a vector of term impacts, a query one of term weights times repeats, and a score their product in whole
numbers. The documents a task reads are ordered by the length of their vectors and cut into buckets. A query goes
through the buckets from long vectors to short ones and keeps its best scores so far, the least of which is its bar.

* No document of a bucket scores more than the query's length times that of the bucket's longest vector
  (Cauchy-Schwarz). Once that is below the bar, this bucket and all later ones are done with.
* Inside a bucket the query's heaviest coordinates, its focus, are taken exactly from the bucket's lists. What the other coordinates
  can add is at most the length of the query's rest times that of the document's rest, and at most the sum of the
  rest's weights times the bucket's greatest impacts. Only documents whose bound reaches the bar are left.
* Those are scored anew in whole numbers over all terms.

Bounds are in doubles and are raised by more than their rounding. Each task hands on its best documents per query, and
these meet in two steps, so no task gets more than the best of some tasks. Queries are taken in blocks of at most ``BLOCK_BYTES`` of text
whatever their number; a block's terms are what tasks get, and its term statistics, over all documents, what the driver holds.

Defined results: a null text and one without terms match nothing, on either side, and count as no document. Equal scores go
by the least ``doc_id``, then null ids; equal rows both take a rank. A query that occurs twice is answered twice. Fewer matches than
``top`` give fewer rows, and an empty table on either side none. Texts are read whole, whatever their length. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwork.llm.base import checkpointed, query, table

TOP = 20
BUCKET = 512  # documents
FOCUS = 0.6  # share of a query's squared length that its focus holds at least
BLOCK_BYTES = 8 << 20
SLACK = 1e-9
SALTS = 64
_SMALL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and all that isn't ASCII; only A to Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SMALL).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def length_factor(n: int, documents: int, total: int) -> int:
    """m of a document of ``n`` terms, when ``documents`` have ``total``."""
    return 75 + (25 * n * documents) // total


class Queries:
    """A block of queries over their terms that some document has; the vocabulary is sent with it."""

    def __init__(self, texts: list[list[bytes]], documents: int, total: int, df: dict[bytes, int]) -> None:
        self.documents, self.total = documents, total
        self.number = {t: i for i, t in enumerate(sorted({t for q in texts for t in q} & df.keys()))}
        weights = {t: weight(documents, df[t]) for t in self.number}
        self.terms, self.values, self.focus, self.rest, self.length = [], [], [], [], []
        for q in texts:
            held = sorted(((weights[t] * n, self.number[t]) for t, n in Counter(q).items() if t in df), reverse=True)
            values = np.array([v for v, _ in held], np.int64)
            squares = np.cumsum(values.astype(float) ** 2)
            size = int(np.searchsorted(squares, FOCUS * squares[-1])) + 1 if len(held) else 0
            self.terms.append(np.array([t for _, t in held], np.int64))
            self.values.append(values)
            self.focus.append(size)
            self.length.append(math.sqrt(squares[-1]) * (1 + SLACK) if len(held) else 0.0)
            self.rest.append(math.sqrt(float((values[size:].astype(float) ** 2).sum())) * (1 + SLACK))


class Documents:
    """Impact vectors of some documents over a block's terms, in the order of their lengths."""

    def __init__(self, texts: list[str | None], queries: Queries) -> None:
        known, none = queries.number, len(queries.number)
        rows, terms, factors = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = terms_of(text)
            if words:
                factors[i] = length_factor(len(words), queries.documents, queries.total)
                ids = [known[w] for w in words if w in known]
                rows.append(np.full(len(ids), i, np.int64))
                terms.append(np.array(ids, np.int64))
        keys = np.concatenate([np.zeros(0, np.int64), *rows]) * (none + 1) + np.concatenate([np.zeros(0, np.int64), *terms])
        found, tf = np.unique(keys, return_counts=True)
        doc, term = found // (none + 1), found % (none + 1)
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * factors[doc])
        squares = np.bincount(doc, impact.astype(float) ** 2, len(texts))
        self.order = np.argsort(-squares, kind="stable")  # of a place, the document
        self.order = self.order[squares[self.order] > 0]
        self.length = np.sqrt(squares[self.order]) * (1 + SLACK)
        place = np.full(len(texts), -1, np.int64)
        place[self.order] = np.arange(len(self.order))
        kept = place[doc] >= 0
        self.buckets = [
            Bucket(begin, self.length[begin : begin + BUCKET]) for begin in range(0, len(self.order), BUCKET)
        ]
        place, term, impact = place[doc][kept], term[kept], impact[kept]
        by_bucket = np.lexsort((place, term, place // BUCKET))
        place, term, impact = place[by_bucket], term[by_bucket], impact[by_bucket]
        cuts = np.searchsorted(place // BUCKET, np.arange(len(self.buckets) + 1))
        for b, (a, e) in zip(self.buckets, zip(cuts, cuts[1:])):
            b.fill(place[a:e] - b.begin, term[a:e], impact[a:e])


class Bucket:
    """Lists per term: ``starts[i]`` to ``starts[i + 1]`` of ``docs`` and ``impacts`` are those of ``terms[i]``."""

    def __init__(self, begin: int, lengths: np.ndarray) -> None:
        self.begin, self.lengths, self.longest = begin, lengths, float(lengths[0])

    def fill(self, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> None:
        self.docs, self.impacts = docs, impacts
        self.terms, starts = np.unique(terms, return_index=True)
        self.starts = np.append(starts, len(terms))
        self.most = np.maximum.reduceat(impacts, starts) if len(starts) else impacts

    def lists(self, terms: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the lists of ``terms``, and of each the position of its term; whether a term has a list."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        known = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        return at[known], values[known], known

    def gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of the lists ``at``, and to which of them each belongs."""
        sizes = self.starts[at + 1] - self.starts[at]
        owner = np.repeat(np.arange(len(at)), sizes)
        first = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        return first + np.arange(len(owner)), owner


def best_of(batch: Documents, queries: Queries, number: int, ids: np.ndarray, top: int = TOP) -> list[tuple[int, int]]:
    """Score and document of the best for one query, the highest first; equal scores by ``ids``."""
    terms, values, focus = queries.terms[number], queries.values[number], queries.focus[number]
    length, rest = queries.length[number], queries.rest[number]
    found: list[tuple[int, int, int]] = []  # -score, id's rank, document
    bar = 0
    for b in batch.buckets:
        if length * b.longest < bar:
            break
        at, heavy, known = b.lists(terms, values)
        if not len(at):
            continue
        split = int(known[:focus].sum())
        entries, owner = b.gathered(at[:split])
        part = b.impacts[entries].astype(float)
        size = len(b.lengths)
        sums = np.bincount(b.docs[entries], part * heavy[:split][owner], size)
        left = np.sqrt(np.maximum(b.lengths**2 - np.bincount(b.docs[entries], part**2, size), 0)) + SLACK * b.lengths
        others = float((heavy[split:].astype(float) * b.most[at[split:]]).sum())
        bound = (sums + np.minimum(rest * left, others)) * (1 + SLACK) + 1
        survivors = bound >= max(bar, 2)
        if not survivors.any():
            continue
        # the same lists once more, all terms, in whole numbers
        entries, owner = b.gathered(at)
        entries_doc = b.docs[entries]
        wanted = survivors[entries_doc]
        scores = np.zeros(size, np.int64)
        np.add.at(scores, entries_doc[wanted], b.impacts[entries[wanted]] * heavy[owner[wanted]])
        good = np.flatnonzero(survivors & (scores >= max(bar, 1)))
        docs = batch.order[b.begin + good]
        found += zip((-scores[good]).tolist(), ids[docs].tolist(), docs.tolist())
        if len(found) > top:
            found = sorted(found)[:top]
        if len(found) == top:
            bar = -max(found)[0]
    return [(-s, d) for s, _, d in sorted(found)[:top]]


def _frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all their terms, and in how many documents each term of ``vocabulary`` is."""
    listed = sorted(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(listed)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        df: Counter = Counter()
        n = total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = terms_of(text)
                if words:
                    n, total = n + 1, total + len(words)
                    df.update({known[w] for w in words if w in known})
        # -1: documents, -2: terms
        terms, counts = [-1, -2, *df], [n, total, *df.values()]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(counts, pa.int64())], names=["term", "n"])

    found = docs.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by_term = {r["term"]: r["n"] for r in found}  # one row per term of the block
    return by_term.pop(-1, 0), by_term.pop(-2, 0), {listed[t]: n for t, n in by_term.items()}


def _blocks(items: DataFrame) -> Iterator[list]:
    """Rows of ``items`` in blocks of bounded size."""
    size = items.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    spread = items.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    if blocks > 1:
        spread = checkpointed(spread)
    for block in range(blocks):
        yield [(r["item_id"], terms_of(r["text"])) for r in spread.where(F.col("block") == block).collect()]


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents with a score above 0 for each row of ``items`` (``item_id``, ``text``).

    ``docs`` has ``doc_id`` (a long) and ``text``. See the module for ties and edge cases.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    asked = items.select("item_id", F.col("text").cast("string")).where("text is not null")
    kind = items.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    for block in _blocks(asked):
        block = [(i, terms) for i, terms in block if terms]
        if not block:
            continue
        documents, total, df = _frequencies(texts.select("text"), {t for _, q in block for t in q})
        if not documents:
            continue
        sent = spark.sparkContext.broadcast(Queries([q for _, q in block], documents, total, df))
        found = texts.mapInArrow(_search(sent, top), "query int, doc_id bigint, score bigint")
        ranks = found
        for by in (["query", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))], ["query"]):
            order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            ranks = ranks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"query int, item_id {kind.simpleString()}")
        out = out.union(ranks.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    return out


def _search(sent, top: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        for batch in batches:
            ids = batch.column(0)
            held = Documents(batch.column(1).to_pylist(), queries)
            by_id = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
            rows = [
                (number, document, score)
                for number in range(len(queries.terms))
                for score, document in best_of(held, queries, number, by_id, top)
            ]
            columns = np.array(rows, np.int64).reshape(-1, 3).T
            arrays = [pa.array(columns[0].astype(np.int32)), ids.take(pa.array(columns[1])), pa.array(columns[2])]
            yield pa.RecordBatch.from_arrays(arrays, names=["query", "doc_id", "score"])

    return work


_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS_SQL = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SEARCH_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS_SQL.format(_LOWER_SQL.format("text"))} AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
q AS (SELECT item_id, unnest({_TERMS_SQL.format(_LOWER_SQL.format("text"))}) AS term FROM benchmark WHERE text IS NOT NULL),
tf AS MATERIALIZED (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term),
p AS (SELECT doc_id, term, w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * tf.n * s.n) // s.l))) AS gain FROM tf JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r WHERE score > 0)
WHERE rank <= {TOP}"""


@query(SEARCH_SQL)
def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
