"""Centroid clustering by a bisector tournament.

Vectors and centroids are whole numbers. For centroids ``i < j`` the points as near to one as to the other
lie on a plane: ``j`` is nearer to ``x`` exactly if ``2 (c_j - c_i) . x > |c_j|^2 - |c_i|^2``. Normals and
thresholds of all pairs are taken once a round. A vector then meets the centroids one after another: the
holder and the next one play by the sign of one linear form, zero favours the smaller number, and the loser is out.
After ``k - 1`` tests one is left, and only its distance is computed.

Everything is integer arithmetic, so the result depends neither on the order of the rows nor on their split. Vectors are
assigned where they are read: a round shuffles one row of sums per task and cluster and brings ``k`` rows to the
driver, and tasks get ``k`` centroids.

Defined results: null vectors, other lengths and null, NaN or infinite components are left out; components beyond
``LIMIT`` either way count as ``LIMIT``, so that all distances fit a long. Sums over rows saturate at the longest long.
Equal distances go to the smaller number. With fewer than ``k`` vectors there are as many centroids; rows that tie for the first
centroids (a repeated id) go by their components. A null id counts as an empty text there and stays null. Repeated
rows come out as often as they come in. An empty table gives no rows. Columns besides the id and the vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.base import checkpointed, query, table

WIDTH = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
LIMIT = 1 << 26  # of a component: 64 squares of twice that are below 2^61
EXACT = 1 << 20  # components up to here make linear forms that doubles hold exactly
ROWS = 4096  # vectors in a tournament at a time


def whole_vectors(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that count, and their whole components, a row each."""
    lists = column.cast(pa.large_list(pa.float64()))
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == width)
    if not len(at):
        return at, np.zeros((0, width), np.int64)
    # nulls become NaN, which goes with the infinite ones
    values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    finite = np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(values[finite] * SCALE)
    return at[finite], np.clip(scaled, -LIMIT, LIMIT).astype(np.int64)


class Tournament:
    """Normals and thresholds of all pairs of ``centroids`` (a row each)."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = np.asarray(centroids, np.int64)
        squares = (self.centroids**2).sum(axis=1)
        self.normals = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]
        self.small = not len(centroids) or int(np.abs(self.centroids).max()) <= EXACT

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """Number of the centroid that wins against all others, per vector."""
        holder = np.zeros(len(vectors), np.int64)
        exact = self.small and (not len(vectors) or int(np.abs(vectors).max()) <= EXACT)
        kind = np.float64 if exact else np.int64
        normals, thresholds = self.normals.astype(kind), self.thresholds.astype(kind)
        for at in range(0, len(vectors), ROWS):
            part = vectors[at : at + ROWS].astype(kind)
            held = holder[at : at + ROWS]
            for j in range(1, len(self.centroids)):
                side = np.einsum("nd,nd->n", part, normals[held, j]) - thresholds[held, j]
                held[side > 0] = j
        return holder

    def distances(self, vectors: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        apart = vectors - self.centroids[cluster]
        return np.einsum("nd,nd->n", apart, apart)


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, key: str = "vec_id", column: str = "embedding") -> np.ndarray:
    """The vectors whose ids hash lowest."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, whole = whole_vectors(batch.column(1))
            chosen = batch.column(0).take(pa.array(at))
            lists = pa.array(list(whole), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([chosen, lists], names=["digest", "vector"])

    digest = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("digest"), F.col(column).cast("array<double>"))
    first = rows.mapInArrow(counted, "digest string, vector array<bigint>").orderBy("digest", "vector").limit(clusters)
    return np.array([r["vector"] for r in first.collect()], np.int64).reshape(-1, WIDTH)


def centroid_sums(vectors: DataFrame, centroids: np.ndarray, column: str = "embedding") -> DataFrame:
    """``cluster, n, sums``: the number of vectors of each cluster and their componentwise sums."""
    tournament = Tournament(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, whole = whole_vectors(batch.column(0))
            won = tournament.nearest(whole)
            order = np.argsort(won, kind="stable")
            found, begins = np.unique(won[order], return_index=True)
            sums = np.add.reduceat(whole[order], begins, axis=0) if len(found) else np.zeros((0, WIDTH), np.int64)
            counts = np.diff(np.append(begins, len(won)))
            columns = [pa.array(found), pa.array(counts.astype(np.int64)), *map(pa.array, sums.T)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["cluster", "n", *[f"s{i}" for i in range(WIDTH)]]
    parts = vectors.select(F.col(column).cast("array<double>")).mapInArrow(add, ", ".join(f"{n} bigint" for n in names))
    return parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col(n).cast("decimal(38,0)")) for n in names[2:]]).alias("sums")
    )


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, key: str = "vec_id", column: str = "embedding") -> np.ndarray:
    """Centroids after ``rounds`` rounds; each is the floor of its vectors' mean, and one without vectors stays."""
    centroids = first_centroids(vectors, clusters, key, column)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for r in centroid_sums(vectors, centroids, column).collect():  # a row per cluster
            moved[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key, cluster, distance`` of each vector that counts."""
    tournament = Tournament(centroids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, whole = whole_vectors(batch.column(1))
            won = tournament.nearest(whole)
            columns = [batch.column(0).take(pa.array(at)), pa.array(won.astype(np.int32)), pa.array(tournament.distances(whole, won))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "cluster", "distance"])

    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key), F.col(column).cast("array<double>"))
    return rows.mapInArrow(work, f"`{key}` {kind}, cluster int, distance bigint")


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of ``vectors`` (``vec_id``, ``embedding``).

    See the module for what is left out and how ties and edge cases come out.
    """
    centroids = fit(vectors, clusters, rounds)
    assigned = checkpointed(assign(vectors, centroids))
    most = (1 << 63) - 1
    totals = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    by_cluster = [0] * max(1, len(centroids))
    for r in totals:  # a row per cluster
        by_cluster[r["cluster"]] = int(r["s"])
    digests = [centroid_digest(c) for c in centroids] or [""]
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        F.element_at(F.array(*[F.lit(min(s, most)).cast("bigint") for s in by_cluster]), F.col("cluster") + 1).alias("cluster_inertia"),
        F.lit(min(sum(by_cluster), most)).cast("bigint").alias("inertia"),
        F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1).alias("centroid_sha256"),
    )


def _round_sql(n: int) -> str:
    """Assignment to the centroids ``c{n}`` and their successors ``c{n + 1}``."""
    return f"""
a{n} AS MATERIALIZED (SELECT v, arg_min(k, d * 64 + k) AS k FROM (
  SELECT x.v, c.k, list_sum(list_transform(list_zip(x.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM x, c{n} c) GROUP BY v),
s{n} AS MATERIALIZED (SELECT k, list(m ORDER BY i) AS x FROM (
  SELECT a.k, u.i, ((sum(u.y) - (((sum(u.y) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS m
  FROM a{n} a JOIN u USING (v) GROUP BY a.k, u.i) GROUP BY k),
c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(s.x, c.x) AS x FROM c{n} c LEFT JOIN s{n} s USING (k)),"""


CLUSTER_SQL = (
    f"""WITH kept AS (SELECT vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
x AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS v, vec_id, list_transform(e, lambda y: floor({SCALE} * y::DOUBLE)::BIGINT) AS x FROM kept),
u AS MATERIALIZED (SELECT v, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM x),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, x FROM (
  SELECT sha256('2:' || vec_id::VARCHAR) AS h, x FROM x ORDER BY h LIMIT {CLUSTERS})),"""
    + "".join(_round_sql(n) for n in range(ROUNDS))
    + f"""
d AS MATERIALIZED (SELECT v, k, d FROM (
  SELECT v, k, d, row_number() OVER (PARTITION BY v ORDER BY d, k) AS r FROM (
    SELECT x.v, c.k, list_sum(list_transform(list_zip(x.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM x, c{ROUNDS} c)) WHERE r = 1)
SELECT x.vec_id, d.k::INTEGER AS cluster, d.d AS distance,
  (sum(d.d) OVER (PARTITION BY d.k))::BIGINT AS cluster_inertia, (sum(d.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM d JOIN x USING (v) JOIN c{ROUNDS} c ON c.k = d.k"""
)


@query(CLUSTER_SQL)
def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))
