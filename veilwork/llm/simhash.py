"""SimHash near-duplicates with a pigeonring filter.

The 64 bits lie on a ring of four segments. If two fingerprints differ in at most three bits,
some segment starts a chain that is within its proportional budget at every length: no bit
in the first segment, at most one in the first two, two in the first three, three in all.
The index key is the head of such a chain, the first segment together with the second
less one quarter of its bits, for a single differing bit spares three of four quarters. So
each distinct fingerprint lies under 16 keys of 28 bits. Pairs within a key pass the rest
of the chain before their whole distance is taken.

Exact copies share a fingerprint and are one node. A key with more fingerprints than
``BLOCK`` is keyed anew on the bits it has not fixed, as often as need be, so no group is
gathered beyond a bound and no pair is lost; a key only emits links that join what it
hasn't joined yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.base import checkpointed, free_name, lean, numbered, query, table
from veilwork.llm.components import components

SHINGLE = 3
BITS = 3
BLOCK = 256  # fingerprints of one key that a task compares with each other
HASH_SEED = 42
SLICE = 1 << 16  # shingles whose bits are counted at a time
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half the shingles' hashes; repeats count; 0 of a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, HASH_SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, ids: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The columns ``ids`` of ``docs`` and ``fp``, the fingerprint as a signed long."""

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(len(ids)).to_pylist()], np.uint64)
            columns = [batch.column(i) for i in range(len(ids))] + [pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*ids, "fp"])

    picked = docs.select(*ids, F.col(text).cast("string").alias("the_text"))
    return picked.mapInArrow(work, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids) + ", fp bigint")


def _chain_heads() -> list[tuple[int, int]]:
    """(segment, spared quarter of the next segment): the 16 index keys."""
    return [(s, q) for s in range(4) for q in range(4)]


def _head_mask(segment: int, quarter: int) -> int:
    first = 0xFFFF << 16 * segment
    second = (0xFFFF & ~(0xF << 4 * quarter)) << 16 * ((segment + 1) % 4)
    return first | second


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _refined(mask: int, parts: int = BITS + 1) -> list[int]:
    """Masks that fix one of ``parts`` pieces of the bits ``mask`` leaves free; three bits can't touch all four."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[p::parts]) for p in range(parts)] if len(free) > 8 else []


def _joined(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join what is within ``bits`` among the fingerprints of one key; a forest of them is enough."""
    root = np.arange(len(fps))
    links = []
    for i in range(len(fps) - 1):
        apart = fps[i + 1 :] ^ fps[i]
        near = _ring_near(apart, bits)
        for j in np.flatnonzero(near) + i + 1:
            a, b = root[i], root[j]
            if a != b:
                root[root == b] = a
                links.append((i, int(j)))
    return links


def _ring_near(apart: np.ndarray, bits: int) -> np.ndarray:
    """Which differences pass a chain of the pigeonring and then the whole distance."""
    ring = np.stack([np.bitwise_count((apart >> np.uint64(16 * s)) & np.uint64(0xFFFF)) for s in range(4)]).astype(np.int64)
    passed = np.zeros(len(apart), bool)
    for s in range(4):
        total, ok = np.zeros(len(apart), np.int64), np.ones(len(apart), bool)
        for length in range(1, 5):
            total = total + ring[(s + length - 1) % 4]
            ok &= 4 * total <= length * bits
        passed |= ok
    return passed & (ring.sum(axis=0) <= bits)


def near_links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, b``: links that connect all distinct ``fp`` of ``nodes`` within three bits of each other.

    Not every pair gets a link, but any two within three bits are connected by links.
    """
    spark = nodes.sparkSession
    schema = "a bigint, b bigint"

    @lean
    def join_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            for values in batch.column(0):
                fps = np.sort(values.values.to_numpy().view(np.uint64))
                if pairs := _joined(fps, BITS):
                    found.append(fps.view(np.int64)[np.array(pairs)])
            a, b = np.concatenate(found).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    links = spark.createDataFrame([], schema)
    masks = [_head_mask(s, q) for s, q in _chain_heads()]
    keyed = nodes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    while True:
        finer = {m: f for m in masks if (f := _refined(m))}
        keyed = keyed.select("fp", "mask", F.expr("fp & mask").alias("key"))
        counts = checkpointed(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        shared = keyed.join(counts, ["mask", "key"])
        # a key that leaves eight bits free has at most 256 fingerprints
        large = (F.col("n") > block) & F.col("mask").isin([_signed(m) for m in finer]) if finer else F.lit(False)
        small = shared.where(~large).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        links = links.union(small.select("fps").mapInArrow(join_keys, schema).distinct())
        left = {r["mask"] for r in counts.where(large).select("mask").distinct().collect()}  # masks, not data
        if not left:
            return links
        finer = {m: f for m, f in finer.items() if _signed(m) in left}
        to = F.create_map(*[x for m, f in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in f]))])
        keyed = shared.where(large).select("fp", F.explode(to[F.col("mask")]).alias("mask")).distinct()
        masks = sorted({x for f in finer.values() for x in f})


def near_groups(marked: DataFrame) -> DataFrame:
    """``fp, root`` for each distinct fingerprint of ``marked``: root is the same for all that are linked."""
    nodes = checkpointed(marked.select("fp").distinct())
    roots = components(near_links(nodes))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def simhash_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    A null or blank text has the fingerprint zero, linked like any other. Rows without an id
    keep a null id and belong to components as all others; a component without any id has
    the id null. Repeated rows come out as often as they come in. Other columns are not read.
    """
    marked = checkpointed(fingerprints(docs, ["doc_id"], shingle=shingle))
    groups = near_groups(marked)
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    known = groups.join(least, "fp")
    heads = known.groupBy("root").agg(F.min("least").alias("component_id"))
    found = known.select("fp", "root").join(heads, "root").select("fp", "component_id")
    return marked.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component of ``docs``, with all columns: the one with the least id, then the first read.

    Rows with a null id come after the others. ``docs`` must be a scan or a checkpointed frame.
    """
    row_no = free_name(docs, "row_no")
    rows = numbered(docs, row_no)
    marked = checkpointed(fingerprints(rows.withColumn("doc_id", F.col("doc_id")), ["doc_id", row_no], shingle=shingle))
    groups = near_groups(marked)
    order = F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", F.col(row_no).alias("no"))
    first = marked.groupBy("fp").agg(F.min(order).alias("first"))
    kept = first.join(groups, "fp").groupBy("root").agg(F.min("first").alias("first"))
    return rows.join(kept.select(F.col("first.no").alias(row_no)), row_no, "left_semi").drop(row_no)


@query()
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
