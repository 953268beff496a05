"""Two-pass external shuffle of a table into shards.

Pass one scatters whole records into buckets by a seeded hash of their row number. A
bucket's size is set in bytes, so any bucket fits a task however large the table is, and
copies of a record spread like all others, for the hash sees the row number alone. Pass two
permutes each bucket: its records are put in the order of their row number and then
shuffled by ``shuffle``, Spark's seeded Fisher-Yates. The buckets laid end to end are one
random permutation, which is cut into shards whose row counts differ by one at most.

The main path is made of DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwork.llm.base import checkpointed, free_name, numbered, query, table

SHARDS = 40
BUCKET_BYTES = 16 << 20
SEED = 20_240_601


def record_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 16


def shuffle_into_shards(
    df: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, text: str = "text"
) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0).

    ``bucket_bytes`` sets the expected size of a bucket. ``df`` must be a scan or a
    checkpointed frame (see ``base``). A null or empty text counts 16 bytes; nulls in other
    columns travel along; repeated rows are separate rows with slots of their own; of an empty
    table the result is empty. Columns that the input already calls ``shard`` or ``slot`` are
    replaced; inner names can't clash, for a record travels in a struct.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    row_no = free_name(df, "row_no")
    size = record_bytes(text)
    total = df.agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    rows, buckets = total["n"], max(1, math.ceil((total["bytes"] or 0) / bucket_bytes))
    records = numbered(df, row_no).select(
        F.pmod(F.xxhash64(F.lit(seed), F.col(row_no)), F.lit(buckets)).cast("int").alias("bucket"),
        F.struct(F.col(row_no).alias("row_no"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("body")).alias("record"),
    )
    # where each bucket begins in the whole permutation: a row per bucket
    starts = checkpointed(
        records.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("begins"))
    )
    by_row = lambda a, b: F.when(a["row_no"] < b["row_no"], -1).otherwise(1)
    filled = records.repartition(buckets, "bucket").groupBy("bucket").agg(F.collect_list("record").alias("records"))
    placed = (
        filled.join(starts, "bucket")
        .select("begins", F.posexplode(F.shuffle(F.array_sort("records", by_row), seed)).alias("place", "record"))
        .select("record.body", (F.col("begins") + F.col("place")).alias("position"))
        .select("body", "position", F.expr(f"position * {shards} div {max(rows, 1)}").alias("shard"))
    )
    # shard s holds the positions from ceil(s * rows / shards) on
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return placed.select(
        "body.*", F.col("shard").cast("int").alias("shard"), (F.col("position") - first).cast("long").alias("slot")
    )


def write_shards(df: DataFrame, path: str, **options) -> None:
    """The shuffled records as Parquet, one folder per shard, in the order of their slots within a file."""
    (
        shuffle_into_shards(df, **options)
        .repartition("shard", F.expr("slot div 100000"))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )


@query()
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shuffle_into_shards(docs).select(
        "doc_id",
        record_bytes().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
