"""Registry of the queries and of the SQL that states their expected result."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.rules import IGNORE_CASE, PATTERNS
from veilwork.session import configure

Query = Callable[[SparkSession, str], DataFrame]

SMALL_BYTES = 256 << 20

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its oracle if SQL can state it."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A given table whose scan would leave cores without work, dealt to all of them.

    Splits are cut by bytes, but a row group goes whole to one of them: a table of few row groups has few tasks with rows,
    however large it is.  Up to ``SMALL_BYTES`` a table is dealt; beyond, only if its fullest split holds more than a core's
    share of the rows, which the files' footers tell.
    """
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if size > SMALL_BYTES:
        splits = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
        rows = splits.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        if rows["all"] is None or rows["most"] * cores <= rows["all"]:
            return df
    return df.repartition(cores * max(1, -(-size // SMALL_BYTES)))


def query_over(df: DataFrame, name: str, sql: str) -> DataFrame:
    """``sql`` with ``df`` in the place of table ``name``; leaves no view behind."""
    view = f"{name}_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        return df.sparkSession.sql(re.sub(rf"\bFROM {name}\b", f"FROM {view}", sql))
    finally:
        df.sparkSession.catalog.dropTempView(view)


def sql_text(value: str) -> str:
    """A string literal for the oracle's dialect."""
    return "'" + value.replace("'", "''") + "'"


def re2(category: str) -> str:
    """A built-in pattern as a literal for the oracle's matcher."""
    return sql_text(("(?i)" if category in IGNORE_CASE else "") + PATTERNS[category])


def luhn_sql(value: str) -> str:
    digits = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    weights = (
        f"list_transform(string_split(reverse({digits}), ''), lambda d, i: "
        "CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT > 4 THEN d::INT * 2 - 9 ELSE d::INT * 2 END)"
    )
    return f"(length({digits}) BETWEEN 13 AND 19 AND list_sum({weights}) % 10 = 0)"


def ts_us(column: str = "ts"):
    return F.unix_micros(F.col(column).cast("timestamp"))


# Text with at least one of everything, built by the same expression on both
# sides: the documents themselves have no social security numbers and no keys.
SEEDED = (
    "text || ' Write user' || CAST(doc_id % 7 AS STRING) || '@corp.io or U'"
    " || CAST(doc_id % 31 AS STRING) || '@Corp.io, SSN '"
    " || lpad(CAST(doc_id % 1000 AS STRING), 3, '0') || '-12-3456, key sk-'"
    " || lpad(CAST(doc_id AS STRING), 24, '0') || ' card 4111 1111 1111 1111 or 4111-1111-1111-'"
    " || lpad(CAST(doc_id % 10000 AS STRING), 4, '0') || ' host 10.0.'"
    " || CAST(doc_id % 250 AS STRING) || '.' || CAST(doc_id % 199 AS STRING)"
    " || ' tel 212-555-' || lpad(CAST(doc_id % 97 AS STRING), 4, '0') || ' bye'"
)


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with ``seeded`` in place of ``text``; sessions of every 50th document."""
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "lang",
        F.expr("doc_id % 50").alias("session_id"),
        F.col("doc_id").alias("turn"),
        F.expr(SEEDED).alias("text"),
    )
