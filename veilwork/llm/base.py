"""Registry of this subpackage's queries and what its operators share.

Row numbers: an operator that looks at its input more than once tells rows apart by
``numbered``. Its numbers come from the place of a row in its input split, so the input
must be a table scan or a checkpointed frame, which read the same rows in the same
order each time. No column of the input serves as a key, so nulls and repeated rows are
harmless, and a reserved column takes a name that the input doesn't have.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.session import checkpointed, configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

__all__ = ["ORACLES", "QUERIES", "checkpointed", "free_finished", "free_name", "lean", "numbered", "query", "remainder", "table"]


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_finished(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files of steps whose results are written.

    It does so when the JVM has collected what refers to them, which by itself can take longer than the next
    steps do. Spark refers to its last job until another one starts, so this belongs after a job that follows, such as
    the reading of a written table's schema.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return to the system what this process has freed but still holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` of a ``mapInArrow``, after which its worker gives back what it took.

    A Python worker lives on after its task, beside the JVM and the workers of other steps, and by itself keeps
    the memory of the largest task that it ever ran.
    """

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()  # work's own variables are gone here

    return run


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with underscores, so that ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def numbered(df: DataFrame, name: str = "row_no") -> DataFrame:
    """``df`` with a number per row in a column called ``name``."""
    return df.withColumn(name, F.monotonically_increasing_id())


def remainder(n: int, doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``n``; 0 for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % n, F.lit(0))
