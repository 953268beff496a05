"""Numbering rows inside a group without putting the group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_within(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    out: str = "idx",
) -> DataFrame:
    """Add the 1-based number of each row in its group, by ``order``.

    ``bucket`` cuts a group into consecutive ranges of the order.  Rows are
    sorted only inside a bucket; buckets are offset by a running sum over their
    counts, so a group that holds most of the table still spreads over many tasks.
    """
    keys = [*group, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        rows.withColumn("_rank", inside)
        .join(offsets, keys)
        .withColumn(out, (F.col("_before") + F.col("_rank")).cast("bigint"))
        .drop("_bucket", "_before", "_rank")
    )
