"""Connected components of a table of links, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.base import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b`` longs): root is the least node reachable.

    Alternates the large-star and small-star steps until nothing changes: in each, a node
    hands its neighbours over to the least node it knows. A step groups with map-side minima
    and joins them back, so that a hub with most of the links spreads over many tasks.
    """
    edges = checkpointed(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    )
    mark = None
    while True:
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        large = (
            both.groupBy("hi")
            .agg(F.min("lo").alias("m"))
            .select(F.col("hi").alias("node"), F.least("m", "hi").alias("m"))
        )
        # every neighbour above the node goes to the least one known
        edges = (
            both.where("lo > hi")
            .select(F.col("hi").alias("node"), F.col("lo").alias("far"))
            .join(large, "node")
            .select(F.col("far").alias("hi"), F.col("m").alias("lo"))
            .distinct()
        )
        small = edges.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = edges.join(small, "hi")
        edges = checkpointed(
            moved.select("hi", F.col("m").alias("lo"))
            .union(moved.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
            .distinct()
        )
        # equal count and sums: a star forest stays as it is, any other graph moves
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.countDistinct("hi")
        ).first()
        if mark == now:
            break
        mark = now
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
