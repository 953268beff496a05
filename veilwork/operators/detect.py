"""Detection of personal data in a table of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.functions.let import bound
from veilwork.functions.masking import find_hits, mask_text_with_map, scan_text
from veilwork.rules import ScrubRules


def detect_entities(
    df: DataFrame, keys: Sequence[str], text: str = "text", rules: ScrubRules | None = None
) -> DataFrame:
    """One row per hit: ``keys``, ``category``, ``ordinal`` (per rule and text) and ``value``."""
    scanned = df.select(*keys, text).select(
        *keys, scan_text(F.col(text), rules or ScrubRules(), keep_hits=True)["hits"].alias("hits")
    )
    # outer: an inner explode would make the optimizer test the array in a filter of its own
    return (
        scanned.select(*keys, F.explode_outer("hits").alias("hit"))
        .where(F.col("hit").isNotNull())
        .select(
            *keys,
            F.col("hit.category").alias("category"),
            F.col("hit.ordinal").alias("ordinal"),
            F.col("hit.value").alias("value"),
        )
    )


def find_category(
    df: DataFrame,
    category: str,
    keys: Sequence[str],
    text: str = "text",
    rules: ScrubRules | None = None,
) -> DataFrame:
    """Hits of one category on the raw text: ``keys``, ``ordinal``, ``value``."""
    rules = rules or ScrubRules(patterns=(category,))
    rule = next(r for r in rules.ordered if r.category == category)
    found = df.select(*keys, text).select(
        *keys, F.posexplode_outer(find_hits(F.col(text), rule)).alias("pos", "value")
    )
    return found.where(F.col("value").isNotNull()).select(
        *keys, (F.col("pos") + 1).alias("ordinal"), "value"
    )


def mask_table(
    df: DataFrame, text: str = "text", rules: ScrubRules | None = None, out: str = "masked"
) -> DataFrame:
    """Mask one text column of a table, each row on its own; adds ``out`` and ``map``."""
    masked = bound(df, "_m", mask_text_with_map(F.col(text), rules))
    return masked.withColumns({out: F.col("_m.masked"), "map": F.col("_m.map")}).drop("_m")
