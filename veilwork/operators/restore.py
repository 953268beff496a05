"""Put masked values back into replies."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.masking import restore_with
from veilwork.functions.regex import jvm_pattern
from veilwork.rules import ScrubRules
from veilwork.session import as_long


def masks_in(text: Column, rules: ScrubRules) -> Column:
    """Every mask text that the rules could have written and that occurs in ``text``."""
    per_rule = []
    for template in dict.fromkeys(r.template for r in rules.ordered):
        before, _, after = template.partition("{idx}")
        # look-ahead, so that occurrences may overlap
        runs = F.regexp_extract_all(
            text, F.lit(jvm_pattern(rf"(?={re.escape(before)}([1-9][0-9]*))")), F.lit(1)
        )
        if not after:
            # nothing marks the end of the number, so every prefix of it counts
            runs = F.flatten(
                F.transform(
                    runs,
                    lambda r: F.transform(
                        F.sequence(F.lit(1), F.length(r)), lambda n: F.substring(r, F.lit(1), n)
                    ),
                )
            )
        masks = _filled(F.array_distinct(runs), template)
        per_rule.append(F.filter(masks, lambda m: F.contains(text, m)))
    if not per_rule:
        return F.array().cast("array<string>")
    return F.array_distinct(F.concat(*per_rule))


def _mask_hint(rules: ScrubRules) -> str:
    """A pattern that a text must match to hold any mask."""
    starts = dict.fromkeys(r.template.partition("{idx}")[0] for r in rules.ordered)
    return jvm_pattern("(?:" + "|".join(re.escape(s) for s in starts) + ")[1-9]")


def may_hold_masks(text: Column, rules: ScrubRules) -> Column:
    """Whether ``text`` may hold a mask; never null."""
    return F.coalesce(text.rlike(_mask_hint(rules)), F.lit(False))


def _filled(numbers: Column, template: str) -> Column:
    return F.transform(numbers, lambda n: F.replace(F.lit(template), F.lit("{idx}"), n))


def unmask(
    replies: DataFrame,
    entries: DataFrame,
    keys: Sequence[str],
    session: str = "session_id",
    text: str = "text",
    rules: ScrubRules | None = None,
    out: str = "restored",
) -> DataFrame:
    """Replace each mask in a reply by its session's original, longest mask first.

    ``keys`` identify a reply.  Only the masks that a reply uses are looked up,
    so neither a session's map nor its replies are ever gathered: the lookup is
    an equi-join on (session, mask), and what comes back is bounded by the reply.
    Masks unknown to the session stay as they are.
    """
    rules = rules or ScrubRules()
    if not rules.ordered:
        return replies.withColumn(out, F.col(text))
    may_hold = may_hold_masks(F.col(text), rules)
    holding = replies.where(may_hold)
    used = holding.select(
        *keys, session, F.explode_outer(masks_in(F.col(text), rules)).alias("mask")
    ).where(F.col("mask").isNotNull())
    known = (
        used.join(as_long(entries.select(session, "mask", "original")), [session, "mask"])
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("mask", "original")).alias("_entries"))
    )
    restored = F.when(F.col("_entries").isNull(), F.col(text)).otherwise(
        restore_with(F.col(text), F.col("_entries"))
    )
    # replies without a mask are not shuffled at all
    return (
        holding.join(as_long(known), list(keys), "left")
        .withColumn(out, restored)
        .drop("_entries")
        .unionByName(replies.where(~may_hold).withColumn(out, F.col(text)))
    )
