"""One masking session over many rows: a value keeps its mask from turn to turn.

Turns are scanned on their own, wherever they lie.  Only the distinct values
found are shuffled: first by value, to see where in the session each came
first, then by session and range of turns, to number them.  No step gathers a
session, so one that holds a third of the table is no slower than the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.functions.let import bound, let
from veilwork.functions.masking import free_tag, scan_text
from veilwork.operators.numbering import number_within
from veilwork.rules import ScrubRules
from veilwork.session import as_long, checkpointed, written

TURNS_PER_BUCKET = 1024


def scan_turns(
    df: DataFrame, session: str, order: Sequence[str], text: str, rules: ScrubRules
) -> DataFrame:
    """Turns that contain something to mask, with tagged stand-ins in their text, and the tag."""
    found = _scan_all(df, session, order, text, rules)
    return found.where(F.size("scan.seen") > 0).select(session, *order, "scan")


def _scan_all(
    df: DataFrame, session: str, order: Sequence[str], text: str, rules: ScrubRules, carry: Sequence[str] = ()
) -> DataFrame:
    """All turns with what the rules found in them."""

    def with_tag(tag):
        return let(
            scan_text(F.col(text), rules, tag=tag),
            lambda s: F.struct(s["text"].alias("text"), s["seen"].alias("seen"), tag.alias("tag")),
        )

    return bound(df.select(session, *order, *carry, text), "scan", let(free_tag(F.col(text)), with_tag))


def turn_values(scanned: DataFrame, session: str, order: Sequence[str]) -> DataFrame:
    """One row per turn and distinct value found in it."""
    return scanned.select(
        session, *order, F.posexplode_outer("scan.seen").alias("pos", "found")
    ).select(
        session,
        *order,
        "pos",
        F.col("found.value").alias("value"),
        F.col("found.category").alias("category"),
        F.col("found.rule").alias("rule"),
        F.col("found.mask").alias("stand_in"),
    )


def session_map(
    values: DataFrame, session: str, order: Sequence[str], rules: ScrubRules
) -> DataFrame:
    """The masks of every session: ``category, idx, mask, original`` and where it came first."""
    came = F.struct(*order, "pos", "category", "rule")
    first = values.groupBy(session, "value").agg(F.min(came).alias("first"))
    flat = first.select(
        session,
        F.col("value").alias("original"),
        *[F.col(f"first.{c}").alias(f"first_{c}") for c in (*order, "pos")],
        F.col("first.category").alias("category"),
        F.col("first.rule").alias("rule"),
    )
    numbered = number_within(
        flat,
        [session, "category"],
        [f"first_{c}" for c in (*order, "pos")],
        F.floor(F.col(f"first_{order[0]}") / TURNS_PER_BUCKET),
    )
    template = F.get(F.array(*[F.lit(r.template) for r in rules.ordered]), F.col("rule"))
    mask = F.replace(template, F.lit("{idx}"), F.col("idx").cast("string"))
    return numbered.withColumn("mask", mask).drop("rule")


def mask_map(
    df: DataFrame,
    session: str = "session_id",
    order: Sequence[str] = ("turn",),
    text: str = "text",
    rules: ScrubRules | None = None,
) -> DataFrame:
    """The reversible map of every session; without rows if the rules aren't reversible."""
    rules = rules or ScrubRules()
    values = turn_values(scan_turns(df, session, order, text, rules), session, order)
    entries = session_map(checkpointed(values), session, order, rules)
    if not rules.reversible:
        return entries.where(F.lit(False))
    return restorable(entries, session, order, rules)


def restorable(
    entries: DataFrame, session: str, order: Sequence[str], rules: ScrubRules
) -> DataFrame:
    """One original per mask: the latest, should two categories write the same mask."""
    if not rules.masks_may_collide:
        return entries
    latest = F.struct(*[F.col(f"first_{c}") for c in (*order, "pos")], "category", "idx", "original")
    kept = entries.groupBy(session, "mask").agg(F.max(latest).alias("last"))
    return kept.select(session, "mask", "last.*")


def mask_sessions(
    df: DataFrame,
    session: str = "session_id",
    order: Sequence[str] = ("turn",),
    text: str = "text",
    rules: ScrubRules | None = None,
    out: str = "masked",
) -> tuple[DataFrame, DataFrame]:
    """Mask all turns of all sessions.

    ``order`` (first an integer, such as the turn) must be unique in a session.
    Returns the turns with the masked text, and the mask map.
    """
    rules = rules or ScrubRules()
    if not rules.ordered:
        return df.select(session, *order, F.col(text).alias(out)), None
    return masked_turns(scanned_turns(df, session, order, text, rules), session, order, rules, out)


def scanned_turns(
    df: DataFrame, session: str, order: Sequence[str], text: str, rules: ScrubRules, carry: Sequence[str] = ()
) -> DataFrame:
    """All turns, scanned once, as a table: of a turn with hits the scan is kept, of any other the text. ``carry`` names columns to keep."""
    keys = [session, *order]
    hit = F.size("scan.seen") > 0
    return written(
        _scan_all(df, session, order, text, rules, carry).select(
            *keys, *carry, F.when(~hit, F.col(text)).alias("_same"), F.when(hit, F.col("scan")).alias("scan")
        ),
        "zstd" if carry else "snappy",
    )


def masked_turns(
    every: DataFrame, session: str, order: Sequence[str], rules: ScrubRules, out: str, carry: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Masked text of the turns that :func:`scanned_turns` made, and the mask map. Turns without a hit are not shuffled."""
    keys = [session, *order]
    scanned = every.where(F.col("scan").isNotNull()).select(*keys, *carry, "scan")
    values = turn_values(scanned, session, order)
    entries = session_map(values, session, order, rules)

    # a turn's own masks: as many as its own text has values
    of_turn = (
        values.join(
            as_long(entries.select(session, F.col("original").alias("value"), "mask")), [session, "value"]
        )
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("stand_in", "mask")).alias("swap"))
    )
    pieces = F.split(F.col("scan.text"), F.col("scan.tag"), -1)
    place = F.transform(F.col("swap.stand_in"), lambda s: F.replace(s, F.col("scan.tag"), F.lit("")))
    masked = F.array_join(
        F.transform(
            pieces,
            lambda piece, i: F.when(i % 2 == 0, piece).otherwise(
                F.get(
                    F.col("swap.mask"), F.array_position(F.col("place"), piece).cast("int") - 1
                )
            ),
        ),
        "",
    )
    changed = (
        scanned.join(as_long(of_turn), keys).withColumn("place", place).select(*keys, *carry, masked.alias(out))
    )
    same = every.where(F.col("scan").isNull()).select(*keys, *carry, F.col("_same").alias(out))
    if not rules.reversible:
        return same.unionByName(changed), entries.where(F.lit(False))
    return same.unionByName(changed), restorable(entries, session, order, rules)


def entity_counts(
    df: DataFrame,
    session: str = "session_id",
    order: Sequence[str] = ("turn",),
    text: str = "text",
    rules: ScrubRules | None = None,
) -> DataFrame:
    """Distinct values newly masked, per session and category."""
    rules = rules or ScrubRules()
    values = turn_values(scan_turns(df, session, order, text, rules), session, order)
    first = values.groupBy(session, "value").agg(
        F.min(F.struct(*order, "pos", "category")).alias("first")
    )
    return first.groupBy(session, F.col("first.category").alias("category")).agg(
        F.count(F.lit(1)).alias("n_values")
    )
