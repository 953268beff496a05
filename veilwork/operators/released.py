"""Replies that came in pieces: what may be released when, masked as one session.

A piece may end inside a value, so the last ``buffer`` characters are held back and text is released only up to a
blank; where there is none for long, it is cut all the same. Which blank that is depends on the text alone, not on what was
released before, so cut positions are running maxima over a reply's pieces in order. Only stretches without any blank need a
fold, over the ends of their pieces. What lies between two cuts is a turn of the session masker.

All of that is windows and joins: no reply is gathered. A value with blanks in it (a card in groups of four) can be
cut in two and missed, which masking of the whole text would not do.

Whole lines go by a shorter way, :func:`mask_lines`: they are shuffled once, read in order by a fold that holds back no more
than a window of text, and carried along with what they release, so that nothing is joined to them again. Windows are left to
replies whose lines can't be told apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from veilwork.operators.restore import may_hold_masks, unmask
from veilwork.operators.sessions import mask_sessions, masked_turns, scanned_turns
from veilwork.rules import ScrubRules
from veilwork.session import as_long, written

# --- fixed values ---
BUFFER = 64
FORCED_CUT_FACTOR = 4
BREAKS = " \t\n\r"
# --- end of fixed values ---

_UP_TO_A_BLANK = re.compile(f"(?s).*[{BREAKS}]")


def releasable(text: str, buffer: int = BUFFER) -> int:
    """How much of the text held so far may go: up to its last blank before the buffer, or all before it if there is too much."""
    beyond = max(0, len(text) - buffer)
    blank = beyond and _UP_TO_A_BLANK.match(text, 0, beyond + 1)
    if blank:
        return blank.end()
    return beyond if len(text) > FORCED_CUT_FACTOR * buffer else 0


def _after_last_blank(text: Column) -> Column:
    """Length of ``text`` up to and with its last blank; 0 without one."""
    plain = F.translate(text, BREAKS, " " * len(BREAKS))
    back = F.instr(F.reverse(plain), " ")
    return F.when(back > 0, F.length(text) - back + 1).otherwise(0)


def cut_positions(pieces: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """``stream_id, seq, text, begin, end, cut, cut_in``: how far the reply is released after each piece.

    ``pieces``: ``stream_id, seq, text``, without empty ones. Positions count characters from the reply's start; ``cut_in`` is
    the ``seq`` of the piece that holds the cut.
    """
    in_order = Window.partitionBy("stream_id").orderBy("seq")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("end", F.sum(F.length("text").cast("bigint")).over(so_far)).withColumn(
        "begin", F.col("end") - F.length("text")
    )
    blank = _after_last_blank(F.col("text"))
    placed = placed.withColumn("blank", F.when(blank > 0, F.struct((F.col("begin") + blank).alias("cut"), "seq")))
    by_end = Window.partitionBy("stream_id").orderBy("end")
    # pieces that end before the buffer, and the one in which it begins
    whole = F.max("blank").over(by_end.rangeBetween(Window.unboundedPreceding, -buffer))
    edge = F.first(F.struct("begin", "seq", "text")).over(by_end.rangeBetween(1 - buffer, 0))
    placed = placed.withColumns({"whole": whole, "edge": edge, "spare": F.col("end") - buffer})
    inside = _after_last_blank(F.substring(F.col("edge.text"), F.lit(1), (F.col("spare") - F.col("edge.begin") + 1).cast("int")))
    partial = F.when(
        (F.col("spare") > 0) & (inside > 0), F.struct((F.col("edge.begin") + inside).alias("cut"), F.col("edge.seq").alias("seq"))
    )
    natural = placed.withColumn("reached", F.max(F.greatest(partial, "whole")).over(so_far)).withColumn(
        "reached_cut", F.coalesce("reached.cut", F.lit(0).cast("bigint"))
    )

    # stretches without a blank: cut where they outgrow the limit, again and again, but with one cut a piece
    moved = F.col("reached_cut") > F.coalesce(F.lag("reached_cut").over(in_order), F.lit(0))
    natural = natural.withColumn("moved", moved)
    long = natural.where(~F.col("moved") & (F.col("end") - F.col("reached_cut") > FORCED_CUT_FACTOR * buffer))
    cuts_type = "array<struct<seq:bigint,cut:bigint>>"

    def step(done: Column, piece: Column) -> Column:
        over = piece["end"] - done["cut"] > FORCED_CUT_FACTOR * buffer
        cut = piece["end"] - buffer
        more = F.concat(done["cuts"], F.array(F.struct(piece["seq"].alias("seq"), cut.alias("cut")))).cast(cuts_type)
        return F.when(over, F.struct(cut.alias("cut"), more.alias("cuts"))).otherwise(done)

    forced = (
        long.groupBy("stream_id", "reached_cut")
        .agg(F.sort_array(F.collect_list(F.struct("end", F.col("seq").cast("bigint").alias("seq")))).alias("ends"))
        .select(
            "stream_id",
            F.explode(
                F.aggregate("ends", F.struct(F.col("reached_cut").alias("cut"), F.array().cast(cuts_type).alias("cuts")), step)["cuts"]
            ).alias("f"),
        )
        .select("stream_id", F.col("f.seq").alias("seq"), F.col("f.cut").alias("forced"))
    )
    found = natural.join(as_long(forced), ["stream_id", "seq"], "left")
    here = F.when(F.col("forced").isNotNull(), F.struct(F.col("forced").alias("cut"), F.col("edge.seq").alias("seq")))
    last = F.max(F.greatest(here, "reached")).over(so_far)
    return found.withColumn("last", last).select(
        "stream_id",
        "seq",
        "text",
        "begin",
        "end",
        F.coalesce("last.cut", F.lit(0).cast("bigint")).alias("cut"),
        F.col("last.seq").alias("cut_in"),
    )


def released_turns(pieces: DataFrame, ends: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """``stream_id, seq, text``: what is released with each piece that releases something, and with a reply's end.

    ``pieces``: ``stream_id, seq, text``; ``ends``: ``stream_id, seq`` of the lines that end a reply. Without one, the
    rest of the reply is held back for good.
    """
    cut = written(cut_positions(pieces.where(F.length("text") > 0), buffer))
    in_order = Window.partitionBy("stream_id").orderBy("seq")
    before = F.coalesce(F.lag("cut").over(in_order), F.lit(0).cast("bigint"))
    owners = cut.withColumn("from", before).where("cut > from").select("stream_id", "seq", "from", "cut", "cut_in")
    inner = owners.groupBy("stream_id", F.col("cut_in").alias("seq")).agg(F.collect_list("cut").alias("cuts"))
    held = cut.join(as_long(inner), ["stream_id", "seq"], "left")
    edges = F.array_sort(F.array_distinct(F.concat(F.array("begin", "end"), F.coalesce("cuts", F.array().cast("array<bigint>")))))
    parts = held.withColumn("edges", edges).select(
        "stream_id",
        "text",
        "begin",
        F.coalesce("cuts", F.array().cast("array<bigint>")).alias("cuts"),
        F.explode(F.arrays_zip(F.slice("edges", F.lit(1), F.size("edges") - 1).alias("from"), F.slice("edges", F.lit(2), F.size("edges")).alias("to"))).alias("p"),
    )
    parts = parts.select(
        "stream_id",
        F.col("p.from").alias("from"),
        F.substring("text", (F.col("p.from") - F.col("begin") + 1).cast("int"), (F.col("p.to") - F.col("p.from")).cast("int")).alias("text"),
        F.when(F.array_contains("cuts", F.col("p.from")), F.col("p.from")).alias("starts"),
        F.when(F.array_contains("cuts", F.col("p.to")), F.col("p.to")).alias("ends"),
    )
    by_place = Window.partitionBy("stream_id").orderBy("from")
    started = F.max("starts").over(by_place.rowsBetween(Window.unboundedPreceding, 0))
    ended = F.max("ends").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    turns = (
        parts.withColumn("turn_from", F.coalesce(F.greatest(started, ended), F.lit(0).cast("bigint")))
        .groupBy("stream_id", "turn_from")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("from", "text"))), lambda p: p["text"]), "").alias("text"))
    )
    rest = cut.groupBy("stream_id").agg(F.max("cut").alias("from"))
    flushed = ends.groupBy("stream_id").agg(F.min("seq").alias("seq")).join(as_long(rest), "stream_id")
    whose = owners.select("stream_id", "seq", F.col("from").alias("turn_from")).unionByName(
        flushed.select("stream_id", "seq", F.col("from").alias("turn_from"))
    )
    return turns.join(as_long(whose), ["stream_id", "turn_from"]).select("stream_id", "seq", "text")


def mask_released(
    pieces: DataFrame,
    ends: DataFrame,
    rules: ScrubRules | None = None,
    asked: DataFrame | None = None,
    buffer: int = BUFFER,
) -> tuple[DataFrame, DataFrame | None]:
    """``stream_id, seq, safe`` of what each piece releases, and the masks of each reply.

    ``asked`` (``stream_id, seq, text``, with ``seq`` below those of the pieces) are the texts of the request, whose masks go on in the reply.
    """
    rules = rules or ScrubRules()
    turns = written(released_turns(pieces, ends, buffer))
    every = turns.withColumn("asked", F.lit(False))
    if asked is not None:
        every = every.unionByName(asked.select("stream_id", "seq", "text").withColumn("asked", F.lit(True)))
    masked, entries = mask_sessions(every, "stream_id", ("seq",), "text", rules, out="safe")
    if asked is not None:
        masked = masked.join(as_long(turns.select("stream_id", "seq")), ["stream_id", "seq"], "left_semi")
    return masked.select("stream_id", "seq", "safe"), entries


def restored(masked: DataFrame, entries: DataFrame | None, rules: ScrubRules) -> DataFrame:
    """Released text with the masks of the request and the reply replaced by what they stand for; other columns stay."""
    if entries is None or not rules.reversible:
        return masked
    # only what may hold a mask is written
    holds = may_hold_masks(F.col("safe"), rules)
    found = unmask(written(masked.where(holds)), entries, ["stream_id", "seq"], "stream_id", "safe", rules, out="_restored")
    return found.withColumn("safe", F.col("_restored")).drop("_restored").unionByName(masked.where(~holds))


def in_order(lines: DataFrame) -> DataFrame:
    """Lines dealt by stream and sorted, as :func:`mask_lines` and windows over a stream read them."""
    return lines.repartition("stream_id").sortWithinPartitions("stream_id", "seq")


def with_turns(lines: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """``lines`` with ``_turn``, what each releases, in place of ``piece``, and ``_odd``.

    ``_odd`` says that its stream can't be read line by line: a key is null or comes again, or a piece follows the end.
    """
    kept = [c for c in lines.columns if c != "piece"]
    places = [kept.index(c) for c in ("stream_id", "seq", "is_done")]
    fields = [lines.schema[c] for c in kept]
    kind = StructType(fields).add("_turn", StringType()).add("_odd", BooleanType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, last, held, ended = object(), None, "", False
        for batch in batches:
            turns, odd = [], []
            for now, seq, done, piece in zip(*(batch.column(c).to_pylist() for c in (*places, len(kept)))):
                again = now == stream and seq == last
                if now != stream:
                    stream, held, ended = now, "", False
                last, turn = seq, None
                strange = again or now is None or seq is None or now != now
                if done:
                    turn, held, ended = held or None, "", True
                elif piece and done is not None:
                    strange = strange or ended
                    held += piece
                    cut = releasable(held, buffer)
                    if cut:
                        turn, held = held[:cut], held[cut:]
                turns.append(turn)
                odd.append(strange)
            columns = [*batch.columns[:-1], pa.array(turns, pa.string()), pa.array(odd, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=kind.names)

    return lines.select(*kept, "piece").mapInArrow(work, kind)


def mask_lines(
    lines: DataFrame, rules: ScrubRules, asked: DataFrame | None = None, buffer: int = BUFFER, back: bool = False
) -> DataFrame:
    """``lines`` with ``safe``, what each releases, masked, in place of ``piece``; ``back``: with the originals for masks.

    ``lines`` (:func:`in_order`): ``stream_id, seq, piece, is_done`` and others. ``piece`` is null of lines that carry none. ``asked``: as
    in :func:`mask_released`.
    """
    carry = [c for c in lines.columns if c not in ("stream_id", "seq", "piece")]
    every = with_turns(lines, buffer).withColumn("_asked", F.lit(False))
    if asked is not None:
        texts = asked.select("stream_id", "seq", F.col("text").alias("_turn"), F.lit(True).alias("_asked"), F.lit(False).alias("_odd"))
        every = every.unionByName(texts, allowMissingColumns=True)
    aside = [*carry, "_asked", "_odd"]
    if rules.ordered:
        every = scanned_turns(every, "stream_id", ("seq",), "_turn", rules, aside)
    else:
        every = written(every)
    odd = every.where("_odd").select(F.col("stream_id").alias("_stream")).distinct()
    strange = not odd.isEmpty()
    if strange:
        odd = written(odd)
        same = F.col("stream_id").eqNullSafe(F.col("_stream"))
        every = every.join(odd, same, "left_anti")
    if rules.ordered:
        masked, entries = masked_turns(every, "stream_id", ("seq",), rules, "safe", aside)
    else:
        masked, entries = every.withColumnRenamed("_turn", "safe"), None
    masked = masked.where("not _asked").drop("_asked", "_odd")
    safe = restored(masked, entries, rules) if back else masked
    columns = [F.col(c).cast(lines.schema[c].dataType).alias(c) for c in ("stream_id", "seq", *carry)]
    safe = safe.select(*columns, "safe")
    if strange:
        asked = asked if asked is None else asked.join(odd, same, "left_semi")
        safe = safe.unionByName(_lines_by_windows(lines.join(odd, same, "left_semi"), rules, asked, buffer, back))
    return safe


def _lines_by_windows(lines: DataFrame, rules: ScrubRules, asked: DataFrame | None, buffer: int, back: bool) -> DataFrame:
    kept = written(lines)
    pieces = kept.where("not is_done").select("stream_id", "seq", F.col("piece").alias("text"))
    safe, entries = mask_released(pieces, kept.where("is_done").select("stream_id", "seq"), rules, asked, buffer)
    if back:
        safe = restored(safe, entries, rules)
    return kept.drop("piece").join(as_long(safe), ["stream_id", "seq"], "left")
