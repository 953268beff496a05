"""Streamed replies end to end: lines in, lines out, and what they are settled with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.operators.budgets import settle_usage
from veilwork.operators.released import BUFFER, in_order, mask_lines
from veilwork.rules import ScrubRules
from veilwork.session import as_long
from veilwork.sources import sse


def streamed_replies(
    lines: DataFrame,
    rules: ScrubRules | None = None,
    asked: DataFrame | None = None,
    buffer: int = BUFFER,
) -> DataFrame:
    """``stream_id, seq, kind, out``: what is sent on for each line, up to the end mark.

    ``lines``: ``stream_id, seq, line``, and optionally ``model`` and ``created`` (seconds) for the chunk that
    carries the rest. The pieces of a reply are masked as one session that goes on from the request's texts, ``asked``
    (``stream_id, seq, text``, ``seq`` below zero). If the rules are reversible, masks are then replaced by what they stand for. Only chat pieces
    are held back and masked; legacy text passes as it is.
    """
    rules = rules or ScrubRules()
    for name, kind in (("model", "string"), ("created", "bigint")):
        if name not in lines.columns:
            lines = lines.withColumn(name, F.lit(None).cast(kind))
    created = F.coalesce("created", F.unix_timestamp())
    # the one shuffle of lines takes them alone; what a line says again isn't kept beside it
    sent = lines.select("stream_id", "seq", "line", "model", created.alias("created"), sse.is_end(F.col("line")).alias("is_done"))
    parsed = sse.parse_sse_lines(sse.up_to_the_end(in_order(sent)))
    piece = F.when(F.col("kind") == "piece", F.col("piece"))
    kept = parsed.select("stream_id", "seq", "line", "model", "created", "kind", "is_done", piece.alias("piece"))
    whole = mask_lines(kept, rules, asked, buffer, back=True)
    return whole.withColumn("payload", sse.payload_of(F.col("line"))).select(
        "stream_id", "seq", "kind", sse.line_out(F.col("safe"), F.col("model"), F.col("created")).alias("out")
    )


def settle_streamed(guarded: DataFrame, replies: DataFrame) -> DataFrame:
    """Settled tokens of streamed replies: the estimate and one for each piece that came.

    ``guarded``: ``request_id`` and ``estimated_tokens`` of admitted requests; ``replies``: the output of :func:`streamed_replies`, whose streams are
    requests. A reply that came to no end failed and isn't settled.
    """
    chunks = sse.completion_chunks(replies.select("stream_id", "kind"))
    ended = replies.where("kind = 'done'").select("stream_id")
    counted = chunks.join(as_long(ended), "stream_id", "left_semi").select(
        F.col("stream_id").alias("request_id"), F.lit(None).cast("bigint").alias("total_tokens"), "n_chunks"
    )
    return settle_usage(guarded, counted, estimate="estimated_tokens", chunks="n_chunks")
