"""Server-sent-event lines of streamed replies, read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions.bodies import with_field
from veilwork.functions.jsonfix import parse_strict, strip
from veilwork.functions.let import bound, let
from veilwork.functions.variants import fields_of, list_of, node

# --- fixed values ---
PREFIX = "data:"
DONE = "[DONE]"

CHUNK_OBJECT = "chat.completion.chunk"
CHUNK_ID = "chatcmpl-stream-"
# --- end of fixed values ---

CHUNK_TYPE = "struct<choices:array<struct<delta:struct<content:string>,text:string>>>"


def payload_of(line: Column) -> Column:
    """What a data line holds; null of any other line."""
    return F.when(
        line.startswith(PREFIX), strip(F.substring(line, F.lit(len(PREFIX) + 1), F.length(line)))
    )


def is_end(line: Column) -> Column:
    """Whether a line is the end mark."""
    return F.coalesce(payload_of(line) == DONE, F.lit(False))


def parse_sse(line: Column) -> Column:
    """Struct ``kind, payload, piece, is_done``.

    ``kind`` is blank, other (no data line), done, piece (non-empty delta
    content), text (legacy text), data (other JSON) or broken (data that isn't
    JSON); blank, other, data and broken lines pass through.
    """

    def parsed(p: Column) -> Column:
        first = F.get(F.from_json(p, CHUNK_TYPE)["choices"], F.lit(0))
        # bound before it is looked into: each mention of it would parse the payload again
        return let(F.when(p != DONE, first), lambda c: let(chosen(p, c), sorted_out))

    def chosen(p: Column, first: Column) -> Column:
        return F.struct(
            p.alias("payload"),
            F.when(F.length(first["delta"]["content"]) > 0, first["delta"]["content"]).alias("delta"),
            F.when(F.length(first["text"]) > 0, first["text"]).alias("text"),
        )

    def sorted_out(c: Column) -> Column:
        p, delta, text = c["payload"], c["delta"], c["text"]
        kind = (
            F.when(F.length(line) == 0, "blank")
            .when(p.isNull(), "other")
            .when(p == DONE, "done")
            .when(delta.isNotNull(), "piece")
            .when(text.isNotNull(), "text")
            .when(parse_strict(p).isNotNull(), "data")
            .otherwise("broken")
        )
        return F.struct(
            kind.alias("kind"),
            p.alias("payload"),
            F.when(p != DONE, F.coalesce(delta, text)).alias("piece"),
            F.coalesce(p == DONE, F.lit(False)).alias("is_done"),
        )

    return let(payload_of(line), parsed)


def parse_sse_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Add ``kind, payload, piece, is_done`` to a (batch or streaming) table of lines."""
    return (
        bound(df, "_sse", parse_sse(F.col(line)))
        .withColumn("kind", F.col("_sse.kind"))
        .withColumn("payload", F.col("_sse.payload"))
        .withColumn("piece", F.col("_sse.piece"))
        .withColumn("is_done", F.col("_sse.is_done"))
        .drop("_sse")
    )


def completion_chunks(df: DataFrame, stream: str = "stream_id") -> DataFrame:
    """Non-empty content chunks per stream, which settle as completion tokens."""
    return df.groupBy(stream).agg(F.count_if(F.col("kind") == "piece").alias("n_chunks"))


def up_to_the_end(parsed: DataFrame, stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """Lines of each stream up to its end mark; what follows is never read."""
    before = Window.partitionBy(stream).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max("is_done").over(before), F.lit(False))
    return parsed.withColumn("_ended", ended).where("not _ended").drop("_ended")


def with_content(payload: Column, content: Column) -> Column:
    """The JSON text of a chunk whose first choice's delta says ``content``; all other fields stay."""
    chunk = F.try_parse_json(payload)
    choices = list_of(node(chunk, "choices"))

    def first(choice: Column) -> Column:
        delta = with_field(node(choice, "delta"), "content", content.cast("variant"))
        return with_field(choice, "delta", delta)

    changed = F.transform(choices, lambda c, i: F.when(i == 0, first(c)).otherwise(c))
    return F.to_json(with_field(chunk, "choices", F.to_variant_object(changed)))


def line_out(safe: Column, model: Column, created: Column) -> Column:
    """The text that is sent on for a parsed line (``line, kind, payload``).

    A piece carries what it releases, which may be nothing. The end mark is preceded by a chunk with the rest, if any. Other data
    passes as it is, with the blank line that ends an event; what is no data, or no JSON object, passes as a line.
    """
    kind, payload, line = F.col("kind"), F.col("payload"), F.col("line")
    data = lambda text: F.concat(F.lit(f"{PREFIX} "), text, F.lit("\n\n"))
    choice = F.struct(
        F.struct(safe.alias("content")).alias("delta"), F.lit(None).cast("string").alias("finish_reason"), F.lit(0).alias("index")
    )
    flush = F.to_json(
        F.struct(
            F.array(choice).alias("choices"),
            created.alias("created"),
            F.concat(F.lit(CHUNK_ID), created.cast("string")).alias("id"),
            F.coalesce(model, F.lit("")).alias("model"),
            F.lit(CHUNK_OBJECT).alias("object"),
        ),
        {"ignoreNullFields": "false"},
    )
    is_object = fields_of(F.try_parse_json(payload)).isNotNull()
    return (
        F.when(kind == "blank", F.lit("\n"))
        .when(kind == "done", F.concat(F.when(F.length(safe) > 0, data(flush)).otherwise(F.lit("")), data(F.lit(DONE))))
        .when(kind == "piece", data(with_content(payload, F.coalesce(safe, F.lit("")))))
        .when(kind.isin("text", "data") & is_object, data(payload))
        .otherwise(F.concat(line, F.lit("\n")))
    )
