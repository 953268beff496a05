"""Token estimates as Columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.variants import fields_of, list_of, node, text_of

from veilwork.functions.regex import SPACE

# --- fixed values: how text is cut, and what framing costs ---
PIECES = rf" ?[A-Za-z0-9_]++|[^\p{{L}}\p{{N}}_{SPACE}]|\n++|[{SPACE}]{{2,}}+"
SHORT_WORD = 6
CHARS_PER_TOKEN = 4
MESSAGE_OVERHEAD = 3
REPLY_PRIMER = 3
# --- end of fixed values ---

# Every piece is one token, except long words without an underscore and
# whitespace pieces of eight or more; only those are looked at one by one.
_LONG = (
    rf"(?<![A-Za-z0-9_])[A-Za-z0-9]{{{SHORT_WORD + 1},}}+(?!_)"
    rf"|\n{{8,}}+|(?<![{SPACE}&&[^\n]])(?!\n)[{SPACE}]{{8,}}+"
)


def estimate_tokens(text: Column) -> Column:
    """Estimated tokens of a text: 0 for null or empty, else at least 1."""
    pieces = F.size(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))).cast("bigint")

    def surplus(total: Column, piece: Column) -> Column:
        size = F.length(piece)
        is_word = (piece >= "0") & (piece < "{")
        return total + F.when(is_word, F.floor((size - 3) / CHARS_PER_TOKEN)).otherwise(
            F.floor(size / CHARS_PER_TOKEN) - 1
        )

    extra = F.aggregate(
        F.regexp_extract_all(text, F.lit(_LONG), F.lit(0)), F.lit(0).cast("bigint"), surplus
    )
    counted = F.greatest(F.lit(1).cast("bigint"), pieces + extra)
    return F.when(F.length(text) > 0, counted).otherwise(F.lit(0).cast("bigint"))


def count_tokens(text: Column, encode: Callable[[str], list] | None = None) -> Column:
    """Exact tokens with a caller's encoder, else the estimate.

    ``encode`` is any picklable function from text to a list of tokens.  It is
    called on Arrow batches; a text it fails on falls back to the estimate.
    """
    if encode is None:
        return estimate_tokens(text)

    @F.pandas_udf("bigint")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(value):
            if not value:
                return 0 if value == "" else None
            try:
                return len(encode(value))
            except Exception:
                return None

        for batch in batches:
            yield batch.map(one).astype("Int64")

    return F.coalesce(encoded(text), estimate_tokens(text))


def message_tokens(*fields: Column) -> Column:
    """Framing plus every text field of one message (role, name, content ...)."""
    total = F.lit(MESSAGE_OVERHEAD).cast("bigint")
    for field in fields:
        total = total + estimate_tokens(field)
    return total


def messages_tokens(messages: Column) -> Column:
    """Tokens of a request's ``array<struct<role,content,parts>>``."""

    def one(total: Column, message: Column) -> Column:
        parts = F.aggregate(
            F.coalesce(message["parts"], F.expr("array()").cast("array<struct<type:string,text:string,image_url:string>>")),
            F.lit(0).cast("bigint"),
            lambda n, p: n + F.when(p["type"] == "text", estimate_tokens(p["text"])).otherwise(0),
        )
        return total + message_tokens(message["role"], message["content"]) + parts

    return F.aggregate(messages, F.lit(REPLY_PRIMER).cast("bigint"), one)


def prompts_tokens(prompts: Column) -> Column:
    """Tokens of an array of plain prompts."""
    return F.aggregate(prompts, F.lit(0).cast("bigint"), lambda n, p: n + estimate_tokens(p))


def request_tokens(messages: Column, prompts: Column) -> Column:
    """Messages when there are any, else prompts, else 0."""
    return (
        F.when(F.size(messages) > 0, messages_tokens(messages))
        .when(F.size(prompts) > 0, prompts_tokens(prompts))
        .otherwise(F.lit(0).cast("bigint"))
    )


def body_tokens(body: Column) -> Column:
    """Tokens of a request body held as VARIANT: its messages, if there are any, else its prompt.

    Every string field of a message counts, and every text part of a list.  A
    prompt is a string, a list of strings, or a list of messages.
    """
    zero = F.lit(0).cast("bigint")

    def of_part(part: Column) -> Column:
        return F.when(
            text_of(node(part, "type")) == "text", F.coalesce(estimate_tokens(text_of(node(part, "text"))), zero)
        ).otherwise(zero)

    def of_field(value: Column) -> Column:
        parts = F.aggregate(F.coalesce(list_of(value), F.array().cast("array<variant>")), zero, lambda n, p: n + of_part(p))
        return F.coalesce(estimate_tokens(text_of(value)), zero) + parts

    def of_message(message: Column) -> Column:
        values = F.coalesce(F.map_values(fields_of(message)), F.array().cast("array<variant>"))
        return F.aggregate(values, F.lit(MESSAGE_OVERHEAD).cast("bigint"), lambda n, v: n + of_field(v))

    def of_messages(items: Column) -> Column:
        return F.aggregate(items, F.lit(REPLY_PRIMER).cast("bigint"), lambda n, m: n + of_message(m))

    messages, prompt = list_of(node(body, "messages")), node(body, "prompt")
    prompts = list_of(prompt)
    first_is_object = F.schema_of_variant(F.get(prompts, F.lit(0))).startswith("OBJECT")
    strings = F.aggregate(prompts, zero, lambda n, p: n + F.coalesce(estimate_tokens(text_of(p)), zero))
    return F.coalesce(
        F.when(F.size(messages) > 0, of_messages(messages))
        .when(F.size(prompts) > 0, F.when(first_is_object, of_messages(prompts)).otherwise(strings))
        .otherwise(estimate_tokens(text_of(prompt))),
        zero,
    )
