"""Request bodies as JSON trees: chosen strings are rewritten, everything else stays as it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.let import let
from veilwork.functions.masking import mask_prompts
from veilwork.functions.variants import fields_of, list_of, node, text_of
from veilwork.rules import ScrubRules

_NOTHING = "array<string>"


def _variant(text: Column) -> Column:
    return text.cast("variant")


def with_field(tree: Column, field: str, value: Column) -> Column:
    """An object with another value for a field that it has."""
    fields = F.transform_values(fields_of(tree), lambda k, v: F.when(k == field, value).otherwise(v))
    return F.to_variant_object(fields)


def _is_text_part(part: Column) -> Column:
    return (text_of(node(part, "type")) == "text") & text_of(node(part, "text")).isNotNull()


def message_texts(message: Column) -> Column:
    """The texts of a message that may be masked: its content, then one per part; null where there is none."""
    content = node(message, "content")
    parts = F.transform(list_of(content), lambda p: F.when(_is_text_part(p), text_of(node(p, "text"))))
    return F.concat(F.array(text_of(content)), F.coalesce(parts, F.array().cast(_NOTHING)))


def with_message_texts(message: Column, texts: Column) -> Column:
    """The message with ``texts`` in the places of :func:`message_texts`; a message without content stays."""
    content = node(message, "content")
    parts = F.transform(
        list_of(content),
        lambda p, i: F.when(_is_text_part(p), with_field(p, "text", _variant(F.get(texts, i + 1)))).otherwise(p),
    )
    changed = F.when(text_of(content).isNotNull(), _variant(F.get(texts, F.lit(0)))).otherwise(F.to_variant_object(parts))
    may_change = text_of(content).isNotNull() | parts.isNotNull()
    return F.when(may_change, with_field(message, "content", changed)).otherwise(message)


def mask_body(body: Column, rules: ScrubRules | None = None) -> Column:
    """Struct of ``body`` (a VARIANT) with its texts masked under one numbering, ``map`` and ``counts`` per category.

    In a list of ``messages``, contents and text parts are masked; without such a list the ``prompt`` is, a string or the strings of a list.
    All other fields of the body, the messages and the parts come back as they are, and so does a body that isn't an object.
    """
    rules = rules or ScrubRules()
    messages, prompt = list_of(node(body, "messages")), node(body, "prompt")
    prompts = list_of(prompt)

    def of_messages(nested: Column) -> Column:
        sizes = F.transform(nested, F.size)

        def rebuilt(done: Column) -> Column:
            def one(message: Column, i: Column) -> Column:
                before = F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda n, k: n + k)
                return with_message_texts(message, F.slice(done["prompts"], before + 1, F.get(sizes, i)))

            changed = F.to_variant_object(F.transform(messages, one))
            return F.struct(with_field(body, "messages", changed).alias("body"), done["map"].alias("map"), done["counts"].alias("counts"))

        return let(mask_prompts(F.flatten(nested), rules), rebuilt)

    def of_prompts(done: Column) -> Column:
        listed = F.transform(
            prompts, lambda p, i: F.when(text_of(p).isNotNull(), _variant(F.get(done["prompts"], i))).otherwise(p)
        )
        changed = F.when(prompts.isNotNull(), F.to_variant_object(listed)).otherwise(_variant(F.get(done["prompts"], F.lit(0))))
        return F.struct(with_field(body, "prompt", changed).alias("body"), done["map"].alias("map"), done["counts"].alias("counts"))

    texts = F.coalesce(F.transform(prompts, text_of), F.array(text_of(prompt)))
    kind = "array<struct<mask:string,original:string>>"
    return (
        F.when(messages.isNotNull(), let(F.transform(messages, message_texts), of_messages))
        .when(prompts.isNotNull() | text_of(prompt).isNotNull(), let(mask_prompts(texts, rules), of_prompts))
        .otherwise(F.struct(body.alias("body"), F.array().cast(kind).alias("map"), F.create_map().cast("map<string,bigint>").alias("counts")))
    )
