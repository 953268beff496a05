"""The two composite plans: guard requests on their way in, replies on their way out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.functions.bodies import mask_body
from veilwork.functions.let import bound
from veilwork.functions.masking import mask_messages, mask_prompts, restore_with
from veilwork.functions.tokens import body_tokens, request_tokens
from veilwork.functions.variants import list_of, node, text_of
from veilwork.operators.budgets import Limits, admit_requests, settle_usage
from veilwork.operators.replies import (
    SchemaRules,
    enforce_schema,
    enforce_with_retry,
    explode_replies,
)
from veilwork.rules import ScrubRules
from veilwork.session import as_long, checkpointed


@dataclass(frozen=True)
class GuardOptions:
    """All stages' options."""

    pii: ScrubRules = field(default_factory=ScrubRules)
    schema: SchemaRules = field(default_factory=SchemaRules)
    budget: Limits = field(default_factory=Limits)

    @classmethod
    def from_dict(cls, options: dict) -> GuardOptions:
        return cls(
            ScrubRules.from_dict(options.get("pii", {})),
            SchemaRules.from_dict(options.get("schema", {})),
            Limits.from_dict(options.get("budget", {})),
        )


def guard_requests(requests: DataFrame, options: GuardOptions) -> DataFrame:
    """Estimate on the raw text, admit, then mask.

    Input: ``request_id, client_id, ts_us, messages, prompt``.  Adds
    ``estimated_tokens, decision, status, map, redactions`` and replaces the texts by their
    masked form; a rejected request keeps no text.  A request is its own masking
    session, so its map travels with it.  Texts are estimated once, and joined once
    with the verdict on them.
    """
    estimate = request_tokens(F.col("messages"), F.col("prompt"))
    has_prompt = F.coalesce(F.size("messages") > 0, F.lit(False)) | F.coalesce(F.size("prompt") > 0, F.lit(False))
    # admission works on ids and numbers
    sized = checkpointed(
        bound(requests, "estimated_tokens", estimate).select(
            "request_id", "client_id", "ts_us", "estimated_tokens", has_prompt.alias("has_prompt")
        )
    )
    # requests without a prompt aren't checked; an empty text in a list is one
    asked = sized.where("has_prompt")
    judged = requests.join(as_long(_verdicts(sized, asked, options.budget)), "request_id")
    ok = F.col("decision") == "ok"
    masked = judged.withColumns(
        {
            "_chat": F.when(ok, mask_messages(F.col("messages"), options.pii)),
            "_text": F.when(
                ok & F.col("messages").isNull(), mask_prompts(F.col("prompt"), options.pii)
            ),
        }
    )
    prompt = F.when(ok & F.col("_chat").isNotNull(), F.col("prompt")).otherwise(
        F.col("_text.prompts")
    )
    return masked.withColumns(
        {
            "messages": F.col("_chat.messages"),
            "prompt": prompt,
            "map": F.coalesce(F.col("_chat.map"), F.col("_text.map")),
            "redactions": F.coalesce(F.col("_chat.counts"), F.col("_text.counts")),
        }
    ).drop("_chat", "_text")


def _verdicts(sized: DataFrame, asked: DataFrame, budget: Limits) -> DataFrame:
    """``request_id, estimated_tokens, decision, status`` of every request, of which ``asked`` are checked."""
    rejected = (
        admit_requests(asked, budget, tokens="estimated_tokens")
        .where(F.col("decision") != "ok")
        .select("request_id", "decision", "status")
    )
    return (
        sized.select("request_id", "estimated_tokens")
        .join(as_long(rejected), "request_id", "left")
        .select(
            "request_id",
            "estimated_tokens",
            F.coalesce("decision", F.lit("ok")).alias("decision"),
            F.coalesce("status", F.lit(200)).alias("status"),
        )
    )


def guard_bodies(requests: DataFrame, options: GuardOptions, body: str = "body") -> DataFrame:
    """:func:`guard_requests` over request bodies held as JSON text, which keep all their keys.

    Input: ``request_id, client_id, ts_us`` and the body. Adds ``estimated_tokens`` (every string field of a message
    counts), ``decision, status, map, redactions`` and replaces the body by its masked form; keys come out sorted. A rejected
    request keeps no body; what isn't JSON isn't checked and stays as it is. A body is estimated once and
    joined once with the verdict on it.
    """
    tree = F.try_parse_json(F.col(body))
    has_prompt = F.coalesce(F.size(list_of(node(tree, "messages"))) > 0, F.lit(False)) | F.coalesce(
        F.size(list_of(node(tree, "prompt"))) > 0, F.length(text_of(node(tree, "prompt"))) > 0, F.lit(False)
    )
    sized = checkpointed(
        requests.select(
            "request_id", "client_id", "ts_us", has_prompt.alias("has_prompt"), body_tokens(tree).alias("estimated_tokens")
        )
    )
    judged = _verdicts(sized, sized.where("has_prompt"), options.budget)
    ok = F.col("decision") == "ok"
    trees = requests.join(as_long(judged), "request_id").withColumn("_tree", F.when(ok, tree))
    return (
        bound(trees, "_masked", F.when(F.col("_tree").isNotNull(), mask_body(F.col("_tree"), options.pii)))
        .withColumns(
            {
                body: F.when(ok, F.coalesce(F.to_json("_masked.body"), F.col(body))),
                "map": F.col("_masked.map"),
                "redactions": F.col("_masked.counts"),
            }
        )
        .drop("_tree", "_masked")
    )


def guard_replies(
    guarded: DataFrame,
    replies: DataFrame,
    options: GuardOptions,
    retries: DataFrame | None = None,
) -> DataFrame:
    """Per choice: enforce the schema, **then** restore masked values.

    ``guarded`` is the output of :func:`guard_requests`, ``replies`` has
    ``request_id, choices``; ``retries`` has ``request_id, choice,
    retry_content``.  Returns ``request_id, choice, status, was_repaired,
    errors, content``; failed choices have no content.
    """
    admitted = guarded.where(F.col("decision") == "ok").select("request_id", "map")
    # replies of rejected requests aren't enforced
    asked = replies.join(as_long(admitted.select("request_id")), "request_id", "left_semi")
    choices = explode_replies(asked, ["request_id"])
    if retries is not None and options.schema.active and options.schema.retries:
        enforced = enforce_with_retry(
            choices, retries, ["request_id", "choice"], options.schema
        ).select("request_id", "choice", "status", "was_repaired", "errors", "json")
    else:
        enforced = (
            enforce_schema(choices, options.schema, out="_e")
            .select(
                "request_id",
                "choice",
                F.col("_e.status").alias("status"),
                F.col("_e.was_repaired").alias("was_repaired"),
                F.col("_e.errors").alias("errors"),
                F.col("_e.json").alias("json"),
            )
        )
    joined = enforced.join(as_long(admitted), "request_id")
    content = F.col("json")
    if options.pii.reversible:
        content = restore_with(F.col("json"), F.col("map"))
    return joined.select(
        "request_id", "choice", "status", "was_repaired", "errors", content.alias("content")
    )


def settle(guarded: DataFrame, replies: DataFrame, enforced: DataFrame) -> DataFrame:
    """Settled tokens of admitted requests whose every choice passed."""
    bad = enforced.where(F.col("status").isin("parse_failed", "schema_failed")).select("request_id").distinct()
    usage = replies.select("request_id", F.col("usage.total_tokens").alias("total_tokens"))
    good = guarded.where(F.col("decision") == "ok").join(as_long(bad), "request_id", "left_anti")
    return settle_usage(good, usage, estimate="estimated_tokens")


def outcome_log(guarded: DataFrame, replies: DataFrame, enforced: DataFrame) -> DataFrame:
    """One outcome per request that came in, for :mod:`veilwork.operators.telemetry`.

    ``guarded`` and ``enforced`` are what the two plans return; ``replies`` has ``request_id, usage`` and optionally ``duration_ms``, one
    row per request that was answered. A rejected request is blocked; one without a reply, or with a choice that doesn't pass, has
    failed, the latter with a violation. Returns ``request_id, client_id, ts_us, outcome, prompt_tokens, completion_tokens,
    estimated_tokens, repaired, violation, duration_ms, redactions``.
    """
    usage = replies.schema["usage"].dataType.fieldNames()
    reported = {c: F.col(f"usage.{c}") if c in usage else F.lit(None) for c in ("prompt_tokens", "completion_tokens")}
    took = F.col("duration_ms") if "duration_ms" in replies.columns else F.lit(None)
    answered = replies.select(
        "request_id", *[v.cast("bigint").alias(c) for c, v in reported.items()], took.cast("double").alias("duration_ms"), F.lit(True).alias("_answered")
    )
    choices = enforced.groupBy("request_id").agg(
        F.max("was_repaired").alias("repaired"), F.max(F.col("status").isin("parse_failed", "schema_failed")).alias("violation")
    )
    known = guarded.select("request_id", "client_id", "ts_us", "decision", "estimated_tokens", "redactions")
    joined = known.join(as_long(answered), "request_id", "left").join(as_long(choices), "request_id", "left")
    no = F.lit(False)
    return joined.select(
        "request_id",
        "client_id",
        "ts_us",
        F.when(F.col("decision") != "ok", "blocked")
        .when(F.col("_answered") & ~F.coalesce("violation", no), "success")
        .otherwise("failed")
        .alias("outcome"),
        "prompt_tokens",
        "completion_tokens",
        "estimated_tokens",
        F.coalesce("repaired", no).alias("repaired"),
        F.coalesce("violation", no).alias("violation"),
        "duration_ms",
        "redactions",
    )
