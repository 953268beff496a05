"""Reply tables: walk the choices, enforce JSON and schema, retry, build repair requests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.jsonfix import parse_or_repair
from veilwork.functions.jsonschema import ERRORS_TYPE, validate_json
from veilwork.functions.let import bound, let
from veilwork.functions.jsonreason import parse_reason
from veilwork.functions.masking import MESSAGE_TYPE
from veilwork.session import as_long, checkpointed

# --- fixed values: error texts and the repair prompt ---
PARSE_FAILED = "Failed to parse or repair JSON"
SCHEMA_FAILED = "JSON does not conform to the required schema"
RETRY_SCHEMA_FAILED = "Schema validation failed after upstream repair retry"
RETRY_FAILED = "Upstream repair retry failed"
ERROR_TYPE = "schema_validation_error"
ERROR_CODE = "schema_validation_failed"
PROMPT_HEAD = (
    "You produced the following JSON output which is invalid or does not match "
    "the required schema:\n```json\n"
)
PROMPT_ERRORS = "\n```\n\nValidation errors:\n"
PROMPT_TAIL = (
    "\n\nPlease fix and output ONLY the corrected, valid JSON. Do not include explanation."
)
# --- end of fixed values ---


@dataclass(frozen=True)
class SchemaRules:
    """When replies are held to JSON, and to which schema."""

    enabled: bool = False
    strict_json: bool = False
    on_failure: str = "retry"
    max_repair_retries: int = 1
    schema: Mapping[str, Any] | None = None

    @classmethod
    def from_dict(cls, options: Mapping[str, Any]) -> SchemaRules:
        known = ("enabled", "strict_json", "on_failure", "max_repair_retries", "schema")
        rules = cls(**{k: options[k] for k in known if k in options})
        if rules.on_failure not in ("retry", "error"):
            raise ValueError(f"on_failure must be 'retry' or 'error', not {rules.on_failure!r}")
        return rules

    @property
    def active(self) -> bool:
        return self.enabled or self.strict_json or bool(self.schema)

    @property
    def retries(self) -> bool:
        return self.on_failure == "retry" and self.max_repair_retries > 0


def explode_replies(df: DataFrame, keys: Sequence[str], choices: str = "choices") -> DataFrame:
    """One row per choice: ``keys``, ``choice``, ``kind`` and its text ``content``.

    A choice with a message yields the message's content, any other its ``text``;
    choices without text are left out.
    """
    each = df.select(*keys, F.posexplode(choices).alias("choice", "c"))
    is_message = F.col("c.message").isNotNull()
    return each.select(
        *keys,
        "choice",
        F.when(is_message, "message").otherwise("text").alias("kind"),
        F.when(is_message, F.col("c.message.content")).otherwise(F.col("c.text")).alias("content"),
    ).where(F.col("content").isNotNull())


def _no_errors() -> Column:
    return F.array().cast(ERRORS_TYPE)


def enforce_content(content: Column, rules: SchemaRules) -> Column:
    """Struct ``status, was_repaired, errors, value, json`` for one reply text.

    ``status`` is ok, repaired, parse_failed or schema_failed (or inactive).
    """

    def result(status, repaired, errors, value, text) -> Column:
        return F.struct(
            (F.lit(status) if isinstance(status, str) else status).alias("status"),
            repaired.alias("was_repaired"),
            errors.cast(ERRORS_TYPE).alias("errors"),
            value.cast("variant").alias("value"),
            text.cast("string").alias("json"),
        )

    if not rules.active:
        return result("inactive", F.lit(False), _no_errors(), F.lit(None), content)

    def parse_error(reason: Column) -> Column:
        return F.array(
            F.struct(
                F.lit("root").alias("path"),
                F.lit("parse").alias("rule"),
                F.lit(None).alias("expected"),
                F.lit(None).alias("actual"),
                reason.alias("message"),
            )
        )

    def parsed(p: Column) -> Column:
        value, repaired = p["value"], p["tier"] > 0

        def judged(errors: Column) -> Column:
            good = result(
                F.when(repaired, "repaired").otherwise("ok"),
                repaired,
                _no_errors(),
                value,
                F.to_json(value),
            )
            bad = result("schema_failed", F.lit(False), errors, value, F.lit(None))
            return F.when(F.size(errors) == 0, good).otherwise(bad)

        checked = validate_json(value, rules.schema) if rules.schema else _no_errors()
        # only what failed is scanned for the reason
        reason = F.coalesce(parse_reason(content), F.lit(PARSE_FAILED))
        failed = result("parse_failed", F.lit(False), parse_error(reason), F.lit(None), F.lit(None))
        return F.when(p["tier"].isNull(), failed).otherwise(let(checked, judged))

    return let(parse_or_repair(content), parsed)


def enforce_schema(
    df: DataFrame, rules: SchemaRules, content: str = "content", out: str = "enforced"
) -> DataFrame:
    """Add the outcome of enforcing JSON and schema on a reply column."""
    return bound(df, out, enforce_content(F.col(content), rules))


def failed(enforced: Column) -> Column:
    return enforced["status"].isin("parse_failed", "schema_failed")


def error_body(enforced: Column, content: Column) -> Column:
    """The error report of a failed row as a struct; null otherwise."""
    return F.when(
        failed(enforced),
        F.struct(
            failure_text(enforced).alias("message"),
            F.lit(ERROR_TYPE).alias("type"),
            F.lit(ERROR_CODE).alias("code"),
            F.transform(enforced["errors"], lambda e: e["message"]).alias("details"),
            content.alias("raw_content"),
        ),
    )


def enforce_with_retry(
    replies: DataFrame,
    retries: DataFrame,
    keys: Sequence[str],
    rules: SchemaRules,
    content: str = "content",
    retry_content: str = "retry_content",
) -> DataFrame:
    """Enforce, then give each failed row its one second attempt from ``retries``.

    Adds ``status, was_repaired, errors, json, raw_content, message``.  A retry
    that passes counts as repaired; one that fails the schema reports its own
    errors; one that isn't JSON reports both.  ``message`` says what failed last.
    Only failed rows meet the retries; all others pass without a shuffle.
    """
    first = enforce_schema(replies, rules, content, "_first")
    plain_message = failure_text(F.col("_first"))
    if not rules.retries or not rules.active:
        return _flat(first, F.col("_first"), F.col(content), plain_message).drop("_first")
    first = checkpointed(first)  # enforced once, read for the rows that passed and those that failed
    passed = first.where(~failed(F.col("_first")))
    again = F.when(F.col(retry_content).isNotNull(), enforce_content(F.col(retry_content), rules))
    both = (
        first.where(failed(F.col("_first")))
        .join(as_long(retries.select(*keys, retry_content)), list(keys), "left")
        .withColumn("_again", again)
    )
    one, two = F.col("_first"), F.col("_again")
    # a retry that isn't JSON keeps the first error and adds its own
    joint = F.concat(one["errors"], two["errors"])
    outcome = F.when(two.isNull(), F.struct(one["status"].alias("status"),
                                            one["was_repaired"].alias("was_repaired"),
                                            one["errors"].alias("errors"),
                                            one["json"].alias("json"))).otherwise(
        F.struct(
            F.when(failed(two), two["status"]).otherwise("repaired").alias("status"),
            (~failed(two)).alias("was_repaired"),
            F.when(two["status"] == "parse_failed", joint).otherwise(two["errors"]).alias("errors"),
            two["json"].alias("json"),
        )
    )
    raw = F.when(two["status"] == "schema_failed", F.col(retry_content)).otherwise(F.col(content))
    message = (
        F.when(two.isNull(), plain_message)
        .when(two["status"] == "schema_failed", RETRY_SCHEMA_FAILED)
        .when(
            two["status"] == "parse_failed",
            F.concat(F.lit(f"{RETRY_FAILED}: "), F.get(two["errors"], F.lit(0))["message"]),
        )
    )
    tried = _flat(both.withColumn("_done", outcome), F.col("_done"), raw, message).drop(
        "_first", "_again", "_done"
    )
    untried = _flat(passed, F.col("_first"), F.col(content), plain_message).drop("_first")
    return untried.unionByName(tried, allowMissingColumns=True)


def failure_text(enforced: Column) -> Column:
    """What a first attempt failed at; null if it passed."""
    reason = F.get(enforced["errors"], F.lit(0))["message"]
    return F.when(enforced["status"] == "parse_failed", F.concat(F.lit(f"{PARSE_FAILED}: "), reason)).when(
        enforced["status"] == "schema_failed", SCHEMA_FAILED
    )


def retry_error_body(row: DataFrame) -> Column:
    """The error report of a row of :func:`enforce_with_retry`; null if it passed."""
    return F.when(
        row["message"].isNotNull(),
        F.struct(
            row["message"].alias("message"),
            F.lit(ERROR_TYPE).alias("type"),
            F.lit(ERROR_CODE).alias("code"),
            F.transform(row["errors"], lambda e: e["message"]).alias("details"),
            row["raw_content"].alias("raw_content"),
        ),
    )


def _flat(df: DataFrame, outcome: Column, raw: Column, message: Column) -> DataFrame:
    return (
        df.withColumn("status", outcome["status"])
        .withColumn("was_repaired", outcome["was_repaired"])
        .withColumn("errors", outcome["errors"])
        .withColumn("json", outcome["json"])
        .withColumn("raw_content", raw)
        .withColumn("message", message)
    )


def repair_prompt(content: Column, errors: Column) -> Column:
    """The user turn that asks for a corrected reply."""
    listed = F.array_join(
        F.transform(errors, lambda e: F.concat(F.lit("- "), e["message"])), "\n"
    )
    return F.concat(
        F.lit(PROMPT_HEAD), content, F.lit(PROMPT_ERRORS), listed, F.lit(PROMPT_TAIL)
    )


def repair_requests(
    enforced: DataFrame,
    requests: DataFrame,
    keys: Sequence[str],
    content: str = "content",
    out: str = "enforced",
) -> DataFrame:
    """Follow-up requests for failed rows, on top of the **masked** ``messages``/``prompt``."""
    bad = enforced.where(failed(F.col(out))).select(*keys, content, out)
    ask = repair_prompt(F.col(content), F.col(out)["errors"])

    def turn(role: str, text: Column) -> Column:
        return F.struct(
            F.lit(role).alias("role"), text.alias("content"), F.lit(None).alias("parts")
        )

    follow_up = F.array(turn("assistant", F.col(content)), turn("user", ask)).cast(
        f"array<{MESSAGE_TYPE}>"
    )
    legacy = F.array(F.concat(F.col(content), F.lit("\n\n"), ask))
    has_messages = F.size("messages") > 0
    return bad.join(as_long(requests.select(*keys, "messages", "prompt")), list(keys)).select(
        *keys,
        F.when(has_messages, F.concat("messages", follow_up)).alias("messages"),
        F.when(~F.coalesce(has_messages, F.lit(False)), legacy).alias("prompt"),
    )
