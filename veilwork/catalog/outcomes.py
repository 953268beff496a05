"""Queries over the outcome log that the two plans leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.catalog.base import query
from veilwork.catalog.flows import DONE_SQL, GUARD, chat_requests, guarded_replies
from veilwork.catalog.texts import ALL, SEEDED_SQL, session_ctes
from veilwork.catalog.traffic import COUNTS_SQL, SCHEMA_SQL, TOKENS_SQL
from veilwork.operators import telemetry
from veilwork.plans import guard
from veilwork.session import checkpointed

# Every eleventh request gets no reply; times and usage follow from the request's number.
ANSWERED = "request_id % 11 <> 10"
TIMES = "(request_id * 37 % 1000) / 4.0"
PROMPTED = "CASE WHEN request_id % 3 <> 0 THEN request_id % 90 END"
COMPLETED = "CASE WHEN request_id % 4 <> 1 THEN request_id % 40 END"


def plan_outcomes(spark, sf_dir):
    """The outcome log of the documents as requests and their replies."""
    guarded = checkpointed(
        guard.guard_requests(chat_requests(spark, sf_dir), GUARD).select(
            "request_id", "client_id", "ts_us", "estimated_tokens", "decision", "map", "redactions"
        )
    )
    _, replies, done = guarded_replies(spark, sf_dir, guarded)
    usage = F.struct(F.expr(PROMPTED).alias("prompt_tokens"), F.expr(COMPLETED).alias("completion_tokens"))
    answered = replies.where(ANSWERED).withColumns({"usage": usage, "duration_ms": F.expr(TIMES).cast("double")})
    return guard.outcome_log(guarded, answered, done.where(ANSWERED))


_HITS = session_ctes(ALL, SEEDED_SQL.replace("doc_id % 50 AS session_id", "doc_id AS session_id")).removeprefix("WITH ")
OUTCOMES_SQL = (
    DONE_SQL
    + f""",
{_HITS},
redacted AS (SELECT session_id AS request_id, count(*) AS n, count(*) FILTER (category = 'email') AS emails FROM numbered GROUP BY 1),
finished AS (SELECT d.request_id, d.client_id, d.ts_us, CASE WHEN d.decision <> 'ok' THEN 'blocked'
    WHEN d.request_id % 11 = 10 OR o.outcome IN ('parse_failed', 'schema_failed') THEN 'failed' ELSE 'success' END AS outcome,
  CASE WHEN {ANSWERED.replace("request_id", "d.request_id")} THEN {PROMPTED.replace("request_id", "d.request_id")} END AS prompt_tokens,
  CASE WHEN {ANSWERED.replace("request_id", "d.request_id")} THEN {COMPLETED.replace("request_id", "d.request_id")} END AS completion_tokens,
  d.tokens AS estimated_tokens, coalesce(d.request_id % 11 <> 10 AND o.outcome = 'repaired', false) AS repaired,
  coalesce(d.request_id % 11 <> 10 AND o.outcome IN ('parse_failed', 'schema_failed'), false) AS violation,
  CASE WHEN d.request_id % 11 <> 10 THEN ({TIMES.replace("request_id", "d.request_id")})::DOUBLE END AS duration_ms,
  CASE WHEN d.decision = 'ok' THEN r.n END AS n_redactions, CASE WHEN d.decision = 'ok' THEN r.emails END AS emails
  FROM decided d LEFT JOIN outcome o ON o.request_id = d.request_id LEFT JOIN redacted r ON r.request_id = d.request_id),
lasting AS (SELECT list_sort(list(duration_ms)) AS v, count(*) AS n, avg(duration_ms) AS a FROM
  (SELECT duration_ms FROM finished WHERE outcome = 'success' ORDER BY ts_us DESC, request_id DESC LIMIT 1000)),
per_category AS (SELECT category, count(*) AS n FROM numbered JOIN finished ON finished.request_id = session_id WHERE outcome <> 'blocked' GROUP BY category)"""
)


@query(OUTCOMES_SQL + " SELECT * FROM finished")
def outcomes(spark, sf_dir):
    counts = F.map_values("redactions")
    total = F.when(F.col("redactions").isNotNull(), F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, n: a + n))
    return (
        plan_outcomes(spark, sf_dir)
        .withColumn("n_redactions", total)
        .withColumn("emails", F.when(F.col("redactions").isNotNull(), F.coalesce(F.col("redactions")["email"], F.lit(0).cast("bigint"))))
        .drop("redactions")
    )


_AT = "coalesce(round(l.v[CAST(floor(l.n * {}) AS BIGINT) + 1], 2), 0.0)"
_NUMBERS = ", ".join(f"'{k}', {_AT.format(p)}" for k, p in telemetry.PERCENTILES.items())


@query(
    OUTCOMES_SQL
    + f""", c AS (SELECT {COUNTS_SQL}, {SCHEMA_SQL}, {TOKENS_SQL} FROM finished)
SELECT json_object('requests', json_object('total', total, 'successful', successful, 'failed', failed, 'blocked_rate_limit', blocked_rate_limit),
  'safeguards', json_object('pii_redactions_total', (SELECT sum(n)::BIGINT FROM per_category),
    'pii_redactions_by_type', (SELECT ('{{' || string_agg('"' || category || '":' || n, ',' ORDER BY category) || '}}')::JSON FROM per_category),
    'schema_repairs', schema_repairs, 'schema_violations', schema_violations),
  'tokens', json_object('prompt_total', prompt_total, 'completion_total', completion_total, 'overall_total', overall_total),
  'latency_ms', json_object('count', l.n, 'average', round(l.a, 2), {_NUMBERS}))::VARCHAR AS metrics
FROM c, lasting l"""
)
def metrics_json(spark, sf_dir):
    """The summary document of the outcome log, redactions included."""
    log = checkpointed(plan_outcomes(spark, sf_dir))
    return telemetry.summary_json(telemetry.metrics_summary(log, ["ts_us", "request_id"], telemetry.redaction_counts(log)))


@query(OUTCOMES_SQL + " SELECT category, sum(n)::BIGINT AS n_redactions FROM per_category GROUP BY ROLLUP (category)")
def redaction_totals(spark, sf_dir):
    """Values that the plans masked, per category and over all."""
    return telemetry.redaction_totals(telemetry.redaction_counts(plan_outcomes(spark, sf_dir)))
