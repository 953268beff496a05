"""Queries over request logs: budgets, settlement, client keys, telemetry, event lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.catalog.base import query, query_over, spread, table, ts_us
from veilwork.catalog.texts import tokens_sql
from veilwork.functions import tokens
from veilwork.operators import budgets, settlement, telemetry
from veilwork.sources import requests as request_source
from veilwork.sources import sse

DAY = 86_400
LIMITS = budgets.Limits(
    max_tokens_per_request=250,
    max_requests_per_minute=5,
    max_tokens_per_minute=300,
    sliding_window_seconds=3 * DAY,
)
TOKENS = "CAST(floor(value) AS BIGINT)"


def event_log(spark, sf_dir):
    """events as a request log: client = user, tokens = whole part of value."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("client_id"),
        ts_us().alias("ts_us"),
        F.expr(TOKENS).alias("tokens"),
    )


LOG_SQL = (
    "SELECT event_id AS request_id, user_id AS client_id, epoch_us(ts) AS ts_us, "
    f"{TOKENS} AS tokens FROM events"
)


def admission_sql(limits: budgets.Limits, source: str = LOG_SQL) -> str:
    window = limits.sliding_window_seconds * 1_000_000
    return f"""WITH RECURSIVE log AS ({source}),
asked AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY ts_us, request_id) AS rn
  FROM log WHERE tokens <= {limits.max_tokens_per_request}),
walk AS (
  SELECT DISTINCT client_id, 0::BIGINT AS rn, []::STRUCT(t BIGINT, k BIGINT)[] AS kept,
    NULL::BIGINT AS request_id, NULL::BIGINT AS ts_us, NULL::BIGINT AS tokens, '' AS decision,
    NULL::BIGINT AS n, NULL::BIGINT AS used
  FROM asked
  UNION ALL
  SELECT client_id, rn, CASE WHEN decision = 'ok' THEN list_append(kept, {{'t': ts_us, 'k': tokens}})
    ELSE kept END, request_id, ts_us, tokens, decision, n, used
  FROM (SELECT *, CASE WHEN n >= {limits.max_requests_per_minute} THEN 'requests'
      WHEN used + tokens > {limits.max_tokens_per_minute} THEN 'tokens' ELSE 'ok' END AS decision
    FROM (SELECT client_id, rn, kept, request_id, ts_us, tokens, len(kept)::BIGINT AS n,
        coalesce(list_sum(list_transform(kept, lambda x: x.k)), 0)::BIGINT AS used
      FROM (SELECT a.client_id, a.rn, a.request_id, a.ts_us, a.tokens,
          list_filter(w.kept, lambda x: x.t >= a.ts_us - {window}) AS kept
        FROM walk w JOIN asked a ON a.client_id = w.client_id AND a.rn = w.rn + 1)))
),
decided AS (
  SELECT request_id, client_id, ts_us, tokens, decision, n, used FROM walk WHERE rn > 0
  UNION ALL
  SELECT request_id, client_id, ts_us, tokens, 'oversize', NULL, NULL FROM log
  WHERE tokens > {limits.max_tokens_per_request}
)"""


STATUS_SQL = (
    "CASE decision WHEN 'ok' THEN 200 WHEN 'oversize' THEN 400 "
    f"ELSE {LIMITS.reject_status_code} END"
)


@query(
    admission_sql(LIMITS)
    + f" SELECT request_id, client_id, ts_us, tokens, decision, {STATUS_SQL}::INT AS status FROM decided"
)
def admit_events(spark, sf_dir):
    return budgets.admit_requests(event_log(spark, sf_dir), LIMITS).select(
        "request_id", "client_id", "ts_us", "tokens", "decision", "status"
    )


@query(
    admission_sql(LIMITS)
    + f" SELECT request_id, client_id, ts_us, tokens, decision, {STATUS_SQL}::INT AS status FROM decided"
)
def admit_in_parts(spark, sf_dir):
    """The same with runs cut into parts, each going on from what the one before left."""
    return budgets.admit_requests(event_log(spark, sf_dir), LIMITS, rows_per_task=25).select(
        "request_id", "client_id", "ts_us", "tokens", "decision", "status"
    )


ORDER_LIMITS = budgets.Limits(
    max_tokens_per_request=450_000,
    max_requests_per_minute=3,
    max_tokens_per_minute=600_000,
    sliding_window_seconds=60 * DAY,
    reject_status_code=402,
)
ORDERS_SQL = (
    "SELECT o_orderkey AS request_id, o_custkey AS client_id, epoch_us(o_orderdate) AS ts_us, "
    "CAST(floor(o_totalprice) AS BIGINT) AS tokens FROM orders"
)


@query(
    admission_sql(ORDER_LIMITS, ORDERS_SQL)
    + " SELECT decision, CASE decision WHEN 'ok' THEN 200 WHEN 'oversize' THEN 400 ELSE 402 END::INT "
    "AS status, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM decided GROUP BY ALL"
)
def admit_orders(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("client_id"),
        ts_us("o_orderdate").alias("ts_us"),
        F.expr("CAST(floor(o_totalprice) AS BIGINT)").alias("tokens"),
    )
    return (
        budgets.admit_requests(log, ORDER_LIMITS)
        .groupBy("decision", "status")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    )


# The same log with replies that take hours or none at all, and cost more than was estimated.
SETTLED_US = "ts_us + (request_id % 9) * 5400000000"
FAILED = "request_id % 13 = 5"


def settled_sql(limits: budgets.Limits) -> str:
    """Arrivals one by one; what was admitted is kept with the time from which it counts."""
    window = limits.sliding_window_seconds * 1_000_000
    return f"""WITH RECURSIVE log AS (SELECT *, CASE WHEN NOT {FAILED} THEN {SETTLED_US} END AS settled_us, tokens + request_id % 50 AS recorded
  FROM ({LOG_SQL})),
asked AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY ts_us, request_id) AS rn
  FROM log WHERE tokens <= {limits.max_tokens_per_request}),
walk AS (
  SELECT DISTINCT client_id, 0::BIGINT AS rn, []::STRUCT(t BIGINT, k BIGINT)[] AS kept,
    NULL::BIGINT AS request_id, NULL::BIGINT AS ts_us, NULL::BIGINT AS tokens, '' AS decision, NULL::BIGINT AS n, NULL::BIGINT AS used
  FROM asked
  UNION ALL
  SELECT client_id, rn, CASE WHEN decision = 'ok' AND settled_us IS NOT NULL
    THEN list_append(kept, {{'t': settled_us, 'k': recorded}}) ELSE kept END, request_id, ts_us, tokens, decision, n, used
  FROM (SELECT *, CASE WHEN n >= {limits.max_requests_per_minute} THEN 'requests'
      WHEN used + tokens > {limits.max_tokens_per_minute} THEN 'tokens' ELSE 'ok' END AS decision
    FROM (SELECT client_id, rn, kept, request_id, ts_us, tokens, settled_us, recorded,
        len(list_filter(kept, lambda x: x.t <= ts_us))::BIGINT AS n,
        coalesce(list_sum(list_transform(list_filter(kept, lambda x: x.t <= ts_us), lambda x: x.k)), 0)::BIGINT AS used
      FROM (SELECT a.client_id, a.rn, a.request_id, a.ts_us, a.tokens, a.settled_us, a.recorded,
          list_filter(w.kept, lambda x: x.t >= a.ts_us - {window}) AS kept
        FROM walk w JOIN asked a ON a.client_id = w.client_id AND a.rn = w.rn + 1)))
),
decided AS (
  SELECT request_id, client_id, ts_us, tokens, decision, n, used FROM walk WHERE rn > 0
  UNION ALL
  SELECT request_id, client_id, ts_us, tokens, 'oversize', NULL, NULL FROM log WHERE tokens > {limits.max_tokens_per_request}
)
SELECT request_id, client_id, ts_us, tokens, decision, {STATUS_SQL}::INT AS status FROM decided"""


def _settled(spark, sf_dir, rows_per_task=budgets.ROWS_PER_TASK):
    log = event_log(spark, sf_dir).withColumns(
        {"settled_us": F.expr(f"CASE WHEN NOT {FAILED} THEN {SETTLED_US} END"), "recorded": F.expr("tokens + request_id % 50")}
    )
    return settlement.admit_settled(log, LIMITS, recorded="recorded", rows_per_task=rows_per_task).select(
        "request_id", "client_id", "ts_us", "tokens", "decision", "status"
    )


@query(settled_sql(LIMITS))
def admit_settled(spark, sf_dir):
    """Requests count from when their replies are settled."""
    return _settled(spark, sf_dir)


@query(settled_sql(LIMITS))
def admit_settled_in_parts(spark, sf_dir):
    """The same in parts, which hand on what is pending."""
    return _settled(spark, sf_dir, 25)


@query(
    admission_sql(LIMITS)
    + f"""
SELECT request_id,
  CASE decision
    WHEN 'oversize' THEN 'Estimated prompt tokens (' || tokens || ') exceeds max allowed per request ({LIMITS.max_tokens_per_request}).'
    WHEN 'requests' THEN 'Request rate limit exceeded. Max {LIMITS.max_requests_per_minute} requests per {LIMITS.sliding_window_seconds}s.'
    ELSE 'Token rate limit exceeded. Projected ' || (used + tokens) || ' tokens exceeds limit of {LIMITS.max_tokens_per_minute} per {LIMITS.sliding_window_seconds}s.'
  END AS message,
  CASE WHEN decision = 'oversize' THEN 'budget_exhausted_error' ELSE 'rate_limit_error' END AS type,
  CASE WHEN decision = 'oversize' THEN 'insufficient_quota' ELSE 'token_budget_exceeded' END AS code,
  CASE WHEN decision <> 'requests' THEN tokens END AS estimated_tokens,
  CASE WHEN decision = 'requests' THEN n END AS current_requests,
  CASE WHEN decision = 'tokens' THEN used END AS current_tokens,
  CASE WHEN decision = 'oversize' THEN {LIMITS.max_tokens_per_request}::BIGINT END AS max_tokens_per_request,
  CASE decision WHEN 'requests' THEN {LIMITS.max_requests_per_minute}::BIGINT
    WHEN 'tokens' THEN {LIMITS.max_tokens_per_minute}::BIGINT END AS "limit",
  CASE WHEN decision <> 'oversize' THEN {LIMITS.sliding_window_seconds} END AS window_seconds
FROM decided WHERE decision <> 'ok'"""
)
def rejection_details(spark, sf_dir):
    decided = budgets.admit_requests(event_log(spark, sf_dir), LIMITS).where("decision <> 'ok'")
    detail = budgets.rejection_detail(
        *[F.col(c) for c in ("decision", "tokens", "current_requests", "current_tokens")], LIMITS
    )
    return decided.select("request_id", detail.alias("e")).select(
        "request_id",
        "e.message",
        "e.type",
        "e.code",
        "e.details.*",
    )


@query(
    admission_sql(LIMITS)
    + f" SELECT {STATUS_SQL}::INT AS status, count(*) AS n FROM decided GROUP BY ALL"
)
def rejections_by_code(spark, sf_dir):
    return (
        budgets.admit_requests(event_log(spark, sf_dir), LIMITS)
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    f"""WITH log AS ({LOG_SQL})
SELECT request_id, client_id, ts_us,
  count(*) OVER w AS window_requests, sum(tokens) OVER w::BIGINT AS window_tokens,
  count(*) OVER l AS lifetime_requests, sum(tokens) OVER l::BIGINT AS lifetime_tokens
FROM log
WINDOW w AS (PARTITION BY client_id ORDER BY ts_us RANGE BETWEEN {DAY * 1_000_000}::BIGINT PRECEDING AND CURRENT ROW),
  l AS (PARTITION BY client_id ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""".replace(
        "OVER w::BIGINT", "OVER w"
    )
    .replace("OVER l::BIGINT", "OVER l")
    .replace("sum(tokens) OVER w AS", "CAST(sum(tokens) OVER w AS BIGINT) AS")
    .replace("sum(tokens) OVER l AS", "CAST(sum(tokens) OVER l AS BIGINT) AS")
)
def window_usage(spark, sf_dir):
    return budgets.window_usage(event_log(spark, sf_dir), DAY)


NOW_US = 1_705_276_800_000_000  # 2024-01-15 00:00 UTC


@query(
    f"""WITH log AS ({LOG_SQL})
SELECT client_id, count(*) FILTER (ts_us >= {NOW_US - DAY * 1_000_000}) AS window_requests,
  coalesce(sum(tokens) FILTER (ts_us >= {NOW_US - DAY * 1_000_000}), 0)::BIGINT AS window_tokens,
  count(*) AS lifetime_requests, sum(tokens)::BIGINT AS lifetime_tokens
FROM log WHERE ts_us <= {NOW_US} GROUP BY client_id"""
)
def usage_at_instant(spark, sf_dir):
    return budgets.usage_at(event_log(spark, sf_dir), NOW_US, DAY)


@query(
    f"SELECT client_id, count(*) AS lifetime_requests, sum(tokens)::BIGINT AS lifetime_tokens "
    f"FROM ({LOG_SQL}) GROUP BY client_id"
)
def client_totals(spark, sf_dir):
    return budgets.client_totals(event_log(spark, sf_dir))


# orders that carry the event's number answer it; cancelled ones report no usage
REPLIES_SQL = (
    "SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus <> 'F' "
    "THEN CAST(floor(o_totalprice / 1000) AS BIGINT) END AS total_tokens FROM orders"
)


@query(
    f"""SELECT q.request_id, q.client_id,
  CASE WHEN p.total_tokens IS NOT NULL THEN p.total_tokens ELSE q.tokens END AS settled_tokens
FROM ({LOG_SQL}) q JOIN ({REPLIES_SQL}) p ON p.request_id = q.request_id
WHERE p.total_tokens IS NOT NULL OR q.tokens > 0"""
)
def settle_usage(spark, sf_dir):
    replies = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.when(
            F.col("o_orderstatus") != "F", F.expr("CAST(floor(o_totalprice / 1000) AS BIGINT)")
        ).alias("total_tokens"),
    )
    return budgets.settle_usage(event_log(spark, sf_dir), replies).select(
        "request_id", "client_id", "settled_tokens"
    )


HEADERS = (
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Bearer tok' || CAST(user_id AS STRING) "
    "WHEN 1 THEN '' WHEN 2 THEN 'Bearer ' WHEN 3 THEN ' Basic x ' END AS auth, "
    "CASE event_id % 3 WHEN 0 THEN 'c' || CAST(user_id AS STRING) WHEN 1 THEN '' END AS x_client_id, "
    "CASE event_id % 4 WHEN 0 THEN '10.0.0.' || CAST(user_id AS STRING) WHEN 1 THEN '' END AS host "
    "FROM events"
)


@query(
    f"""SELECT event_id, CASE WHEN x_client_id <> '' THEN x_client_id
  WHEN auth <> '' THEN trim(replace(auth, 'Bearer ', ''))
  WHEN host <> '' THEN host ELSE 'anonymous_client' END AS client_id FROM ({HEADERS})"""
)
def client_key(spark, sf_dir):
    headers = query_over(table(spark, sf_dir, "events"), "events", HEADERS)
    key = request_source.client_key(F.col("auth"), F.col("x_client_id"), F.col("host"))
    return headers.select("event_id", key.alias("client_id"))


# --------------------------------------------------------------------- telemetry

OUTCOMES = (
    "SELECT event_id, ts, value AS duration_ms, CASE event_type WHEN 'error' THEN 'failed' "
    "WHEN 'signup' THEN 'blocked' ELSE 'success' END AS outcome, "
    "CASE WHEN event_id % 3 = 0 THEN event_id % 100 END AS prompt_tokens, "
    f"{TOKENS} AS estimated_tokens, "
    "CASE WHEN event_id % 4 <> 1 THEN event_id % 40 END AS completion_tokens, "
    "event_id % 7 = 0 AS repaired, event_id % 11 = 0 AS violation FROM events"
)


def outcome_log(spark, sf_dir):
    return query_over(table(spark, sf_dir, "events"), "events", OUTCOMES)


COUNTS_SQL = (
    "count(*) AS total, count(*) FILTER (outcome = 'success') AS successful, "
    "count(*) FILTER (outcome <> 'success') AS failed, "
    "count(*) FILTER (outcome = 'blocked') AS blocked_rate_limit"
)
SCHEMA_SQL = (
    "count(*) FILTER (repaired) AS schema_repairs, count(*) FILTER (violation) AS schema_violations"
)
_SUM = "coalesce(sum({}) FILTER (outcome = 'success'), 0)::BIGINT"
_PROMPT, _COMPLETION = (
    "coalesce(prompt_tokens, estimated_tokens, 0)",
    "coalesce(completion_tokens, 0)",
)
TOKENS_SQL = (
    f"{_SUM.format(_PROMPT)} AS prompt_total, {_SUM.format(_COMPLETION)} AS completion_total, "
    f"{_SUM.format(_PROMPT + ' + ' + _COMPLETION)} AS overall_total"
)
LATENCY_SQL = f"""(SELECT list_sort(list(duration_ms)) AS v, count(*) AS n, avg(duration_ms) AS a FROM
  (SELECT duration_ms FROM ({OUTCOMES}) WHERE outcome = 'success' ORDER BY ts DESC, event_id DESC LIMIT 1000))"""
LATENCY_COLUMNS = (
    "n AS latency_count, round(coalesce(a, 0), 2) AS latency_average, "
    + ", ".join(
        f"coalesce(round(v[CAST(floor(n * {p}) AS BIGINT) + 1], 2), 0.0) AS latency_{name}"
        for name, p in telemetry.PERCENTILES.items()
    )
)


@query(f"SELECT {COUNTS_SQL} FROM ({OUTCOMES})")
def outcome_counts(spark, sf_dir):
    return outcome_log(spark, sf_dir).agg(*telemetry.request_counts())


@query(f"SELECT {SCHEMA_SQL} FROM ({OUTCOMES})")
def schema_totals(spark, sf_dir):
    return outcome_log(spark, sf_dir).agg(*telemetry.schema_totals())


@query(f"SELECT {TOKENS_SQL} FROM ({OUTCOMES})")
def token_totals(spark, sf_dir):
    return outcome_log(spark, sf_dir).agg(*telemetry.token_totals())


@query(f"SELECT {LATENCY_COLUMNS} FROM {LATENCY_SQL}")
def latency_last_1000(spark, sf_dir):
    return telemetry.latency_stats(outcome_log(spark, sf_dir), ["ts", "event_id"])


@query(
    f"SELECT c.*, {LATENCY_COLUMNS} FROM (SELECT {COUNTS_SQL}, {SCHEMA_SQL}, {TOKENS_SQL} "
    f"FROM ({OUTCOMES})) c, {LATENCY_SQL}"
)
def metrics_summary(spark, sf_dir):
    return telemetry.metrics_summary(outcome_log(spark, sf_dir), ["ts", "event_id"])


@query(
    f"SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS window_start_us, {COUNTS_SQL}, "
    f"{SCHEMA_SQL}, {TOKENS_SQL} FROM ({OUTCOMES}) GROUP BY 1"
)
def tumbling_metrics(spark, sf_dir):
    return (
        outcome_log(spark, sf_dir)
        .groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"))
        .agg(*telemetry.request_counts(), *telemetry.schema_totals(), *telemetry.token_totals())
        .withColumn("window_start_us", F.unix_micros("window.start"))
        .drop("window")
    )


# ------------------------------------------------------------------ event streams

# Each document as a streamed reply: blank and comment lines, pieces of 17
# characters, a legacy text piece, broken data, the end mark.  Pieces hold no
# quotes or backslashes, so that the same concatenation is JSON on both sides.
PIECE = 17
LINES = (
    "SELECT doc_id AS stream_id, CAST(seq AS BIGINT) AS seq, CASE "
    "WHEN seq = 0 THEN '' WHEN seq = 1 THEN ': keep-alive' "
    "WHEN seq = 2 THEN 'data: {\"choices\": [{\"text\": \"legacy\"}]}' "
    "WHEN seq = 3 THEN 'data: {\"choices\": []}' WHEN seq = 4 THEN 'data: {broken' "
    "WHEN seq = n + 5 THEN 'data: [DONE]' "
    "ELSE 'data:  {\"choices\": [{\"index\": 0, \"delta\": {\"content\": \"' "
    f"|| substring(clean, CAST((seq - 5) * {PIECE} + 1 AS INT), {PIECE}) || '\"}}}}]}} ' END AS line FROM "
)
CLEAN = (
    "translate(translate(text, chr(34) || chr(92), ''), chr(10) || chr(9) || chr(13), '   ')"
)
COUNT = f"CAST(ceil(length({CLEAN}) / {PIECE}.0) AS INT)"
LINES_SQL = (
    LINES
    + f"(SELECT doc_id, clean, n, unnest(range(0, n + 6)) AS seq FROM "
    f"(SELECT doc_id, {CLEAN} AS clean, {COUNT} AS n FROM documents))"
)
# the same lines, cut by one matcher run per text
LINES_SPARK = (
    "SELECT doc_id AS stream_id, CAST(seq AS BIGINT) AS seq, line FROM (SELECT doc_id, posexplode(concat("
    "array('', ': keep-alive', 'data: {\"choices\": [{\"text\": \"legacy\"}]}', "
    "'data: {\"choices\": []}', 'data: {broken'), transform("
    f"regexp_extract_all({CLEAN}, '(?s).{{1,{PIECE}}}', 0), "
    "p -> 'data:  {\"choices\": [{\"index\": 0, \"delta\": {\"content\": \"' || p || '\"}}]} '), "
    "array('data: [DONE]'))) AS (seq, line) FROM documents)"
)


def sse_lines(spark, sf_dir):
    return query_over(spread(table(spark, sf_dir, "documents")), "documents", LINES_SPARK)


PARSED_SQL = f"""SELECT stream_id, seq,
  CASE WHEN line = '' THEN 'blank' WHEN NOT starts_with(line, 'data:') THEN 'other'
    WHEN line = 'data: [DONE]' THEN 'done' WHEN line LIKE '%"delta"%' THEN 'piece'
    WHEN line LIKE '%"text"%' THEN 'text' WHEN json_valid(substring(line, 6)) THEN 'data'
    ELSE 'broken' END AS kind,
  CASE WHEN line LIKE '%"delta"%' THEN json_extract_string(substring(line, 6), '$.choices[0].delta.content')
    WHEN line LIKE '%"text"%' THEN json_extract_string(substring(line, 6), '$.choices[0].text') END AS piece,
  line = 'data: [DONE]' AS is_done
FROM ({LINES_SQL})"""


@query(PARSED_SQL)
def parse_sse(spark, sf_dir):
    return sse.parse_sse_lines(sse_lines(spark, sf_dir)).select(
        "stream_id", "seq", "kind", "piece", "is_done"
    )


@query(
    f"SELECT stream_id, count(*) FILTER (kind = 'piece') AS n_chunks FROM ({PARSED_SQL}) "
    "GROUP BY stream_id"
)
def completion_chunks(spark, sf_dir):
    return sse.completion_chunks(sse.parse_sse_lines(sse_lines(spark, sf_dir)))


# Request bodies: messages with text or parts, empty messages with a prompt, prompt
# lists, strings that look like lists, prompts that are messages, other fields.
BODIES = (
    "SELECT event_id, user_id, props_text, CASE "
    "WHEN event_id % 28 = 6 THEN '{\"prompt\": \"[' || chr(92) || '\"' || props_text || chr(92) || '\"]\"}' "
    "WHEN event_id % 28 = 8 THEN '{\"model\": \"m1\", \"stream\": true, \"seed\": 7, \"messages\": [{\"role\": \"user\", \"name\": \"' || props_text || '\", \"content\": \"[1]\"}]}' "
    "WHEN event_id % 28 = 11 THEN '{\"model\": \"m3\", \"prompt\": [{\"role\": \"user\", \"content\": \"' || props_text || '\"}]}' "
    "ELSE CASE event_id % 4 "    "WHEN 0 THEN '{\"model\": \"m1\", \"stream\": true, \"messages\": [{\"role\": \"user\", \"content\": \"' || props_text || '\"}]}' "
    "WHEN 1 THEN '{\"model\": \"m2\", \"messages\": [{\"role\": \"user\", \"content\": [{\"type\": \"text\", \"text\": \"' || props_text || '\"}, {\"type\": \"image_url\", \"image_url\": {\"url\": \"http://x\"}}]}]}' "
    "WHEN 2 THEN '{\"messages\": [], \"prompt\": \"' || props_text || '\"}' "
    "ELSE '{\"model\": \"m3\", \"prompt\": [\"' || props_text || '\", \"second\"]}' END END AS body FROM "
    "(SELECT event_id, user_id, event_type || ' ' || CAST(user_id AS STRING) AS props_text FROM events)"
)


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' WHEN 3 THEN 'm3' ELSE '' END AS model,
  event_id % 4 = 0 AS stream, event_id % 4 < 3 AND event_id % 28 <> 6 AS is_chat, true AS has_prompt,
  CASE WHEN event_id % 28 = 8 THEN '[1]' WHEN event_id % 4 = 0 THEN event_type || ' ' || user_id END AS content,
  CASE WHEN event_id % 4 = 1 THEN event_type || ' ' || user_id END AS part_text,
  CASE WHEN event_id % 4 = 1 THEN 'http://x' END AS image_url,
  CASE WHEN event_id % 28 = 6 THEN '["' || event_type || ' ' || user_id || '"]'
    WHEN event_id % 4 >= 2 THEN event_type || ' ' || user_id END AS first_prompt,
  CASE WHEN event_id % 4 = 2 OR event_id % 28 = 11 THEN 1 WHEN event_id % 4 = 3 THEN 2 END::INT AS n_prompts FROM events"""
)
def read_requests(spark, sf_dir):
    read = request_source.read_request_lines(query_over(table(spark, sf_dir, "events"), "events", BODIES))
    message = F.get(F.col("messages"), F.lit(0))
    return read.select(
        "event_id",
        "model",
        "stream",
        "is_chat",
        "has_prompt",
        message["content"].alias("content"),
        F.get(message["parts"], F.lit(0))["text"].alias("part_text"),
        F.get(message["parts"], F.lit(1))["image_url"].alias("image_url"),
        F.get(F.col("prompt"), F.lit(0)).alias("first_prompt"),
        F.when(F.size("prompt") > 0, F.size("prompt")).alias("n_prompts"),
    )


_SECOND = tokens_sql("'second'")
_ONE = tokens_sql("t")
_USER = tokens_sql("'user'")


@query(
    f"""SELECT event_id, (CASE WHEN event_id % 28 = 6 THEN {tokens_sql("'[' || chr(34) || t || chr(34) || ']'")}
  WHEN event_id % 28 = 8 THEN 6 + {_USER} + {_ONE} + {tokens_sql("'[1]'")}
  WHEN event_id % 28 = 11 OR event_id % 4 < 2 THEN 6 + {_USER} + {_ONE}
  WHEN event_id % 4 = 2 THEN {_ONE} ELSE {_ONE} + {_SECOND} END)::BIGINT AS estimated_tokens
FROM (SELECT event_id, event_type || ' ' || user_id AS t FROM events)"""
)
def body_tokens(spark, sf_dir):
    bodies = query_over(table(spark, sf_dir, "events"), "events", BODIES)
    return bodies.select("event_id", tokens.body_tokens(F.try_parse_json("body")).alias("estimated_tokens"))
