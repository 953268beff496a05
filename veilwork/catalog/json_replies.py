"""Queries over replies: JSON repair, schema checks, retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.catalog.base import query, query_over, spread, sql_text, table
from veilwork.functions import jsonfix
from veilwork.functions.jsonschema import validate_json
from veilwork.functions.let import bound
from veilwork.functions.jsonreason import parse_reason
from veilwork.operators import replies

# Replies made from events by one expression for both sides, eight kinds of them:
# clean, fenced, in prose, Python style, trailing commas, comments, cut off, no JSON.
Q, NL, TICK = "chr(34)", "chr(10)", "chr(96) || chr(96) || chr(96)"
_ID, _TYPE = "CAST(event_id AS STRING)", "event_type"
_N = "CAST(CAST(floor(value) AS BIGINT) AS STRING)"
OBJ = (
    f"'{{\"id\": ' || {_ID} || ', \"type\": \"' || {_TYPE} || '\", \"n\": ' || {_N} || "
    "', \"flag\": true, \"url\": \"http://x.io/*a*/b//c\", \"tags\": [\"a, ]\", \"b\"]}'"
)
PYTHONIC = (
    "replace(replace('{~id~: ' || " + _ID + " || ', ~type~: ~' || " + _TYPE + " || '~, ~n~: ' || "
    + _N + " || ', ~flag~: True, ~url~: ~http:/x \"q\"~, ~none~: None, ~tags~: [~a~, ~False~]}', "
    "'~', chr(39)), 'http:/x', 'http:/' || 'x')"
)
COMMAS = (
    f"'{{\"id\": ' || {_ID} || ' , \"type\": \"' || {_TYPE} || '\", \"n\": ' || {_N} || "
    "', \"flag\": true, \"tags\": [\"a, ]\", \"b\" , ], }'"
)
COMMENTS = (
    f"'// head' || {NL} || '{{\"id\": ' || {_ID} || ', /* in, line */ \"type\": \"' || {_TYPE} || "
    f"'\", // rest' || {NL} || ' \"n\": ' || {_N} || ', \"flag\": true, \"tags\": [\"//\", \"/*b*/\"]}}'"
)
CUT = (
    f"'{{\"id\": ' || {_ID} || ', \"type\": \"' || {_TYPE} || '\", \"n\": ' || {_N} || "
    "', \"flag\": true, \"tags\": [\"a\", \"b cut'"
)
REPLY = (
    f"CASE event_id % 8 WHEN 0 THEN {OBJ} "
    f"WHEN 1 THEN 'Here it is:' || {NL} || {TICK} || 'json' || {NL} || {OBJ} || {NL} || {TICK} || {NL} || 'Bye [1]' "
    f"WHEN 2 THEN 'Sure: ' || {OBJ} || '. Hope it helps.' "
    f"WHEN 3 THEN {PYTHONIC} WHEN 4 THEN {COMMAS} WHEN 5 THEN {COMMENTS} WHEN 6 THEN {CUT} "
    "ELSE 'I cannot answer ' || event_type END"
)
REPLIES = f"SELECT event_id, event_type, value, {REPLY} AS content FROM events"


def reply_table(spark, sf_dir):
    return query_over(spread(table(spark, sf_dir, "events")), "events", REPLIES)


# the oracle's spelling of the shared token; its matcher never backtracks
S = r'"(?:[^"\\]|\\[\s\S])*(?:"|\\?\z)'
SINGLE = r"'(?:[^'\\]|\\[\s\S])*(?:'|\\?\z)"


def each_piece(text: str, pattern: str, expression: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, {sql_text(pattern)}, 0), "
        f"lambda p: {expression}), '')"
    )


SQL_EXTRACT = (
    "trim(CASE WHEN regexp_matches(content, '(?i)```(?:json)?\\s*\\n?([\\s\\S]*?)\\n?```') "
    "THEN regexp_extract(content, '(?i)```(?:json)?\\s*\\n?([\\s\\S]*?)\\n?```', 1) "
    "WHEN NOT regexp_matches(content, '[{\\[]') THEN content "
    "WHEN regexp_extract(content, '[{\\[]', 0) = '{' THEN "
    "CASE WHEN regexp_matches(content, '\\{[\\s\\S]*\\}') THEN regexp_extract(content, '\\{[\\s\\S]*\\}', 0) "
    "ELSE substring(content, instr(content, '{')) END "
    "ELSE CASE WHEN regexp_matches(content, '\\[[\\s\\S]*\\]') THEN regexp_extract(content, '\\[[\\s\\S]*\\]', 0) "
    "ELSE substring(content, instr(content, '[')) END END, ' ' || chr(10))"
)
SQL_COMMENTS = (
    f"regexp_replace(content, {sql_text('(' + S + ')|//[^\\r\\n]*|/\\*[\\s\\S]*?(?:\\*/|\\z)')}, "
    "'\\1', 'g')"
)
SQL_LITERALS = each_piece(
    "content",
    S + r'|\b(?:True|False|None)\b|[^"TFN]+|[TFN]',
    "CASE p WHEN 'True' THEN 'true' WHEN 'False' THEN 'false' WHEN 'None' THEN 'null' ELSE p END",
)
SQL_QUOTES = each_piece(
    "content",
    S + "|" + SINGLE + "|[^\"']+",
    "CASE WHEN starts_with(p, '''') AND length(p) > 1 AND ends_with(p, '''') THEN "
    "chr(34) || replace(p[2:-2], chr(34), chr(92) || chr(34)) || chr(34) "
    "WHEN starts_with(p, '''') THEN chr(34) || replace(p[2:], chr(34), chr(92) || chr(34)) ELSE p END",
)
SQL_COMMAS = (
    f"regexp_replace(content, {sql_text('(' + S + r')|,(\s*[}\]])')}, '\\1\\2', 'g')"
)
_MARKS = f"regexp_extract_all(regexp_replace(content, {sql_text(S)}, '', 'g'), '[\\[\\]{{}}]', 0)"
SQL_CLOSE = (
    "regexp_replace(rtrim(content), '\\s*,$', '') || CASE WHEN contains(regexp_replace(content, "
    + sql_text(r'"(?:[^"\\]|\\[\s\S])*"')
    + ", '', 'g'), chr(34)) THEN chr(34) ELSE '' END || list_reduce("
    + _MARKS
    + ", lambda st, c: CASE WHEN c = '{' THEN '}' || st WHEN c = '[' THEN ']' || st "
    "WHEN left(st, 1) = c THEN substring(st, 2) ELSE st END, '')"
)


def _pass(name, fn, sql):
    @query(f"SELECT event_id, {sql} AS fixed FROM ({REPLIES})", name)
    def run(spark, sf_dir):
        return reply_table(spark, sf_dir).select("event_id", fn(F.col("content")).alias("fixed"))


_pass("extract_json", jsonfix.extract_json_block, SQL_EXTRACT)
_pass("strip_comments", jsonfix.strip_json_comments, SQL_COMMENTS)
_pass("fix_literals", jsonfix.fix_python_literals, SQL_LITERALS)
_pass("fix_quotes", jsonfix.fix_single_quotes, SQL_QUOTES)
_pass("fix_commas", jsonfix.fix_trailing_commas, SQL_COMMAS)
_pass("close_structures", jsonfix.close_structures, SQL_CLOSE)

TIER = "CASE event_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 7 THEN NULL ELSE 2 END::INT"
# What any repaired reply must still say, read from the events themselves.  Literals
# are fixed before quotes, so 'False' in single quotes comes out in lower case.
FIELDS = f"""SELECT event_id, CASE WHEN event_id % 8 < 7 THEN event_id END AS id,
  CASE WHEN event_id % 8 < 7 THEN event_type END AS type,
  CASE WHEN event_id % 8 < 7 THEN CAST(floor(value) AS BIGINT) END AS n,
  CASE WHEN event_id % 8 < 7 THEN true END AS flag,
  CASE event_id % 8 WHEN 3 THEN 'false' WHEN 5 THEN '/*b*/' WHEN 6 THEN 'b cut' WHEN 7 THEN NULL ELSE 'b' END AS last_tag,
  {TIER} AS tier FROM events"""


def reply_fields(value):
    def field(path, kind):
        return F.try_variant_get(value, path, kind)

    return [
        field("$.id", "bigint").alias("id"),
        field("$.type", "string").alias("type"),
        field("$.n", "bigint").alias("n"),
        field("$.flag", "boolean").alias("flag"),
        field("$.tags[1]", "string").alias("last_tag"),
    ]


@query(FIELDS)
def parse_or_repair(spark, sf_dir):
    parsed = bound(reply_table(spark, sf_dir), "p", jsonfix.parse_or_repair(F.col("content")))
    return parsed.select("event_id", *reply_fields(F.col("p.value")), F.col("p.tier").alias("tier"))


@query(f"SELECT {TIER} AS tier, count(*) AS n FROM events GROUP BY ALL")
def repair_tiers(spark, sf_dir):
    parsed = reply_table(spark, sf_dir).select(
        jsonfix.parse_or_repair(F.col("content"))["tier"].alias("tier")
    )
    return parsed.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT event_id, 'k=' || json_extract_string(props, '$.k') AS repaired FROM events"
)
def repair_props(spark, sf_dir):
    # strict JSON passes through the whole chain of repairs unharmed
    fixed = table(spark, sf_dir, "events").select(
        "event_id", jsonfix.repair_json(F.col("props")).alias("j")
    )
    return fixed.select(
        "event_id",
        F.concat(F.lit("k="), F.get_json_object("j", "$.k")).alias("repaired"),
    )


# ------------------------------------------------------------------------ schema

PROPS_SCHEMA = {
    "type": "object",
    "required": ["k", "z"],
    "additionalProperties": False,
    "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}},
}


def error_rows(df, keys, errors):
    return (
        df.select(*keys, F.explode_outer(errors).alias("e"))
        .where(F.col("e").isNotNull())
        .select(*keys, "e.path", "e.rule", "e.message")
    )


@query(
    """WITH p AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, 'root.z' AS path, 'required' AS rule, 'root.z: required field is missing' AS message FROM p
UNION ALL SELECT event_id, 'root.k', 'minimum', 'root.k: number ' || k || ' is less than minimum 10' FROM p WHERE k < 10
UNION ALL SELECT event_id, 'root.k', 'maximum', 'root.k: number ' || k || ' is greater than maximum 90' FROM p WHERE k > 90"""
)
def validate_props(spark, sf_dir):
    props = table(spark, sf_dir, "events").select(
        "event_id", jsonfix.parse_strict(F.col("props")).alias("v")
    )
    return error_rows(props, ["event_id"], validate_json(F.col("v"), PROPS_SCHEMA))


PART = (
    "'{\"key\": ' || CASE WHEN p_partkey % 7 = 1 THEN '\"' || CAST(p_partkey AS STRING) || '\"' "
    "WHEN p_partkey % 7 = 2 THEN 'null' ELSE CAST(p_partkey AS STRING) END || ', \"name\": \"' || p_name "
    "|| '\", \"brand\": \"' || p_brand || '\", \"type\": ' || CASE WHEN p_partkey % 7 = 3 THEN '17' ELSE '\"' || p_type || '\"' END "
    "|| CASE WHEN p_partkey % 7 = 4 THEN '' ELSE ', \"size\": ' || CAST(p_size AS STRING) || '.5' END "
    "|| CASE WHEN p_partkey % 7 = 5 THEN ', \"extra\": [1]' ELSE '' END "
    "|| ', \"items\": [{\"q\": ' || CAST(p_size AS STRING) || '}, {\"q\": \"' || CAST(p_size AS STRING) || '\"}'"
    "|| CASE WHEN p_partkey % 7 = 6 THEN ', {}, 5' ELSE '' END || ']}'"
)
PARTS = f"SELECT p_partkey, p_name, p_brand, p_type, p_size, {PART} AS content FROM part"
PART_SCHEMA = {
    "type": "object",
    "required": ["key", "size"],
    "additionalProperties": False,
    "properties": {
        "key": {"type": ["integer", "null"]},
        "name": {"type": "string", "minLength": 10, "maxLength": 12},
        "brand": {"type": "string", "pattern": r"^Brand#\d$"},
        "type": {"enum": ["ECONOMY", "STANDARD", 18]},
        "size": {"type": "number", "minimum": 5, "maximum": 40.5},
        "items": {
            "type": "array",
            "minItems": 3,
            "maxItems": 3,
            "items": {
                "type": "object",
                "required": ["q"],
                "properties": {"q": {"type": "integer", "maximum": 30}},
            },
        },
    },
}
PART_ERRORS = """
SELECT p_partkey, 'root.key' AS path, 'type' AS rule FROM p WHERE p_partkey % 7 = 1
UNION ALL SELECT p_partkey, 'root.size', 'required' FROM p WHERE p_partkey % 7 = 4
UNION ALL SELECT p_partkey, 'root.extra', 'additionalProperties' FROM p WHERE p_partkey % 7 = 5
UNION ALL SELECT p_partkey, 'root.name', 'minLength' FROM p WHERE length(p_name) < 10
UNION ALL SELECT p_partkey, 'root.name', 'maxLength' FROM p WHERE length(p_name) > 12
UNION ALL SELECT p_partkey, 'root.brand', 'pattern' FROM p WHERE length(p_brand) <> 7
UNION ALL SELECT p_partkey, 'root.type', 'enum' FROM p WHERE p_partkey % 7 = 3 OR p_type NOT IN ('ECONOMY', 'STANDARD')
UNION ALL SELECT p_partkey, 'root.size', 'minimum' FROM p WHERE p_partkey % 7 <> 4 AND p_size + 0.5 < 5
UNION ALL SELECT p_partkey, 'root.size', 'maximum' FROM p WHERE p_partkey % 7 <> 4 AND p_size + 0.5 > 40.5
UNION ALL SELECT p_partkey, 'root.items', 'minItems' FROM p WHERE p_partkey % 7 <> 6
UNION ALL SELECT p_partkey, 'root.items', 'maxItems' FROM p WHERE p_partkey % 7 = 6
UNION ALL SELECT p_partkey, 'root.items[0].q', 'maximum' FROM p WHERE p_size > 30
UNION ALL SELECT p_partkey, 'root.items[1].q', 'type' FROM p
UNION ALL SELECT p_partkey, 'root.items[2].q', 'required' FROM p WHERE p_partkey % 7 = 6
UNION ALL SELECT p_partkey, 'root.items[3]', 'type' FROM p WHERE p_partkey % 7 = 6"""


def part_replies(spark, sf_dir):
    return query_over(table(spark, sf_dir, "part"), "part", PARTS)


@query(f"WITH p AS ({PARTS}){PART_ERRORS}")
def validate_nested(spark, sf_dir):
    parsed = part_replies(spark, sf_dir).select(
        "p_partkey", jsonfix.parse_strict(F.col("content")).alias("v")
    )
    errors = error_rows(parsed, ["p_partkey"], validate_json(F.col("v"), PART_SCHEMA))
    return errors.drop("message")


REPLY_SCHEMA = {
    "type": "object",
    "required": ["id", "type", "tags"],
    "properties": {
        "id": {"type": "integer"},
        "type": {"type": "string", "enum": ["view", "click", "purchase", "signup"]},
        "n": {"type": "integer", "maximum": 150},
    },
}
RULES = replies.SchemaRules(schema=REPLY_SCHEMA)
N_ERRORS = "(event_type = 'error')::BIGINT + (floor(value) > 150)::BIGINT"
STATUS = (
    f"CASE WHEN event_id % 8 = 7 THEN 'parse_failed' WHEN {N_ERRORS} > 0 THEN 'schema_failed' "
    "WHEN event_id % 8 = 0 THEN 'ok' ELSE 'repaired' END"
)


@query(
    f"""SELECT event_id, {STATUS} AS status, {STATUS} = 'repaired' AS was_repaired,
  CASE {STATUS} WHEN 'parse_failed' THEN 1 WHEN 'schema_failed' THEN {N_ERRORS} ELSE 0 END::INT AS n_errors,
  CASE WHEN {STATUS} IN ('ok', 'repaired') THEN event_id END AS id FROM events"""
)
def enforce_outcomes(spark, sf_dir):
    done = replies.enforce_schema(reply_table(spark, sf_dir), RULES)
    return done.select(
        "event_id",
        F.col("enforced.status").alias("status"),
        F.col("enforced.was_repaired").alias("was_repaired"),
        F.size("enforced.errors").alias("n_errors"),
        F.get_json_object("enforced.json", "$.id").cast("bigint").alias("id"),
    )


_E1 = (
    "'root.type: value ''' || event_type || ''' is not in allowed enum "
    "[''view'', ''click'', ''purchase'', ''signup'']'"
)
_E2 = "'root.n: number ' || CAST(floor(value) AS BIGINT) || ' is greater than maximum 150'"
NO_JSON = "Expecting value: line 1 column 1 (char 0)"  # of plain words
_LISTED = (
    f"CASE WHEN event_id % 8 = 7 THEN '- {NO_JSON}' ELSE concat_ws(chr(10), "
    f"CASE WHEN event_type = 'error' THEN '- ' || {_E1} END, "
    f"CASE WHEN floor(value) > 150 THEN '- ' || {_E2} END) END"
)


@query(
    f"""SELECT event_id, CASE WHEN event_id % 8 = 7 THEN '{replies.PARSE_FAILED}: {NO_JSON}'
    ELSE {sql_text(replies.SCHEMA_FAILED)} END AS message, 'schema_validation_failed' AS code,
  {_LISTED.replace("'- '", "''").replace("'- ", "'")} AS details, content AS raw_content
FROM ({REPLIES}) WHERE {STATUS} IN ('parse_failed', 'schema_failed')"""
)
def schema_error_bodies(spark, sf_dir):
    done = replies.enforce_schema(reply_table(spark, sf_dir), RULES)
    body = replies.error_body(F.col("enforced"), F.col("content"))
    return (
        done.where(replies.failed(F.col("enforced")))
        .select("event_id", body.alias("b"))
        .select(
            "event_id",
            "b.message",
            "b.code",
            F.array_join("b.details", "\n").alias("details"),
            "b.raw_content",
        )
    )


@query(
    f"""SELECT event_id, content AS assistant, {sql_text(replies.PROMPT_HEAD)} || content
  || {sql_text(replies.PROMPT_ERRORS)} || {_LISTED} || {sql_text(replies.PROMPT_TAIL)} AS ask,
  CASE WHEN event_id % 2 = 0 THEN 3 END::INT AS n_messages
FROM ({REPLIES}) WHERE {STATUS} IN ('parse_failed', 'schema_failed')"""
)
def repair_requests(spark, sf_dir):
    # every second request was a chat, the others legacy prompts
    source = reply_table(spark, sf_dir)
    chat = F.col("event_id") % 2 == 0
    requests = source.select(
        "event_id",
        F.when(
            chat,
            F.array(
                F.struct(F.lit("user").alias("role"), F.col("event_type").alias("content"),
                         F.lit(None).alias("parts"))
            ),
        ).cast(f"array<{replies.MESSAGE_TYPE}>").alias("messages"),
        F.when(~chat, F.array("event_type")).alias("prompt"),
    )
    done = replies.enforce_schema(source, RULES)
    asked = replies.repair_requests(done, requests, ["event_id"])
    legacy = F.split(F.get(F.col("prompt"), F.lit(0)), "\n\nYou produced", 2)
    return asked.select(
        "event_id",
        F.coalesce(F.get(F.col("messages"), F.lit(1))["content"], F.get(legacy, F.lit(0))).alias(
            "assistant"
        ),
        F.coalesce(
            F.get(F.col("messages"), F.lit(2))["content"],
            F.concat(F.lit("You produced"), F.get(legacy, F.lit(1))),
        ).alias("ask"),
        F.when(F.size("messages") > 0, F.size("messages")).alias("n_messages"),
    )


RETRY = (
    "CASE event_id % 3 WHEN 0 THEN '{\"id\": 1, \"type\": \"view\", \"tags\": []}' "
    "WHEN 1 THEN '{\"id\": \"x\"}' ELSE 'still no' END"
)
HAS_RETRY = "event_id % 5 <> 0"


@query(
    f"""WITH f AS (SELECT event_id, {STATUS} AS first, {N_ERRORS} AS n, {HAS_RETRY} AS again FROM events)
SELECT event_id,
  CASE WHEN first IN ('ok', 'repaired') OR NOT again THEN first
    WHEN event_id % 3 = 0 THEN 'repaired' WHEN event_id % 3 = 1 THEN 'schema_failed' ELSE 'parse_failed' END AS status,
  CASE WHEN first IN ('ok', 'repaired') THEN 0
    WHEN NOT again THEN CASE WHEN first = 'parse_failed' THEN 1 ELSE n END
    WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 3
    ELSE 1 + CASE WHEN first = 'parse_failed' THEN 1 ELSE n END END::INT AS n_errors
FROM f"""
)
def retry_join(spark, sf_dir):
    source = reply_table(spark, sf_dir)
    retries = source.where(F.expr(HAS_RETRY)).select(
        "event_id", F.expr(RETRY).alias("retry_content")
    )
    done = replies.enforce_with_retry(source, retries, ["event_id"], RULES)
    return done.select("event_id", "status", F.size("errors").alias("n_errors"))


@query(
    f"""WITH f AS (SELECT event_id, content, {STATUS} AS first, {N_ERRORS} AS n, {HAS_RETRY} AS again, {RETRY} AS retried
  FROM ({REPLIES}))
SELECT event_id, 'schema_validation_error' AS type,
  CASE WHEN again AND event_id % 3 = 1 THEN {sql_text(replies.RETRY_SCHEMA_FAILED)} WHEN again THEN '{replies.RETRY_FAILED}: {NO_JSON}'
    WHEN first = 'parse_failed' THEN '{replies.PARSE_FAILED}: {NO_JSON}' ELSE {sql_text(replies.SCHEMA_FAILED)} END AS message,
  CASE WHEN again AND event_id % 3 = 1 THEN 3 ELSE CASE WHEN first = 'parse_failed' THEN 1 ELSE n END
    + CASE WHEN again THEN 1 ELSE 0 END END::INT AS n_details,
  CASE WHEN again AND event_id % 3 = 1 THEN retried ELSE content END AS raw_content
FROM f WHERE first NOT IN ('ok', 'repaired') AND NOT (again AND event_id % 3 = 0)"""
)
def retry_error_bodies(spark, sf_dir):
    """What is reported of replies that failed, whether or not they had a second attempt."""
    source = reply_table(spark, sf_dir)
    retries = source.where(F.expr(HAS_RETRY)).select("event_id", F.expr(RETRY).alias("retry_content"))
    done = replies.enforce_with_retry(source, retries, ["event_id"], RULES)
    body = done.select("event_id", replies.retry_error_body(done).alias("b")).where("b IS NOT NULL")
    return body.select("event_id", "b.type", "b.message", F.size("b.details").alias("n_details"), "b.raw_content")


@query(
    """SELECT event_id, choice::INT AS choice, kind, content FROM (
  SELECT event_id, 0 AS choice, 'message' AS kind, event_type AS content FROM events
  UNION ALL SELECT event_id, 1, 'text', 't' || user_id FROM events
  UNION ALL SELECT event_id, 3, 'message', event_type FROM events) ORDER BY 1, 2"""
)
def explode_replies(spark, sf_dir):
    def choice(role, content, text):
        message = F.struct(F.lit("assistant").alias("role"), content.alias("content"))
        return F.struct(
            F.when(F.lit(role), message).alias("message"), text.cast("string").alias("text")
        )

    none = F.lit(None).cast("string")
    kind = F.col("event_type")
    made = table(spark, sf_dir, "events").select(
        "event_id",
        F.array(
            choice(True, kind, none),
            choice(False, none, F.concat(F.lit("t"), F.col("user_id"))),
            choice(True, none, F.lit("ignored")),
            choice(True, kind, F.lit("ignored")),
        ).alias("choices"),
    )
    return replies.explode_replies(made, ["event_id"])


# Replies that no repair makes JSON, each wrong at a place that follows from its number.
WRONG = (
    f"CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN ' ' || {NL} "
    f"WHEN 2 THEN 'well, ' || {_TYPE} "
    f"WHEN 3 THEN '{{\"id\": ' || {_ID} || ' \"n\": 1}}' "
    f"WHEN 4 THEN '{{\"id\" ' || {_ID} || '}}' "
    f"WHEN 5 THEN '[' || {_ID} || ',' || {NL} || ' @]' "
    f"WHEN 6 THEN 'See {{' || {_ID} || ': 1}}' "
    f"ELSE '[\"' || {_TYPE} || '\"] and then [2]' END"
)


@query(
    f"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Empty or whitespace-only JSON input' WHEN 1 THEN 'Empty or whitespace-only JSON input'
  WHEN 2 THEN '{NO_JSON}'
  WHEN 3 THEN 'Expecting '','' delimiter: line 1 column ' || (9 + n) || ' (char ' || (8 + n) || ')'
  WHEN 4 THEN 'Expecting '':'' delimiter: line 1 column 7 (char 6)'
  WHEN 5 THEN 'Expecting value: line 2 column 2 (char ' || (4 + n) || ')'
  WHEN 6 THEN 'Expecting property name enclosed in double quotes: line 1 column 2 (char 1)'
  ELSE 'Extra data: line 1 column ' || (t + 6) || ' (char ' || (t + 5) || ')' END AS reason
FROM (SELECT event_id, length({_ID}) AS n, length({_TYPE}) AS t FROM events)"""
)
def parse_reasons(spark, sf_dir):
    """Why a reply isn't JSON, and where."""
    wrong = query_over(spread(table(spark, sf_dir, "events")), "events", f"SELECT event_id, {WRONG} AS content FROM events")
    return wrong.select("event_id", parse_reason(F.col("content")).alias("reason"))
