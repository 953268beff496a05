"""Queries over texts: detection, masking, restoring, token estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.catalog.base import (
    SEEDED,
    luhn_sql,
    query,
    re2,
    seeded,
    spread,
    sql_text,
    table,
)
from veilwork.functions.let import bound
from veilwork.functions.masking import (
    find_hits,
    luhn_valid,
    mask_messages,
    mask_prompts,
    mask_text,
    scan_text,
)
from veilwork.functions.tokens import (
    count_tokens,
    estimate_tokens,
    message_tokens,
    prompts_tokens,
)
from veilwork.operators import budgets, detect, restore, sessions
from veilwork.rules import PRECEDENCE, Rule, PATTERNS, ScrubRules
from veilwork.session import checkpointed

ALL = ScrubRules()
CUSTOM = ScrubRules(
    patterns=("email", "ipv4"),
    custom_patterns={
        "desk": r"\buser\d+@corp\.io\b",
        "ticket": {"pattern": r"\bsk-0+\d+\b", "placeholder": "[ID_{idx}]"},
        "door": {"pattern": r"\bhost 10\.0\.\d+", "placeholder": "GATE"},
    },
)


def masking_ctes(source: str, rules: ScrubRules, keys: str) -> str:
    """CTEs s0..sN: the text masked rule by rule, numbered per row."""
    ctes = [f"s0 AS (SELECT {keys}, text AS t FROM ({source}))"]
    for k, rule in enumerate(rules.ordered, 1):
        pattern = sql_text(("(?i)" if rule.ignore_case else "") + rule.pattern)
        ok = luhn_sql("v") if rule.category == "credit_card" else "true"
        before, _, after = rule.template.partition("{idx}")
        mask = (
            f"CASE WHEN list_contains(d, m[i]) THEN {sql_text(before)} || "
            f"list_position(d, m[i]) || {sql_text(after)} ELSE m[i] END"
        )
        ctes.append(
            f"m{k} AS (SELECT *, regexp_extract_all(t, {pattern}, 0) AS m, "
            f"string_split_regex(t, {pattern}) AS s FROM s{k - 1})"
        )
        ctes.append(f"v{k} AS (SELECT *, list_filter(m, lambda v: {ok}) AS w FROM m{k})")
        ctes.append(
            f"d{k} AS (SELECT *, list_filter(w, lambda v, i: list_position(w, v) = i) AS d "
            f"FROM v{k})"
        )
        ctes.append(
            f"s{k} AS (SELECT {keys}, array_to_string(list_transform(s, lambda x, i: "
            f"x || coalesce({mask}, '')), '') AS t FROM d{k})"
        )
    return ",\n".join(ctes)


def masked_sql(source: str, rules: ScrubRules, keys: str) -> str:
    last = len(rules.ordered)
    return (
        f"WITH {masking_ctes(source, rules, keys)}\n"
        f"SELECT {keys}, t AS masked FROM s{last}"
    )


SEEDED_SQL = (
    f"SELECT doc_id, lang, doc_id % 50 AS session_id, doc_id AS turn, {SEEDED} AS text "
    "FROM documents"
)


def hits_sql(category: str) -> str:
    ok = luhn_sql("v") if category == "credit_card" else "true"
    return (
        f"WITH h AS (SELECT doc_id, list_filter(regexp_extract_all(text, {re2(category)}, 0), "
        f"lambda v: {ok}) AS h FROM ({SEEDED_SQL}))\n"
        "SELECT doc_id, unnest(range(1, len(h) + 1))::INT AS ordinal, unnest(h) AS value FROM h"
    )


def _detect(category: str):
    def run(spark, sf_dir):
        return detect.find_category(seeded(spark, sf_dir), category, ["doc_id"])

    return run


for _category in PRECEDENCE:
    query(hits_sql(_category), f"detect_{_category}")(_detect(_category))


@query(
    "SELECT doc_id, u.value AS value, "
    + luhn_sql("u.value")
    + " AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, "
    + re2("credit_card")
    + f", 0)) AS value FROM ({SEEDED_SQL})) u"
)
def luhn_cards(spark, sf_dir):
    # every card-like run, with the verdict of the check digit
    rule = Rule("card_like", PATTERNS["credit_card"])
    found = seeded(spark, sf_dir).select(
        "doc_id", F.explode_outer(find_hits(F.col("text"), rule)).alias("value")
    )
    return found.where(F.col("value").isNotNull()).select(
        "doc_id", "value", luhn_valid(F.col("value")).alias("valid")
    )


def entities_sql(source: str, rules: ScrubRules, keys: str) -> str:
    parts = []
    for k, rule in enumerate(rules.ordered, 1):
        parts.append(
            f"SELECT {keys}, {sql_text(rule.category)} AS category, "
            "unnest(range(1, len(w) + 1))::INT AS ordinal, unnest(w) AS value "
            f"FROM v{k}"
        )
    return f"WITH {masking_ctes(source, rules, keys)}\n" + "\nUNION ALL\n".join(parts)


@query(entities_sql(SEEDED_SQL, ALL, "doc_id"))
def detect_entities(spark, sf_dir):
    return detect.detect_entities(seeded(spark, sf_dir), ["doc_id"], rules=ALL)


@query(entities_sql(SEEDED_SQL, CUSTOM, "doc_id"))
def custom_rule_hits(spark, sf_dir):
    return detect.detect_entities(seeded(spark, sf_dir), ["doc_id"], rules=CUSTOM)


@query(masked_sql("SELECT doc_id, text FROM documents", ALL, "doc_id"))
def mask_documents(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", mask_text(F.col("text"), ALL).alias("masked"))


@query(masked_sql(SEEDED_SQL, ALL, "doc_id"))
def mask_seeded(spark, sf_dir):
    docs = seeded(spark, sf_dir).select("doc_id", "text")
    return docs.select("doc_id", mask_text(F.col("text"), ALL).alias("masked"))


@query(masked_sql(SEEDED_SQL, CUSTOM, "doc_id"))
def mask_custom(spark, sf_dir):
    docs = seeded(spark, sf_dir).select("doc_id", "text")
    return docs.select("doc_id", mask_text(F.col("text"), CUSTOM).alias("masked"))


@query(masked_sql("SELECT page_id, html AS text FROM pages", ALL, "page_id"))
def mask_pages_html(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", mask_text(F.col("html"), ALL).alias("masked"))


@query(
    masked_sql(
        "SELECT doc_id, text || chr(1) || substr(seeded, length(text) + 1) AS text "
        f"FROM (SELECT doc_id, text, {SEEDED} AS seeded FROM documents)",
        ALL,
        "doc_id",
    ).replace(
        "SELECT doc_id, t AS masked FROM",
        "SELECT doc_id, string_split(t, chr(1))[1] AS first_prompt, "
        "string_split(t, chr(1))[2] AS second_prompt FROM",
    ),
    "mask_prompts",
)
def _mask_prompts(spark, sf_dir):
    docs = spread(
        table(spark, sf_dir, "documents").select(
            "doc_id", "text", F.expr(SEEDED).alias("seeded")
        )
    )
    tail = F.substring(F.col("seeded"), F.length("text") + 1, F.length("seeded"))
    masked = docs.select("doc_id", mask_prompts(F.array("text", tail), ALL).alias("m"))
    return masked.select(
        "doc_id",
        F.get(F.col("m.prompts"), F.lit(0)).alias("first_prompt"),
        F.get(F.col("m.prompts"), F.lit(1)).alias("second_prompt"),
    )


@query(
    masked_sql(
        "SELECT doc_id, 'Be brief.' || chr(1) || text || chr(1) || 'Mail user1@corp.io' "
        f"|| chr(1) || seeded AS text FROM (SELECT doc_id, text, {SEEDED} AS seeded "
        "FROM documents)",
        ALL,
        "doc_id",
    ).replace(
        "SELECT doc_id, t AS masked FROM",
        "SELECT doc_id, 'system' AS role1, string_split(t, chr(1))[1] AS content1, "
        "string_split(t, chr(1))[2] AS part1, string_split(t, chr(1))[3] AS part3, "
        "'http://x.io/user1@corp.io' AS image2, string_split(t, chr(1))[4] AS content3 FROM",
    ),
    "mask_messages",
)
def _mask_messages(spark, sf_dir):
    docs = spread(
        table(spark, sf_dir, "documents").select(
            "doc_id", "text", F.expr(SEEDED).alias("seeded")
        )
    )
    none = F.lit(None).cast("string")

    def part(kind, text, image):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), image.alias("image_url"))

    def message(role, content, parts):
        return F.struct(F.lit(role).alias("role"), content.alias("content"), parts.alias("parts"))

    no_parts = F.array(part("text", none, none))
    no_parts = F.when(F.lit(False), no_parts)
    parts = F.array(
        part("text", F.col("text"), none),
        part("image_url", none, F.lit("http://x.io/user1@corp.io")),
        part("text", F.lit("Mail user1@corp.io"), none),
    )
    messages = F.array(
        message("system", F.lit("Be brief."), no_parts),
        message("user", none, parts),
        message("assistant", F.col("seeded"), no_parts),
    )
    m = docs.select("doc_id", mask_messages(messages, ALL)["messages"].alias("m"))
    return m.select(
        "doc_id",
        F.col("m")[0]["role"].alias("role1"),
        F.col("m")[0]["content"].alias("content1"),
        F.col("m")[1]["parts"][0]["text"].alias("part1"),
        F.col("m")[1]["parts"][2]["text"].alias("part3"),
        F.col("m")[1]["parts"][1]["image_url"].alias("image2"),
        F.col("m")[2]["content"].alias("content3"),
    )


def session_ctes(rules: ScrubRules, source: str = SEEDED_SQL) -> str:
    """Every turn's hits with the session-wide mask of each, and the turn's pieces."""
    keys = "session_id, turn"
    ctes = [f"s0 AS (SELECT {keys}, text AS t FROM ({source}))"]
    hits = []
    for k, rule in enumerate(rules.ordered, 1):
        pattern = sql_text(("(?i)" if rule.ignore_case else "") + rule.pattern)
        ok = luhn_sql("m[i]") if rule.category == "credit_card" else "true"
        ctes.append(
            f"m{k} AS (SELECT *, regexp_extract_all(t, {pattern}, 0) AS m, "
            f"string_split_regex(t, {pattern}) AS s FROM s{k - 1})"
        )
        ctes.append(
            f"s{k} AS (SELECT {keys}, array_to_string(list_transform(s, lambda x, i: x || "
            f"CASE WHEN i > len(m) THEN '' WHEN {ok} THEN chr(1) || '{k}#' || i || chr(1) "
            f"ELSE m[i] END), '') AS t FROM m{k})"
        )
        hits.append(
            f"SELECT {keys}, {k} AS rule, {sql_text(rule.category)} AS category, "
            f"{sql_text(rule.template)} AS template, i, m[i] AS value FROM "
            f"(SELECT {keys}, m, unnest(range(1, len(m) + 1)) AS i FROM m{k}) WHERE {ok}"
        )
    ctes.append("hits AS (" + "\nUNION ALL\n".join(hits) + ")")
    ctes.append(
        "firsts AS (SELECT session_id, value, "
        "min({'turn': turn, 'rule': rule, 'i': i, 'category': category, 'template': template}) AS f "
        "FROM hits GROUP BY session_id, value)"
    )
    ctes.append(
        "numbered AS (SELECT session_id, value, f.category AS category, f.template AS template, "
        "row_number() OVER (PARTITION BY session_id, f.category ORDER BY f.turn, f.rule, f.i) AS idx "
        "FROM firsts)"
    )
    ctes.append(
        "entries AS (SELECT *, replace(template, '{idx}', idx::VARCHAR) AS mask FROM numbered)"
    )
    return "WITH " + ",\n".join(ctes)


def sessions_sql(rules: ScrubRules) -> str:
    last = len(rules.ordered)
    return (
        session_ctes(rules)
        + f""",
swaps AS (SELECT h.session_id, h.turn, list(h.rule || '#' || h.i) AS place, list(e.mask) AS mask
  FROM hits h JOIN entries e ON e.session_id = h.session_id AND e.value = h.value
  GROUP BY h.session_id, h.turn)
SELECT s.session_id, s.turn, array_to_string(list_transform(string_split(s.t, chr(1)), lambda x, i:
  CASE WHEN i % 2 = 1 THEN x ELSE w.mask[list_position(w.place, x)] END), '') AS masked
FROM s{last} s LEFT JOIN swaps w ON w.session_id = s.session_id AND w.turn = s.turn"""
    )


@query(sessions_sql(ALL))
def mask_sessions(spark, sf_dir):
    masked, _ = sessions.mask_sessions(seeded(spark, sf_dir), rules=ALL)
    return masked


@query(sessions_sql(CUSTOM))
def mask_sessions_custom(spark, sf_dir):
    masked, _ = sessions.mask_sessions(seeded(spark, sf_dir), rules=CUSTOM)
    return masked


@query(
    session_ctes(ALL)
    + "\nSELECT session_id, category, idx, mask, value AS original FROM entries"
)
def mask_map(spark, sf_dir):
    return sessions.mask_map(seeded(spark, sf_dir), rules=ALL).select(
        "session_id", "category", "idx", "mask", "original"
    )


@query(
    session_ctes(ALL)
    + "\nSELECT session_id, category, count(*) AS n_values FROM entries GROUP BY ALL"
)
def entity_counts(spark, sf_dir):
    return sessions.entity_counts(seeded(spark, sf_dir), rules=ALL)


@query(f"SELECT session_id, turn, text AS restored FROM ({SEEDED_SQL})")
def unmask_roundtrip(spark, sf_dir):
    # masking all sessions and restoring them must give every text back
    masked, entries = sessions.mask_sessions(seeded(spark, sf_dir), rules=ALL)
    return restore.unmask(
        checkpointed(masked), entries, ["session_id", "turn"], text="masked", rules=ALL
    ).select("session_id", "turn", "restored")


@query(
    session_ctes(ALL)
    + """,
replies AS (SELECT doc_id, doc_id % 50 AS session_id, 1 + doc_id % 12 AS k FROM documents)
SELECT r.doc_id, 'To [EMAIL_' || r.k || '] and ' || coalesce(e.value, '[EMAIL_' || r.k || '0]')
  || ' re [SSN_x] [NOTE_1]' AS restored
FROM (SELECT r.doc_id, r.session_id, coalesce(e.value, '[EMAIL_' || r.k || ']') AS one, r.k
  FROM replies r LEFT JOIN entries e ON e.session_id = r.session_id AND e.mask = '[EMAIL_' || r.k || ']') r
LEFT JOIN entries e ON e.session_id = r.session_id AND e.mask = '[EMAIL_' || r.k || '0]'
""".replace("'To [EMAIL_' || r.k || '] and '", "'To ' || r.one || ' and '")
)
def unmask_replies(spark, sf_dir):
    # [EMAIL_1] is a prefix of [EMAIL_10] up to the bracket; unknown masks stay
    docs = table(spark, sf_dir, "documents")
    k = (1 + F.col("doc_id") % 12).cast("string")
    replies = docs.select(
        "doc_id",
        F.expr("doc_id % 50").alias("session_id"),
        F.concat(
            F.lit("To [EMAIL_"), k, F.lit("] and [EMAIL_"), k, F.lit("0] re [SSN_x] [NOTE_1]")
        ).alias("text"),
    )
    entries = sessions.mask_map(seeded(spark, sf_dir), rules=ALL)
    return restore.unmask(replies, entries, ["doc_id"], rules=ALL).select("doc_id", "restored")


# ------------------------------------------------------------------------ tokens

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def tokens_sql(text: str) -> str:
    pieces = (
        f"regexp_extract_all({text}, ' ?[A-Za-z0-9_]+|[^\\p{{L}}\\p{{N}}_{WS}]|\\n+|[{WS}]{{2,}}', 0)"
    )
    score = (
        f"CASE WHEN regexp_full_match(p, '[{WS}]+') THEN greatest(1, length(p) // 4) "
        "WHEN regexp_full_match(p, ' ?[A-Za-z0-9]+') AND length(ltrim(p)) > 6 "
        "THEN 1 + (length(ltrim(p)) - 3) // 4 ELSE 1 END"
    )
    return (
        f"(CASE WHEN coalesce({text}, '') = '' THEN 0 ELSE greatest(1, coalesce(list_sum("
        f"list_transform({pieces}, lambda p: {score})), 0)) END)::BIGINT"
    )


@query(f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def doc_tokens(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "SELECT item_id, len(regexp_extract_all(text, '\\S+', 0))::BIGINT AS tokens FROM benchmark"
)
def encoder_tokens(spark, sf_dir):
    # a plugged-in encoder; here one token per word
    items = table(spark, sf_dir, "benchmark")
    return items.select("item_id", count_tokens(F.col("text"), str.split).alias("tokens"))


@query(
    "SELECT conv_id, count(*) AS n_messages, 3 + sum(3 + "
    + tokens_sql("role")
    + " + "
    + tokens_sql("text")
    + ")::BIGINT AS tokens FROM conversations GROUP BY conv_id"
)
def conversation_tokens(spark, sf_dir):
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "role", "text"))
    return (
        turns.select("conv_id", message_tokens(F.col("role"), F.col("text")).alias("n"))
        .groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("n_messages"),
            (F.lit(3) + F.sum("n")).cast("bigint").alias("tokens"),
        )
    )


@query(
    f"SELECT doc_id, {tokens_sql('text')} + {tokens_sql('lang')} + {tokens_sql('source')} "
    "AS tokens FROM documents"
)
def prompt_tokens(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return docs.select(
        "doc_id", prompts_tokens(F.array("text", "lang", "source")).alias("tokens")
    )


@query(
    f"SELECT doc_id, tokens, 400 AS status FROM (SELECT doc_id, {tokens_sql('text')} AS tokens "
    "FROM documents) WHERE tokens > 500"
)
def oversize_docs(spark, sf_dir):
    limits = budgets.Limits(max_tokens_per_request=500)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sized = bound(docs, "tokens", estimate_tokens(F.col("text")))
    return sized.where(budgets.is_oversize(F.col("tokens"), limits)).select(
        "doc_id", "tokens", F.lit(budgets.OVERSIZE_STATUS).alias("status")
    )


# ---------------------------------------------------------------------- flagship

_PER_LANG = ", ".join(
    f"count(DISTINCT CASE WHEN category = '{c}' THEN value END) AS n_{c}" for c in PRECEDENCE
)


@query(
    f"WITH {masking_ctes(SEEDED_SQL, ALL, 'doc_id, lang')},\n"
    "hits AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, lang, '{r.category}' AS category, unnest(w) AS value FROM v{k}"
        for k, r in enumerate(ALL.ordered, 1)
    )
    + "),\n"
    f"h AS (SELECT lang, count(DISTINCT doc_id) AS docs_with_hits, {_PER_LANG} "
    "FROM hits GROUP BY lang),\n"
    f"d AS (SELECT lang, count(*) AS docs, sum({tokens_sql('text')})::BIGINT AS tokens "
    f"FROM ({SEEDED_SQL}) GROUP BY lang)\n"
    "SELECT d.lang, d.docs, d.tokens, coalesce(h.docs_with_hits, 0) AS docs_with_hits, "
    + ", ".join(f"coalesce(h.n_{c}, 0) AS n_{c}" for c in PRECEDENCE)
    + " FROM d LEFT JOIN h ON h.lang = d.lang"
)
def redaction_report(spark, sf_dir):
    """Documents, tokens and distinct masked values per language."""
    docs = seeded(spark, sf_dir).select("lang", "text")
    scanned = docs.select(
        "lang",
        estimate_tokens(F.col("text")).alias("tokens"),
        scan_text(F.col("text"), ALL)["seen"].alias("seen"),
    )
    # one row per value of a document; the first one speaks for the document
    rows = scanned.select("lang", "tokens", F.posexplode_outer("seen").alias("pos", "v"))
    speaks = F.coalesce(F.col("pos") == 0, F.lit(True))
    # values are made distinct first, so that a language with most of them is counted by many tasks
    values = rows.groupBy("lang", F.col("v.category").alias("category"), F.col("v.value").alias("value")).agg(
        F.count_if(speaks).alias("docs"),
        F.sum(F.when(speaks, F.col("tokens"))).alias("tokens"),
        F.count_if(F.col("pos") == 0).alias("docs_with_hits"),
    )
    return values.groupBy("lang").agg(
        F.sum("docs").alias("docs"),
        F.sum("tokens").alias("tokens"),
        F.sum("docs_with_hits").alias("docs_with_hits"),
        *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in PRECEDENCE],
    )
