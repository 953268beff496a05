"""Queries over streamed replies: lines read, masked in pieces, written back and settled."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.catalog.base import SEEDED, query, spread, table
from veilwork.catalog.flows import stream_of
from veilwork.catalog.texts import ALL, session_ctes, tokens_sql
from veilwork.functions.tokens import estimate_tokens
from veilwork.plans import streamed
from veilwork.sources import sse
from veilwork.streaming import chunks, online

# Each document as the reply to a request that named an address: seeded text with quotes, backslashes and
# line breaks as they are, cut into pieces of 17 characters, among lines of every other kind.
SIZE = 17
REPLY = f"{SEEDED} || ' for [EMAIL_1], \"user' || CAST(doc_id % 7 AS STRING) || '@corp.io\" \\\\ bye'"
REPLY_SQL = REPLY.replace("\\\\", "\\")
ASKED = "'Ask user' || CAST(doc_id % 5 AS STRING) || '@corp.io'"
FIRST = 5  # seq of the first piece
_OTHER = [
    "",
    ": keep-alive",
    'data: {"choices": [{"text": "legacy u1@corp.io"}]}',
    'data: {"choices": []}',
    "data: {broken",
]


def replies(docs):
    return docs.select("doc_id", F.expr(REPLY).alias("reply"))


def _line(piece):
    choice = F.struct(F.lit(0).alias("index"), F.struct(piece.alias("content")).alias("delta"))
    return F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("c1").alias("id"), F.array(choice).alias("choices"))))


def _legacy(piece):
    return F.concat(F.lit("data:"), F.to_json(F.struct(F.array(F.struct(piece.alias("text"))).alias("choices"))))


def reply_lines(docs, legacy_every=None):
    """``stream_id, seq, line``; every so many pieces come in the legacy form."""
    cut = F.regexp_extract_all("reply", F.lit(f"(?s).{{1,{SIZE}}}"), F.lit(0))
    one = (lambda p, i: F.when(i % legacy_every == 1, _legacy(p)).otherwise(_line(p))) if legacy_every else (lambda p, i: _line(p))
    last = F.array(F.lit("data: [DONE]"), F.lit('data: {"late": 1}'))
    lines = F.concat(F.array(*map(F.lit, _OTHER)), F.transform(cut, one), last)
    exploded = replies(docs).select(F.col("doc_id").alias("stream_id"), F.posexplode(lines).alias("seq", "line"))
    return exploded.withColumn("seq", F.col("seq").cast("bigint"))


def document_lines(spark, sf_dir, legacy_every=None):
    return reply_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), legacy_every)


# What is held after each piece, piece by piece: released up to the last blank before the buffer of 64,
# or all before it once there are more than 256 characters.
_AFTER_BLANK = "(length({0}) - length(regexp_extract({0}, '[^ \\t\\n\\r]*$')))"
_BEFORE_BUFFER = "substring(reply, c + 1, held - 64 + 1)"
TURNS = f"""replies AS MATERIALIZED (SELECT doc_id, reply, length(reply) AS size, CAST(ceil(length(reply) / {SIZE}.0) AS BIGINT) AS n
  FROM (SELECT doc_id, {REPLY_SQL} AS reply FROM documents)),
walk AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS b, 0::BIGINT AS c FROM replies
  UNION ALL SELECT doc_id, i + 1, c, CASE WHEN held <= 64 THEN c WHEN blank > 0 THEN c + blank WHEN held > 256 THEN c + held - 64 ELSE c END
  FROM (SELECT *, CASE WHEN held > 64 THEN {_AFTER_BLANK.format(_BEFORE_BUFFER)} ELSE 0 END AS blank
    FROM (SELECT w.doc_id, w.i, w.c, r.reply, least((w.i + 1) * {SIZE}, r.size) - w.c AS held
      FROM walk w JOIN replies r ON r.doc_id = w.doc_id WHERE w.i < r.n))),
turns AS MATERIALIZED (
  SELECT w.doc_id, {FIRST} + w.i - 1 AS seq, substring(r.reply, w.b + 1, w.c - w.b) AS text
  FROM walk w JOIN replies r ON r.doc_id = w.doc_id WHERE w.c > w.b
  UNION ALL SELECT w.doc_id, {FIRST} + w.i, substring(r.reply, w.c + 1) FROM walk w JOIN replies r ON r.doc_id = w.doc_id
  WHERE w.i = r.n AND w.c < r.size)"""


def masked_turns_sql(source: str, select: str) -> str:
    """``select`` over ``masked`` (``session_id, turn, masked``), the turns of ``source`` masked as sessions."""
    last = len(ALL.ordered)
    ctes = session_ctes(ALL, source).removeprefix("WITH ")
    return f"""WITH RECURSIVE {TURNS}, {ctes},
swaps AS (SELECT h.session_id, h.turn, list(h.rule || '#' || h.i) AS place, list(e.mask) AS mask
  FROM hits h JOIN entries e ON e.session_id = h.session_id AND e.value = h.value GROUP BY h.session_id, h.turn),
masked AS (SELECT s.session_id, s.turn, array_to_string(list_transform(string_split(s.t, chr(1)), lambda x, i:
  CASE WHEN i % 2 = 1 THEN x ELSE w.mask[list_position(w.place, x)] END), '') AS masked
  FROM s{last} s LEFT JOIN swaps w ON w.session_id = s.session_id AND w.turn = s.turn)
{select}"""


CHUNKS_SQL = masked_turns_sql(
    "SELECT doc_id AS session_id, seq AS turn, text FROM turns",
    "SELECT session_id AS stream_id, string_agg(masked, '' ORDER BY turn) AS masked FROM masked GROUP BY session_id",
)


def joined(safe):
    """The released pieces of each stream put together: as long as the reply itself."""
    return safe.groupBy("stream_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("seq", "safe"))), lambda r: r["safe"]),
            "",
        ).alias("masked")
    )


@query(CHUNKS_SQL)
def chunk_mask(spark, sf_dir):
    """All rules over pieces of both kinds, as they come out of the lines."""
    parsed = sse.parse_sse_lines(_without_others(document_lines(spark, sf_dir, 4)))
    return joined(chunks.mask_chunks(parsed.where(F.col("kind").isin("piece", "text", "done")), ALL))


def _without_others(lines):
    """Lines from the first piece to the end mark."""
    return lines.where((F.col("seq") >= FIRST) & (F.col("line") != 'data: {"late": 1}'))


@query(CHUNKS_SQL)
def stream_chunk_mask(spark, sf_dir):
    docs = stream_of(spark, sf_dir, "documents")
    parsed = sse.parse_sse_lines(_without_others(reply_lines(docs, 4)))
    pieces = parsed.where(F.col("kind").isin("piece", "text", "done")).select("stream_id", "seq", "piece", "is_done")
    return joined(online.run_available(chunks.stream_mask_chunks(pieces, ALL)))


# Only the request's address and the reply's own masks come back; [EMAIL_1] in a reply is the request's.
_ASKED_MAIL = "'user' || doc_id % 5 || '@corp.io'"


@query(
    f"""WITH RECURSIVE {TURNS}, lines AS (
  SELECT doc_id, unnest(range(0, {FIRST} + n + 1)) AS seq, n FROM replies)
SELECT l.doc_id AS stream_id, l.seq, CASE WHEN l.seq = 0 THEN 'blank' WHEN l.seq = 1 THEN 'other' WHEN l.seq = 2 THEN 'text'
    WHEN l.seq = 3 THEN 'data' WHEN l.seq = 4 THEN 'broken' WHEN l.seq = {FIRST} + l.n THEN 'done' ELSE 'piece' END AS kind,
  CASE WHEN l.seq >= {FIRST} THEN replace(coalesce(t.text, CASE WHEN l.seq < {FIRST} + l.n THEN '' END), '[EMAIL_1]', {_ASKED_MAIL.replace('doc_id', 'l.doc_id')}) END AS content,
  CASE WHEN l.seq >= {FIRST} AND l.seq < {FIRST} + l.n THEN 'c1'
    WHEN l.seq = {FIRST} + l.n AND t.text IS NOT NULL THEN 'chatcmpl-stream-1700000000' END AS id,
  CASE WHEN l.seq = {FIRST} + l.n AND t.text IS NOT NULL THEN 'm' || l.doc_id % 3 END AS model,
  CASE l.seq WHEN 0 THEN chr(10) WHEN 1 THEN ': keep-alive' || chr(10) WHEN 2 THEN 'data: {{"choices": [{{"text": "legacy u1@corp.io"}}]}}' || chr(10) || chr(10)
    WHEN 3 THEN 'data: {{"choices": []}}' || chr(10) || chr(10) WHEN 4 THEN 'data: {{broken' || chr(10)
    WHEN {FIRST} + l.n THEN 'data: [DONE]' || chr(10) || chr(10) END AS as_it_is
FROM lines l LEFT JOIN turns t ON t.doc_id = l.doc_id AND t.seq = l.seq"""
)
def streamed_replies(spark, sf_dir):
    """Lines in, lines out: what each carries, read back from the text that is sent on."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = reply_lines(docs).withColumns(
        {"model": F.concat(F.lit("m"), (F.col("stream_id") % 3).cast("string")), "created": F.lit(1_700_000_000).cast("bigint")}
    )
    asked = docs.select(F.col("doc_id").alias("stream_id"), F.lit(-1).cast("bigint").alias("seq"), F.expr(ASKED).alias("text"))
    sent = streamed.streamed_replies(lines, ALL, asked)
    first = F.regexp_extract("out", "^data: (\\{.*\\})\\n\\n", 1)
    chunk = F.when(F.col("kind").isin("piece", "done") & (first != ""), first)
    done = F.regexp_extract("out", "(data: \\[DONE\\]\\n\\n)$", 1)
    return sent.select(
        "stream_id",
        "seq",
        "kind",
        F.get_json_object(chunk, "$.choices[0].delta.content").alias("content"),
        F.get_json_object(chunk, "$.id").alias("id"),
        F.get_json_object(chunk, "$.model").alias("model"),
        F.when(F.col("kind") == "done", done).when(F.col("kind") != "piece", F.col("out")).alias("as_it_is"),
    )


@query(
    f"""SELECT doc_id AS request_id, {tokens_sql(ASKED)} + CAST(ceil(length({REPLY_SQL}) / {SIZE}.0) AS BIGINT) AS settled_tokens
FROM documents WHERE doc_id % 4 <> 3"""
)
def settle_streamed(spark, sf_dir):
    """Streamed replies of admitted requests settle at the estimate and one for each piece."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    asked = docs.select(F.col("doc_id").alias("request_id"), F.expr(ASKED).alias("text"))
    requests = asked.where("request_id % 4 <> 3").select("request_id", estimate_tokens(F.col("text")).alias("estimated_tokens"))
    kinds = sse.up_to_the_end(sse.parse_sse_lines(reply_lines(docs)))
    return streamed.settle_streamed(requests, kinds).select("request_id", "settled_tokens")
