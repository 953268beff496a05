"""Queries over request bodies and streamed replies that are written back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.catalog.base import SEEDED, query, spread, table
from veilwork.catalog.flows import GUARD
from veilwork.catalog.texts import ALL, masked_sql, tokens_sql
from veilwork.catalog.traffic import admission_sql
from veilwork.functions.bodies import mask_body
from veilwork.plans import guard

# --------------------------------------------------------------------- request bodies

# Chats with text or parts, prompts and lists of prompts, each with fields that hold addresses
# and must stay: names, users, stop words, image addresses, numbers, nested objects.
TAIL = "substr(seeded, length(text) + 1, length(seeded))"
BODY_DOCS = f"SELECT doc_id, text, seeded, {TAIL} AS tail FROM (SELECT doc_id, text, {SEEDED} AS seeded FROM documents)"
PLAIN_BODY = "'{\"model\": \"m9\", \"input\": [\"a@corp.io\"], \"seed\": ' || CAST(doc_id AS STRING) || ', \"none\": null}'"
BODY = f"""CASE doc_id % 5
  WHEN 0 THEN to_json(named_struct('model', 'm0', 'temperature', 0.25D, 'seed', doc_id, 'user', 'owner1@corp.io', 'messages',
    array(named_struct('role', 'user', 'name', 'ann@corp.io', 'content', text, 'extra', map('k', array(1, 2))))))
  WHEN 1 THEN to_json(named_struct('stop', array('x@corp.io'), 'messages', array(
    to_variant_object(named_struct('role', 'system', 'content', 'Be brief, b@corp.io.')),
    to_variant_object(named_struct('role', 'user', 'content', array(to_variant_object(named_struct('type', 'text', 'text', text)),
      to_variant_object(named_struct('type', 'image_url', 'image_url', named_struct('url', 'http://10.0.0.1/i'), 'text', 'c@corp.io')),
      to_variant_object(named_struct('text', tail, 'type', 'text', 'cached', true))))))))
  WHEN 2 THEN to_json(named_struct('prompt', seeded, 'suffix', 's@corp.io', 'logit_bias', map('50', -1)))
  WHEN 3 THEN to_json(named_struct('n', 2, 'prompt', array(text, tail)))
  ELSE {PLAIN_BODY} END"""
BODY_TEXT = (
    "CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN 'Be brief, b@corp.io.' || chr(1) || text || chr(1) || tail "
    "WHEN 2 THEN seeded WHEN 3 THEN text || chr(1) || tail ELSE '' END"
)


def bodies(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("seeded", F.expr(SEEDED))
    return docs.withColumn("tail", F.expr(TAIL)).select("doc_id", F.expr(BODY).alias("body"))


def _fields(body):
    """Every leaf of a body that the fixture has, read back from the JSON text."""
    paths = {
        "one": "$.messages[0].content",
        "two": "$.messages[1].content[0].text",
        "three": "$.messages[1].content[2].text",
        "cached": "$.messages[1].content[2].cached",
        "image": "$.messages[1].content[1].image_url.url",
        "caption": "$.messages[1].content[1].text",
        "name": "$.messages[0].name",
        "extra": "$.messages[0].extra.k[1]",
        "model": "$.model",
        "temperature": "$.temperature",
        "seed": "$.seed",
        "owner": "$.user",
        "stop": "$.stop[0]",
        "suffix": "$.suffix",
        "bias": "$.logit_bias.50",
        "n": "$.n",
        "input": "$.input[0]",
    }
    prompt = F.get_json_object(body, "$.prompt")
    listed = F.get_json_object(body, "$.n").isNotNull()
    return [
        *[F.get_json_object(body, path).alias(name) for name, path in paths.items()],
        F.when(~listed, prompt).alias("prompt"),
        F.get_json_object(body, "$.prompt[1]").alias("second"),
    ]


@query(
    masked_sql(f"SELECT doc_id, {BODY_TEXT} AS text FROM ({BODY_DOCS})", ALL, "doc_id").replace(
        "SELECT doc_id, t AS masked FROM",
        """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN t WHEN 1 THEN string_split(t, chr(1))[1] END AS one,
  CASE doc_id % 5 WHEN 1 THEN string_split(t, chr(1))[2] END AS two,
  CASE doc_id % 5 WHEN 1 THEN string_split(t, chr(1))[3] END AS three,
  CASE doc_id % 5 WHEN 1 THEN 'true' END AS cached, CASE doc_id % 5 WHEN 1 THEN 'http://10.0.0.1/i' END AS image,
  CASE doc_id % 5 WHEN 1 THEN 'c@corp.io' END AS caption, CASE doc_id % 5 WHEN 0 THEN 'ann@corp.io' END AS name,
  CASE doc_id % 5 WHEN 0 THEN '2' END AS extra, CASE doc_id % 5 WHEN 0 THEN 'm0' WHEN 4 THEN 'm9' END AS model,
  CASE doc_id % 5 WHEN 0 THEN '0.25' END AS temperature,
  CASE WHEN doc_id % 5 IN (0, 4) THEN doc_id::VARCHAR END AS seed, CASE doc_id % 5 WHEN 0 THEN 'owner1@corp.io' END AS owner,
  CASE doc_id % 5 WHEN 1 THEN 'x@corp.io' END AS stop, CASE doc_id % 5 WHEN 2 THEN 's@corp.io' END AS suffix,
  CASE doc_id % 5 WHEN 2 THEN '-1' END AS bias, CASE doc_id % 5 WHEN 3 THEN '2' END AS n,
  CASE doc_id % 5 WHEN 4 THEN 'a@corp.io' END AS input,
  CASE doc_id % 5 WHEN 2 THEN t END AS prompt, CASE doc_id % 5 WHEN 3 THEN string_split(t, chr(1))[2] END AS second
  FROM""",
    )
)
def masked_bodies(spark, sf_dir):
    """Bodies with their texts masked and written back with all their keys."""
    masked = bodies(spark, sf_dir).select("doc_id", mask_body(F.try_parse_json("body"), ALL)["body"].alias("b"))
    return masked.select("doc_id", F.to_json("b").alias("body")).select("doc_id", *_fields(F.col("body")))


_FRAMED = {
    0: f"6 + {tokens_sql(repr('user'))} + {tokens_sql(repr('ann@corp.io'))} + {tokens_sql('text')}",
    1: f"9 + {tokens_sql(repr('system'))} + {tokens_sql(repr('Be brief, b@corp.io.'))} + {tokens_sql(repr('user'))} + {tokens_sql('text')} + {tokens_sql('tail')}",
    2: tokens_sql("seeded"),
    3: f"{tokens_sql('text')} + {tokens_sql('tail')}",
}
BODY_LOG = (
    "SELECT doc_id AS request_id, doc_id % 40 AS client_id, doc_id * 60000000 AS ts_us, "
    f"(CASE doc_id % 5 {' '.join(f'WHEN {k} THEN {v}' for k, v in _FRAMED.items())} ELSE 0 END)::BIGINT AS tokens FROM ({BODY_DOCS})"
)


@query(
    admission_sql(GUARD.budget, f"SELECT * FROM ({BODY_LOG}) WHERE request_id % 5 <> 4")
    + f""",
masked AS ({masked_sql(f"SELECT doc_id, {BODY_TEXT} AS text FROM ({BODY_DOCS})", ALL, "doc_id")})
SELECT m.doc_id AS request_id, l.tokens AS estimated_tokens, coalesce(d.decision, 'ok') AS decision,
  CASE WHEN coalesce(d.decision, 'ok') <> 'ok' THEN NULL WHEN m.doc_id % 5 IN (0, 1) THEN string_split(m.masked, chr(1))[1] END AS one,
  CASE WHEN coalesce(d.decision, 'ok') = 'ok' AND m.doc_id % 5 = 2 THEN m.masked END AS prompt,
  CASE WHEN coalesce(d.decision, 'ok') = 'ok' AND m.doc_id % 5 IN (0, 4) THEN m.doc_id::VARCHAR END AS seed
FROM masked m JOIN ({BODY_LOG}) l ON l.request_id = m.doc_id LEFT JOIN decided d ON d.request_id = m.doc_id"""
)
def guard_bodies(spark, sf_dir):
    """Estimate, admit and mask whole bodies; one without a prompt isn't checked."""
    requests = bodies(spark, sf_dir).select(
        F.col("doc_id").alias("request_id"),
        F.expr("doc_id % 40").alias("client_id"),
        F.expr("doc_id * 60000000").alias("ts_us"),
        "body",
    )
    guarded = guard.guard_bodies(requests, GUARD)
    fields = {f"$.messages[0].content": "one", "$.prompt": "prompt", "$.seed": "seed"}
    read = [F.get_json_object("body", path).alias(name) for path, name in fields.items()]
    found = guarded.select("request_id", "estimated_tokens", "decision", *read)
    return found.withColumn("prompt", F.when(F.col("request_id") % 5 == 2, F.col("prompt")))
