"""Request and reply logs: schemas, readers and the client key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions.let import bound
from veilwork.functions.masking import MESSAGE_TYPE
from veilwork.functions.tokens import body_tokens
from veilwork.functions.variants import list_of, node, text_of

# --- fixed values ---
ANONYMOUS = "anonymous_client"
BEARER = "Bearer "
# --- end of fixed values ---

REQUEST_SCHEMA = (
    "request_id string, client_id string, ts timestamp, model string, stream boolean, "
    f"messages array<{MESSAGE_TYPE}>, prompt array<string>"
)
REPLY_SCHEMA = (
    "request_id string, choices array<struct<index:int,"
    "message:struct<role:string,content:string>,text:string,finish_reason:string>>, "
    "usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
)


def read_requests(spark: SparkSession, path: str, source: str = "parquet") -> DataFrame:
    """A request log, with ``is_chat`` and ``has_prompt`` telling what is to be estimated."""
    return with_prompt_kind(spark.read.schema(REQUEST_SCHEMA).format(source).load(path))


def read_replies(spark: SparkSession, path: str, source: str = "parquet") -> DataFrame:
    return spark.read.schema(REPLY_SCHEMA).format(source).load(path)


def read_request_lines(lines: DataFrame, body: str = "body") -> DataFrame:
    """Request bodies held as JSON text.

    A message's content may be a string or a list of parts, and a prompt a
    string, a list of strings or a list of messages; they are told apart by the
    kind of the JSON node, never by how a string looks.  A prompt that is a list
    of messages is counted as such and handed on in ``prompt`` as its contents;
    an empty string is no prompt.  ``estimated_tokens`` counts every string field.
    """
    body_value = F.try_parse_json(F.col(body))

    def shaped(message: Column) -> Column:
        content = node(message, "content")
        return F.struct(
            text_of(node(message, "role")).alias("role"),
            text_of(content).alias("content"),
            F.transform(
                list_of(content),
                lambda p: F.struct(
                    text_of(node(p, "type")).alias("type"),
                    text_of(node(p, "text")).alias("text"),
                    text_of(F.try_variant_get(p, "$.image_url.url", "variant")).alias("image_url"),
                ),
            ).alias("parts"),
        )

    prompt = node(F.col("_v"), "prompt")
    return with_prompt_kind(
        bound(lines, "_v", body_value)
        .withColumn("model", F.coalesce(text_of(node(F.col("_v"), "model")), F.lit("")))
        .withColumn("stream", F.coalesce(F.try_variant_get("_v", "$.stream", "boolean"), F.lit(False)))
        .withColumn(
            "messages",
            F.transform(list_of(node(F.col("_v"), "messages")), shaped).cast(f"array<{MESSAGE_TYPE}>"),
        )
        .withColumn(
            "prompt",
            F.coalesce(
                F.transform(
                    list_of(prompt),
                    lambda p: F.coalesce(text_of(p), text_of(node(p, "content")), F.lit("")),
                ),
                F.when(F.length(text_of(prompt)) > 0, F.array(text_of(prompt))),
            ),
        )
        .withColumn("estimated_tokens", body_tokens(F.col("_v")))
        .drop("_v")
    )


def with_prompt_kind(df: DataFrame) -> DataFrame:
    """``is_chat`` if there is a messages field; ``prompt`` counts when it is empty."""
    return df.withColumn("is_chat", F.col("messages").isNotNull()).withColumn(
        "has_prompt", (F.coalesce(F.size("messages"), F.lit(0)) > 0)
        | (F.coalesce(F.size("prompt"), F.lit(0)) > 0)
    )


def client_key(authorization: Column, x_client_id: Column, host: Column) -> Column:
    """Who a request counts for: explicit id, else bearer token, else host.

    Empty strings don't count; a bearer prefix alone leaves an empty key.
    """

    def filled(c: Column) -> Column:
        return F.when(F.length(c) > 0, c)

    token = F.trim(F.replace(filled(authorization), F.lit(BEARER), F.lit("")))
    return F.coalesce(filled(x_client_id), token, filled(host), F.lit(ANONYMOUS))
