"""Streaming twins of masking, admission, usage and telemetry."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from veilwork.functions.masking import mask_text
from veilwork.operators.budgets import OVERSIZE_STATUS, Limits, WindowState, replay
from veilwork.operators.telemetry import (
    LATENCY_ROWS,
    redaction_counts,
    request_counts,
    schema_totals,
    summary_of,
    token_totals,
)
from veilwork.rules import ScrubRules
from veilwork.session import checkpointed, discard, shared_dir


def stream_mask(
    df: DataFrame, text: str = "text", rules: ScrubRules | None = None, out: str = "masked"
) -> DataFrame:
    """Mask whole messages as they arrive; nothing is remembered between rows."""
    return df.withColumn(out, mask_text(F.col(text), rules))


ADMIT_STATE = "times array<bigint>, amounts array<bigint>, last bigint"


def stream_admit(df: DataFrame, limits: Limits) -> DataFrame:
    """Admission online: ``request_id, client_id, ts_us, tokens`` in, decisions out.

    The state of a client is what it was admitted inside the window.  Rows of a
    micro-batch are taken in time order, so the source's rate limit (such as
    ``maxFilesPerTrigger``) bounds what one client brings at once; a row older than what was already
    decided for its client can't change history and is reported as ``late``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out_type = (
        f"request_id {kinds['request_id']}, client_id {kinds['client_id']}, ts_us bigint, "
        "tokens bigint, decision string, status int, current_requests bigint, "
        "current_tokens bigint"
    )

    def step(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts_us", "request_id"])
        times, amounts, last = state.get if state.exists else ([], [], None)
        window = WindowState(times, amounts)
        ts, tokens = rows["ts_us"].to_numpy(), rows["tokens"].to_numpy()
        late = ts < last if last is not None else np.zeros(len(rows), dtype=bool)
        big = np.zeros(len(rows), dtype=bool)
        if limits.enabled and limits.max_tokens_per_request > 0:
            big = tokens > limits.max_tokens_per_request
        decision = np.where(late, "late", np.where(big, "oversize", "ok")).astype(object)
        requests, used = np.zeros((2, len(rows)), dtype=np.int64)
        todo = ~late & ~big
        if limits.enabled and todo.any():
            asked, amounts = ts[todo].tolist(), tokens[todo].tolist()
            n = len(asked)
            verdict, count, total = ["ok"] * n, [0] * n, [0] * n
            replay(asked, amounts, amounts, limits, window, verdict, count, total, 0, n)
            decision[todo], requests[todo], used[todo] = verdict, count, total
        newest = int(ts.max()) if last is None else max(last, int(ts.max()))
        window.expire(newest - limits.window_us)
        head = window.head
        state.update((window.times[head:], window.amounts[head:], newest))
        status = np.select(
            [decision == "ok", decision == "oversize", decision == "late"],
            [200, OVERSIZE_STATUS, limits.reject_status_code],
            limits.reject_status_code,
        )
        yield rows[["request_id", "client_id", "ts_us", "tokens"]].assign(
            decision=decision,
            status=status.astype("int32"),
            current_requests=requests,
            current_tokens=used,
        )

    return (
        df.select(
            "request_id",
            "client_id",
            F.col("ts_us").cast("bigint").alias("ts_us"),
            F.col("tokens").cast("bigint").alias("tokens"),
        )
        .groupBy("client_id")
        .applyInPandasWithState(
            step, out_type, ADMIT_STATE, "append", GroupStateTimeout.NoTimeout
        )
    )


def stream_admit_in_order(df: DataFrame, limits: Limits, delay: str = "1 minute") -> DataFrame:
    """Admission by event time: rows may come out of order by ``delay``, and are decided as if they hadn't.

    ``request_id, client_id, ts_us, tokens`` in, decisions out. A row waits in its client's state until the watermark has passed it; then
    it is decided in its place, so what comes out is what a replay of the whole log says. A row older than the
    watermark is dropped, as in any query with one. The state of a client is what waits (the traffic of ``delay``) and
    what it was admitted inside the window, and goes with a timer when neither is left.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out_type = (
        f"request_id {kinds['request_id']}, client_id {kinds['client_id']}, ts_us bigint, "
        "tokens bigint, decision string, status int, current_requests bigint, current_tokens bigint"
    )
    held = f"ids array<{kinds['request_id']}>, ts array<bigint>, tokens array<bigint>, times array<bigint>, amounts array<bigint>"
    most = limits.max_tokens_per_request if limits.enabled else 0
    names = ["request_id", "client_id", "ts_us", "tokens", "decision", "status", "current_requests", "current_tokens"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, ts, tokens, times, amounts = state.get if state.exists else ([], [], [], [], [])
        waiting = list(zip(ts, ids, tokens))
        for batch in batches:
            waiting += zip(batch["ts_us"].tolist(), batch["request_id"].tolist(), batch["tokens"].tolist())
        waiting.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        due = [row for row in waiting if row[0] <= passed]
        waiting = waiting[len(due) :]
        window = WindowState(times, amounts)
        asked = [row for row in due if not 0 < most < row[2]]
        n = len(asked)
        verdict, count, total = ["ok"] * n, [0] * n, [0] * n
        if limits.enabled:
            at, cost = [row[0] for row in asked], [row[2] for row in asked]
            replay(at, cost, cost, limits, window, verdict, count, total, 0, n)
        found = dict(zip(asked, zip(verdict, count, total)))
        out = []
        for row in due:
            decision, seen, used = found.get(row, ("oversize", None, None))
            status = {"ok": 200, "oversize": OVERSIZE_STATUS}.get(decision, limits.reject_status_code)
            out.append((row[1], key[0], row[0], row[2], decision, status, seen, used))
        window.expire(passed - limits.window_us)
        times, amounts = window.times[window.head :], window.amounts[window.head :]
        if waiting or times:
            ids, ts, tokens = ([row[i] for row in waiting] for i in (1, 0, 2))
            state.update((ids, ts, tokens, times, amounts))
            timer = ts[0] if waiting else times[-1] + limits.window_us
            state.setTimeoutTimestamp(max(timer // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            rows = pd.DataFrame(out, columns=names)
            yield rows.astype({"status": "int32", "current_requests": "Int64", "current_tokens": "Int64"})

    return (
        df.select(
            "request_id",
            "client_id",
            F.col("ts_us").cast("bigint").alias("ts_us"),
            F.col("tokens").cast("bigint").alias("tokens"),
            F.timestamp_micros("ts_us").alias("_ts"),
        )
        .withWatermark("_ts", delay)
        .groupBy("client_id")
        .applyInPandasWithState(step, out_type, held, "append", GroupStateTimeout.EventTimeTimeout)
    )


def stream_window_usage(
    df: DataFrame,
    seconds: int = 60,
    hop_seconds: int = 10,
    delay: str = "1 minute",
    ts: str = "ts",
    client: str = "client_id",
    tokens: str = "tokens",
) -> DataFrame:
    """Requests and tokens per client in hopping windows of event time."""
    return (
        df.withWatermark(ts, delay)
        .groupBy(F.window(ts, f"{seconds} seconds", f"{hop_seconds} seconds"), client)
        .agg(
            F.count(F.lit(1)).alias("window_requests"),
            F.sum(tokens).cast("bigint").alias("window_tokens"),
        )
        .select(
            client,
            F.unix_micros("window.start").alias("window_start_us"),
            F.unix_micros("window.end").alias("window_end_us"),
            "window_requests",
            "window_tokens",
        )
    )


def stream_metrics(
    outcomes: DataFrame, every: str = "1 minute", delay: str = "1 minute", ts: str = "ts"
) -> DataFrame:
    """Telemetry counters per tumbling window of event time."""
    return (
        outcomes.withWatermark(ts, delay)
        .groupBy(F.window(ts, every))
        .agg(*request_counts(), *schema_totals(), *token_totals())
        .withColumn("window_start_us", F.unix_micros("window.start"))
        .withColumn("window_end_us", F.unix_micros("window.end"))
        .drop("window")
    )


class RunningSummary:
    """The metrics summary of a stream, carried from micro-batch to micro-batch as small tables.

    A summary is a row of counters, the last 1000 latencies and a count per category, so it stays as small as it is, however
    long the stream runs. The tables after each micro-batch are written under its number, from those of the one before: a batch
    that is retried writes the same again. ``order`` (unique, rising with completion) says which latencies are the last.
    """

    def __init__(self, base: str, order: list[str]) -> None:
        self.base, self.order = base, order

    def _read(self, spark: SparkSession, batch: int) -> dict[str, DataFrame]:
        return {name: spark.read.parquet(f"{self.base}/{batch}/{name}") for name in ("counts", "latencies", "redactions")}

    def add(self, outcomes: DataFrame, batch: int) -> None:
        """For ``foreachBatch``."""
        outcomes = checkpointed(outcomes)
        now = {
            "counts": outcomes.agg(*request_counts(), *schema_totals(), *token_totals()),
            "latencies": outcomes.where("outcome = 'success'").select(*self.order, "duration_ms"),
            "redactions": redaction_counts(outcomes)
            if "redactions" in outcomes.columns
            else outcomes.sparkSession.createDataFrame([], "category string, n_values bigint"),
        }
        if batch:
            now = {name: rows.unionByName(now[name]) for name, rows in self._read(outcomes.sparkSession, batch - 1).items()}
        counts = now["counts"]
        merged = {
            "counts": counts.agg(*[F.sum(c).alias(c) for c in counts.columns]),
            "latencies": now["latencies"].orderBy(*[F.desc(c) for c in self.order]).limit(LATENCY_ROWS),
            "redactions": now["redactions"].groupBy("category").agg(F.sum("n_values").alias("n_values")),
        }
        for name, rows in merged.items():
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/{batch}/{name}")
        if batch > 1:
            discard(outcomes.sparkSession, f"{self.base}/{batch - 2}")

    def summary(self, spark: SparkSession, batch: int) -> DataFrame:
        """What :func:`veilwork.operators.telemetry.metrics_summary` says of all outcomes up to ``batch``."""
        tables = self._read(spark, batch)
        return summary_of(tables["counts"], tables["latencies"], self.order, tables["redactions"])


def stream_summary(outcomes: DataFrame, order: list[str]) -> DataFrame:
    """Run a stream of outcomes over what its source holds now; its summary at the end."""
    spark = outcomes.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    running = RunningSummary(f"{base}/summary", order)
    query = (
        outcomes.writeStream.foreachBatch(running.add)
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return running.summary(spark, last)


def run_to_the_end(df: DataFrame, keys: list[str]) -> DataFrame:
    """Run an aggregating stream over what its source holds now: the last state of each of its ``keys``.

    Windows that the watermark has not closed when the source ends are reported as
    they stand, so that nothing read goes missing.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")

    query = (
        df.writeStream.foreachBatch(keep)
        .outputMode("update")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    numbered = StructType([*df.schema.fields, StructField("batch", LongType())])
    states = spark.read.schema(numbered).parquet(f"{base}/rows")
    last = states.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "batch").alias("last"))
    return last.select("last.*")


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming query over what its source holds now, into a table in the shared folder."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start(f"{base}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/rows")
