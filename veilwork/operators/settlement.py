"""Admission when usage is recorded at its own time, after the reply.

A request is checked when it arrives and counts from when it is settled: in between it is pending and
seen by nobody. It counts with what it is settled with, and never if its reply failed. So arrivals and
settlements are two kinds of events in one order of time, and what is pending goes from one part of the replay to the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.operators.budgets import (
    DECISION_FIELDS,
    ROWS_PER_TASK,
    Limits,
    WindowState,
    decided,
    is_oversize,
    named,
    parts_of,
    tick,
    tick_us,
    whole_steps,
)
from veilwork.session import checkpointed, discard, shared_dir

NEVER = (1 << 63) - 1  # when a failed reply is settled
COLUMNS = ["request", "client", "ts", "tokens", "amount", "settled"]


def admit_settled(
    df: DataFrame,
    limits: Limits,
    request: str = "request_id",
    client: str = "client_id",
    ts: str = "ts_us",
    tokens: str = "tokens",
    settled: str = "settled_us",
    recorded: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Replay admission of requests that arrive at ``ts`` and are settled at ``settled``.

    A null ``settled`` is a request whose reply failed: admitted, it records nothing. One settled before it arrived is
    taken as settled on arrival. ``recorded`` names the tokens it is settled with, if not its estimate. Of events at one instant,
    a settlement comes before the arrivals of later requests (by time, then by ``request``), so that
    ``settled = ts`` is :func:`veilwork.operators.budgets.admit_requests`. Returns what that returns.

    Where all that is settled in a slot of the window's length and the one before stays within the limits, every
    arrival is admitted for certain. Only other slots are replayed, client by client in runs. Slots belong to
    one run if something admitted in an earlier one may be settled where a later one sees it; what quiet slots
    settle there comes with the run. Runs are cut in time into parts of about ``rows_per_task`` rows, and each part hands on
    what is pending or still inside the window.
    """
    amount = F.col(recorded) if recorded else F.col(tokens)
    narrow = df.select(
        F.col(request).alias("request"),
        F.col(client).alias("client"),
        F.col(ts).cast("bigint").alias("ts"),
        F.col(tokens).cast("bigint").alias("tokens"),
        F.coalesce(amount, F.lit(0)).cast("bigint").alias("amount"),
        F.greatest(F.coalesce(F.col(settled), F.lit(NEVER)), F.col(ts)).cast("bigint").alias("settled"),
    )
    names = (limits, request, client, ts, tokens)
    if not limits.enabled:
        return named(narrow.select("*", *decided("ok")), *names)
    too_big = is_oversize(F.col("tokens"), limits)
    asked = narrow.where(~too_big).withColumns(
        {
            "slot": whole_steps(F.col("ts"), limits.window_us),
            "settled_slot": F.when(F.col("settled") < NEVER, whole_steps(F.col("settled"), limits.window_us)),
        }
    )
    runs = checkpointed(crowded_slots(asked, limits))
    placed = asked.join(runs, ["client", "slot"], "left")
    quiet = placed.where(F.col("run").isNull())
    seen = (
        runs.select("client", "run", F.explode(F.array(F.col("slot") - 1, F.col("slot"))).alias("settled_slot"))
        .distinct()
    )
    sure = quiet.drop("run").join(seen, ["client", "settled_slot"])
    events = _events(placed.where(F.col("run").isNotNull()), False).unionByName(_events(sure, True))
    replayed = _replayed_in_parts(events, limits, rows_per_task)
    columns = ["request", "client", "ts", "tokens", "decision", "current_requests", "current_tokens"]
    return named(
        narrow.where(too_big)
        .select("*", *decided("oversize"))
        .select(*columns)
        .unionByName(quiet.select("*", *decided("ok")).select(*columns))
        .unionByName(replayed.select(*columns)),
        *names,
    )


def _events(rows: DataFrame, sure: bool) -> DataFrame:
    """Rows with the time ``at`` which they come: arrivals to decide, or settlements known beforehand."""
    at = F.col("settled") if sure else F.col("ts")
    return rows.select(*COLUMNS, "run", at.alias("at"), F.lit(sure).alias("sure"))


def crowded_slots(asked: DataFrame, limits: Limits) -> DataFrame:
    """``client, slot, run``: slots whose arrivals have to be replayed, and the run each belongs to."""
    zero = F.lit(0).cast("bigint")
    arrivals = asked.select(
        "client", "slot", F.lit(1).cast("bigint").alias("n"), "tokens", zero.alias("settles"), zero.alias("amount"),
        F.coalesce("settled_slot", "slot").alias("reach"),
    )
    settlements = asked.where("settled_slot is not null").select(
        "client", F.col("settled_slot").alias("slot"), zero.alias("n"), F.lit(None).cast("bigint").alias("tokens"),
        F.lit(1).cast("bigint").alias("settles"), "amount", F.lit(None).cast("bigint").alias("reach"),
    )
    totals = arrivals.unionByName(settlements).groupBy("client", "slot").agg(
        F.sum("n").alias("n"),
        F.max("tokens").alias("biggest"),
        F.sum("settles").alias("settles"),
        F.sum("amount").alias("amount"),
        F.max("reach").alias("reach"),
    )
    # one row per slot from here on: bounded by elapsed time, not by traffic
    by_time = Window.partitionBy("client").orderBy("slot")
    adjacent = F.lag("slot").over(by_time) == F.col("slot") - 1
    settles = F.col("settles") + F.when(adjacent, F.lag("settles").over(by_time)).otherwise(0)
    amount = F.col("amount") + F.when(adjacent, F.lag("amount").over(by_time)).otherwise(0)
    crowded = F.lit(False)
    if limits.max_requests_per_minute > 0:
        crowded = crowded | (settles >= limits.max_requests_per_minute)
    if limits.max_tokens_per_minute > 0:
        crowded = crowded | (amount + F.col("biggest") > limits.max_tokens_per_minute)
    flagged = totals.select("client", "slot", (F.col("n") > 0).alias("asked"), crowded.alias("crowded"), "reach")
    # the last slot that sees what an earlier crowded one may have admitted
    before = by_time.rowsBetween(Window.unboundedPreceding, -1)
    starts = F.coalesce(F.col("slot") > F.max(F.col("reach") + 1).over(before), F.lit(True))
    return (
        flagged.where("asked and crowded")
        .withColumn("starts", starts)
        .withColumn(
            "run",
            F.max(F.when(F.col("starts"), F.col("slot"))).over(by_time.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .select("client", "slot", "run")
    )


def _replayed(events: DataFrame, limits: Limits) -> DataFrame:
    """All events with their decisions, each run in one pass."""
    columns = [*COLUMNS, "run", "at", "sure"]
    ordered = (
        events.select(*columns)
        .repartition("client", "run")
        .sortWithinPartitions("client", "run", "at", "ts", "request", F.desc("sure"))
    )
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    return ordered.mapInPandas(_replayer(limits), ", ".join(f"{c} {kinds[c]}" for c in columns) + ", " + DECISION_FIELDS)


def _replayed_in_parts(events: DataFrame, limits: Limits, rows_per_task: int) -> DataFrame:
    """Decisions of the arrivals among ``events``, part by part, all runs side by side."""
    spark = events.sparkSession
    parts = checkpointed(parts_of(events, limits, rows_per_task, at="at"))
    last = parts.agg(F.max("part").alias("p")).first()["p"] or 0
    if last == 0:
        return _replayed(events, limits).where(~F.col("sure"))
    base = f"{shared_dir(spark)}/settlement-{uuid.uuid4().hex}"
    events.withColumn("tick", tick(limits, "at")).join(parts, ["client", "run", "tick"]).drop("tick").write.partitionBy(
        "part"
    ).parquet(f"{base}/rows")
    rows = spark.read.parquet(f"{base}/rows")
    begins = parts.groupBy("client", "run", "part").agg((F.min("tick") * tick_us(limits)).alias("begins"))
    for part in range(last + 1):
        todo = rows.where(F.col("part") == part).select(*events.columns)
        if part:
            # pending, or still inside the window when this part begins
            handed_on = (
                spark.read.parquet(f"{base}/decided/pass={part - 1}")
                .where((F.col("decision") == "ok") & (F.col("settled") < NEVER))
                .join(begins.where(F.col("part") == part).drop("part"), ["client", "run"])
                .where(F.col("settled") >= F.col("begins") - limits.window_us)
                .withColumn("at", F.col("settled"))
                .withColumn("sure", F.lit(True))
            )
            todo = todo.unionByName(handed_on.select(*todo.columns))
        _replayed(todo, limits).write.parquet(f"{base}/decided/pass={part}")
    done = checkpointed(spark.read.parquet(f"{base}/decided").where("not sure").drop("pass"))
    discard(spark, base)
    return done


def _replayer(limits: Limits):
    """Replay sorted partitions batch by batch; a run may span many batches."""
    most, budget, window = limits.max_requests_per_minute, limits.max_tokens_per_minute, limits.window_us

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, pending, current = WindowState(), [], None
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            client, run_id = batch["client"].to_numpy(), batch["run"].to_numpy()
            changes = np.ones(n, bool)
            changes[1:] = (client[1:] != client[:-1]) | (run_id[1:] != run_id[:-1])
            changes[0] = current != (client[0], run_id[0])
            at, tokens, amounts = batch["at"].tolist(), batch["tokens"].tolist(), batch["amount"].tolist()
            settled = batch["settled"].tolist()
            sure = batch["sure"].tolist()
            decision, requests, used = ["ok"] * n, [0] * n, [0] * n
            for i in range(n):
                if changes[i]:
                    state, pending = WindowState(), []
                now = at[i]
                while pending and pending[0][0] <= now:
                    state.record(*heappop(pending))
                if sure[i]:
                    state.record(now, amounts[i])
                    continue
                state.expire(now - window)
                requests[i], used[i] = len(state), state.total
                if 0 < most <= requests[i]:
                    decision[i] = "requests"
                elif budget > 0 and used[i] + tokens[i] > budget:
                    decision[i] = "tokens"
                elif settled[i] < NEVER:
                    heappush(pending, (settled[i], amounts[i]))
            current = (client[-1], run_id[-1])
            yield batch.assign(decision=decision, current_requests=requests, current_tokens=used)

    return run
