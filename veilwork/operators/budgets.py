"""Client budgets over a sliding window: admission, usage, settlement.

Time is microseconds since the epoch (BIGINT).  Amounts are never negative, and
clients and request ids never null (a client key never is).
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.session import as_long, checkpointed, discard, shared_dir

SECOND = 1_000_000
ROWS_PER_TASK = 20_000_000
BUCKET_SECONDS = 600  # of a running sum of usage, whatever the window
TICKS = 4096  # of a window: parts are cut between ticks

# --- fixed values: error texts, types and codes ---
OVERSIZE_TEXT = (
    "Estimated prompt tokens (%d) exceeds max allowed per request ({max_tokens_per_request})."
)
REQUESTS_TEXT = (
    "Request rate limit exceeded. Max {max_requests_per_minute} requests "
    "per {sliding_window_seconds}s."
)
TOKENS_TEXT = (
    "Token rate limit exceeded. Projected %d tokens exceeds limit of {max_tokens_per_minute} "
    "per {sliding_window_seconds}s."
)
RATE_TYPE, BUDGET_TYPE = "rate_limit_error", "budget_exhausted_error"
RATE_CODE, BUDGET_CODE = "token_budget_exceeded", "insufficient_quota"
OVERSIZE_STATUS = 400
# --- end of fixed values ---


@dataclass(frozen=True)
class Limits:
    """Sliding-window limits per client; zero or less turns one off."""

    enabled: bool = True
    max_tokens_per_request: int = 4096
    max_requests_per_minute: int = 60
    max_tokens_per_minute: int = 100000
    sliding_window_seconds: int = 60
    reject_status_code: int = 429

    @classmethod
    def from_dict(cls, options: Mapping[str, Any]) -> Limits:
        known = cls.__dataclass_fields__
        return cls(**{k: v for k, v in options.items() if k in known})

    @property
    def window_us(self) -> int:
        return self.sliding_window_seconds * SECOND


def whole_steps(ts: Column, step: int) -> Column:
    """floor(ts / step) in integer arithmetic."""
    size = F.lit(step).cast("bigint")
    return F.call_function("div", ts - F.pmod(ts, size), size)


def is_oversize(tokens: Column, limits: Limits) -> Column:
    """Estimate above the per-request limit."""
    if not limits.enabled or limits.max_tokens_per_request <= 0:
        return F.lit(False)
    return F.coalesce(tokens > limits.max_tokens_per_request, F.lit(False))


# --------------------------------------------------------------------- admission

DECISION_FIELDS = "decision string, current_requests bigint, current_tokens bigint"


def admit_requests(
    df: DataFrame,
    limits: Limits,
    request: str = "request_id",
    client: str = "client_id",
    ts: str = "ts_us",
    tokens: str = "tokens",
    recorded: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Replay admission: only admitted requests count against later ones.

    Ties in time are taken in ``request`` order.  ``recorded`` names the tokens
    that an admitted request is settled with, if not its estimate.  Returns
    ``request, client, ts, tokens, decision, status, current_requests,
    current_tokens``; decision is ok, oversize, requests or tokens.

    The rule is recursive, but rarely has to be run: in a stretch of time where
    even all requests together stay below the limits, each is admitted.  That is
    read off per (client, window-long slot) totals.  Only runs of crowded slots
    are replayed, each run on its own, in time order, as a stream that keeps
    nothing but the entries inside the window.  A run is cut in time into parts
    of about ``rows_per_task`` rows, inside a slot too, and these are replayed in
    turn, each starting from all that the parts before left inside the window;
    so no task gets a client whole, however many rows it has.
    """
    amount = F.col(recorded) if recorded else F.col(tokens)
    narrow = df.select(
        F.col(request).alias("request"),
        F.col(client).alias("client"),
        F.col(ts).cast("bigint").alias("ts"),
        F.col(tokens).cast("bigint").alias("tokens"),
        F.coalesce(amount, F.lit(0)).cast("bigint").alias("amount"),
    )
    if not limits.enabled:
        return named(narrow.select("*", *decided("ok")), limits, request, client, ts, tokens)

    too_big = is_oversize(F.col("tokens"), limits)
    oversize = narrow.where(too_big).select("*", *decided("oversize"))
    slotted = narrow.where(~too_big).withColumn(
        "slot", whole_steps(F.col("ts"), limits.window_us)
    )
    runs = checkpointed(crowded_runs(slotted, limits))
    # a slot in no run is quiet; a run starts with the quiet slot before its
    # first crowded one, whose requests fill the window but are decided already
    placed = slotted.join(runs, ["client", "slot"], "left")
    quiet = placed.where(F.col("run").isNull() | F.col("warm_up"))
    columns = ["request", "client", "ts", "tokens", "amount"]
    crowded = placed.where(F.col("run").isNotNull()).select(*columns, "run", "warm_up")
    replayed = _replayed_in_parts(crowded, limits, rows_per_task)
    admitted = quiet.select(*columns, *decided("ok"))
    return named(
        oversize.select(*columns, "decision", "current_requests", "current_tokens")
        .unionByName(admitted)
        .unionByName(replayed.select(*columns, "decision", "current_requests", "current_tokens")),
        limits,
        request,
        client,
        ts,
        tokens,
    )


def _replayed(crowded: DataFrame, limits: Limits) -> DataFrame:
    """Decisions for rows of crowded runs, each run in one pass."""
    ordered = crowded.repartition("client", "run").sortWithinPartitions(
        "client", "run", "ts", "request"
    )
    kinds = {f.name: f.dataType.simpleString() for f in crowded.schema.fields}
    columns = ("request", "client", "ts", "tokens", "amount", "run", "warm_up")
    out_type = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", " + DECISION_FIELDS
    return ordered.select(*columns).mapInPandas(_replayer(limits), out_type)


def parts_of(crowded: DataFrame, limits: Limits, rows_per_task: int, at: str = "ts") -> DataFrame:
    """``client, run, tick, part``: the part that each tick of a run belongs to.

    A tick is a small share of the window, so there are as many as the elapsed time
    asks for, whatever the traffic.
    """
    ticks = crowded.groupBy("client", "run", tick(limits, at).alias("tick")).agg(
        F.count(F.lit(1)).alias("n")
    )
    by_tick = Window.partitionBy("client", "run").orderBy("tick")
    share = F.floor((F.sum("n").over(by_tick) - F.col("n")) / rows_per_task)
    by_share = Window.partitionBy("client", "run").orderBy("share")
    return ticks.withColumn("share", share).select(
        "client", "run", "tick", (F.dense_rank().over(by_share) - 1).alias("part")
    )


def tick(limits: Limits, at: str = "ts") -> Column:
    return whole_steps(F.col(at), tick_us(limits))


def tick_us(limits: Limits) -> int:
    return max(1, limits.window_us // TICKS)


def _replayed_in_parts(crowded: DataFrame, limits: Limits, rows_per_task: int) -> DataFrame:
    """Decisions for rows of crowded runs, part by part, all runs side by side.

    Rows and decisions go to tables in the shared folder, one folder per part,
    so that each pass reads its own rows only.  A pass hands on what is still
    inside the window: requests it admitted, and those it was handed.
    """
    spark = crowded.sparkSession
    parts = checkpointed(parts_of(crowded, limits, rows_per_task))
    last = parts.agg(F.max("part").alias("p")).first()["p"] or 0
    if last == 0:
        return _replayed(crowded, limits).where(~F.col("warm_up"))
    base = f"{shared_dir(spark)}/admission-{uuid.uuid4().hex}"
    crowded.withColumn("tick", tick(limits)).join(parts, ["client", "run", "tick"]).drop(
        "tick"
    ).write.partitionBy("part").parquet(f"{base}/rows")
    rows = spark.read.parquet(f"{base}/rows")
    starts = parts.groupBy("client", "run", "part").agg(
        (F.min("tick") * tick_us(limits)).alias("begins")
    )
    for part in range(last + 1):
        todo = rows.where(F.col("part") == part).select(*crowded.columns)
        if part:
            begin = starts.where(F.col("part") == part).drop("part")
            handed_on = (
                spark.read.parquet(f"{base}/decided/pass={part - 1}")
                .where(F.col("decision") == "ok")
                .join(begin, ["client", "run"])
                .where(F.col("ts") >= F.col("begins") - limits.window_us)
                .withColumn("warm_up", F.lit(True))
            )
            todo = todo.unionByName(handed_on.select(*todo.columns))
        _replayed(todo, limits).write.parquet(f"{base}/decided/pass={part}")
    decided = checkpointed(spark.read.parquet(f"{base}/decided").where(~F.col("warm_up")).drop("pass"))
    discard(spark, base)
    return decided


def crowded_runs(slotted: DataFrame, limits: Limits) -> DataFrame:
    """``client, slot, run, warm_up``: slots to replay, and the run each belongs to.

    A request sees at most its own slot and the one before.  If the totals of
    both are within the limits, everything in the slot is admitted for certain.
    """
    totals = slotted.groupBy("client", "slot").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("amount").alias("amount"),
        F.max("tokens").alias("biggest"),
    )
    # one row per slot from here on: bounded by elapsed time, not by traffic
    by_time = Window.partitionBy("client").orderBy("slot")
    adjacent = F.lag("slot").over(by_time) == F.col("slot") - 1
    n = F.col("n") + F.when(adjacent, F.lag("n").over(by_time)).otherwise(0)
    amount = F.col("amount") + F.when(adjacent, F.lag("amount").over(by_time)).otherwise(0)
    crowded = F.lit(False)
    if limits.max_requests_per_minute > 0:
        crowded = crowded | (n > limits.max_requests_per_minute)
    if limits.max_tokens_per_minute > 0:
        # what others recorded plus the largest estimate bounds every projection
        crowded = crowded | (amount + F.col("biggest") > limits.max_tokens_per_minute)
    flagged = totals.select("client", "slot", "n", crowded.alias("crowded"))
    return (
        flagged.withColumn("next_slot", F.lead("slot").over(by_time))
        .withColumn("next_crowded", F.lead("crowded").over(by_time))
        .withColumn(
            "warm_up",
            ~F.col("crowded")
            & F.coalesce(F.col("next_crowded") & (F.col("next_slot") == F.col("slot") + 1), F.lit(False)),
        )
        .where(F.col("crowded") | F.col("warm_up"))
        .withColumn(
            "starts",
            F.col("warm_up")
            | F.coalesce(F.lag("slot").over(by_time) != F.col("slot") - 1, F.lit(True)),
        )
        .withColumn(
            "run",
            F.max(F.when(F.col("starts"), F.col("slot"))).over(
                by_time.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .select("client", "slot", "run", "warm_up")
    )


def decided(decision: str) -> list[Column]:
    unknown = F.lit(None).cast("bigint")
    return [
        F.lit(decision).alias("decision"),
        unknown.alias("current_requests"),
        unknown.alias("current_tokens"),
    ]


def named(
    decided: DataFrame, limits: Limits, request: str, client: str, ts: str, tokens: str
) -> DataFrame:
    status = (
        F.when(F.col("decision") == "ok", 200)
        .when(F.col("decision") == "oversize", OVERSIZE_STATUS)
        .otherwise(limits.reject_status_code)
    )
    return decided.select(
        F.col("request").alias(request),
        F.col("client").alias(client),
        F.col("ts").alias(ts),
        F.col("tokens").alias(tokens),
        "decision",
        status.alias("status"),
        "current_requests",
        "current_tokens",
    )


class WindowState:
    """Admitted entries of one client that may still be inside the window."""

    __slots__ = ("times", "amounts", "head", "total")

    def __init__(self, times: Sequence[int] = (), amounts: Sequence[int] = ()) -> None:
        self.times, self.amounts = list(times), list(amounts)
        self.head, self.total = 0, sum(amounts)

    def expire(self, cutoff: int) -> None:
        times, head = self.times, self.head
        while head < len(times) and times[head] < cutoff:
            self.total -= self.amounts[head]
            head += 1
        if head > 4096 and head * 2 > len(times):
            del times[:head], self.amounts[:head]
            head = 0
        self.head = head

    def record(self, ts: int, amount: int) -> None:
        self.times.append(ts)
        self.amounts.append(amount)
        self.total += amount

    def __len__(self) -> int:
        return len(self.times) - self.head


def replay(
    ts: list[int],
    tokens: list[int],
    amounts: list[int],
    limits: Limits,
    state: WindowState,
    decision: list,
    requests: list,
    used: list,
    start: int,
    end: int,
) -> None:
    """Decide requests ``start`` to ``end`` in time order, continuing from ``state``.

    Writes into the three output lists.  While the request limit is hit, nothing
    changes before the oldest entry expires, so all requests up to then are
    turned down in one step.
    """
    most, budget, window = (
        limits.max_requests_per_minute,
        limits.max_tokens_per_minute,
        limits.window_us,
    )
    i = start
    while i < end:
        now = ts[i]
        state.expire(now - window)
        count, total = len(state), state.total
        if 0 < most <= count:
            until = bisect_right(ts, state.times[state.head] + window, i + 1, end)
            n = until - i
            decision[i:until] = ["requests"] * n
            requests[i:until] = [count] * n
            used[i:until] = [total] * n
            i = until
            continue
        requests[i], used[i] = count, total
        if budget > 0 and total + tokens[i] > budget:
            decision[i] = "tokens"
        else:
            state.record(now, amounts[i])
        i += 1


def _replayer(limits: Limits):
    """Replay sorted partitions batch by batch; a run may span many batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current = WindowState(), None
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            client, run_id = batch["client"].to_numpy(), batch["run"].to_numpy()
            ts, tokens = batch["ts"].tolist(), batch["tokens"].tolist()
            amounts, warm = batch["amount"].tolist(), batch["warm_up"].to_numpy(dtype=bool)
            changes = (client[1:] != client[:-1]) | (run_id[1:] != run_id[:-1])
            edges = [0, *(np.flatnonzero(changes) + 1).tolist(), n]
            decision, requests, used = ["ok"] * n, [0] * n, [0] * n
            for a, b in zip(edges, edges[1:]):
                if current != (client[a], run_id[a]):
                    state, current = WindowState(), (client[a], run_id[a])
                # decided elsewhere: the quiet slot before a run, or what a part
                # left over; such rows come first in time
                while a < b and warm[a]:
                    state.record(ts[a], amounts[a])
                    a += 1
                replay(ts, tokens, amounts, limits, state, decision, requests, used, a, b)
            yield batch.assign(decision=decision, current_requests=requests, current_tokens=used)

    return run


def rejection_detail(
    decision: Column, tokens: Column, requests: Column, used: Column, limits: Limits
) -> Column:
    """The error report of a rejected request as a struct; null if admitted."""
    seconds = limits.sliding_window_seconds
    oversize, requests_hit, tokens_hit = (
        text.format(**vars(limits)) for text in (OVERSIZE_TEXT, REQUESTS_TEXT, TOKENS_TEXT)
    )
    projected = F.coalesce(used, F.lit(0)) + tokens
    message = (
        F.when(decision == "oversize", F.format_string(oversize, tokens))
        .when(decision == "requests", requests_hit)
        .otherwise(F.format_string(tokens_hit, projected))
    )
    rate = (decision != "oversize") & F.lit(limits.reject_status_code == 429)
    limit = F.when(decision == "requests", limits.max_requests_per_minute).otherwise(
        limits.max_tokens_per_minute
    )
    details = F.struct(
        F.when(decision != "requests", tokens).alias("estimated_tokens"),
        F.when(decision == "requests", requests).alias("current_requests"),
        F.when(decision == "tokens", used).alias("current_tokens"),
        F.when(decision == "oversize", F.lit(limits.max_tokens_per_request).cast("bigint")).alias(
            "max_tokens_per_request"
        ),
        F.when(decision != "oversize", limit.cast("bigint")).alias("limit"),
        F.when(decision != "oversize", F.lit(seconds)).alias("window_seconds"),
    )
    return F.when(
        decision != "ok",
        F.struct(
            message.alias("message"),
            F.when(rate, RATE_TYPE).otherwise(BUDGET_TYPE).alias("type"),
            F.when(rate, RATE_CODE).otherwise(BUDGET_CODE).alias("code"),
            details.alias("details"),
        ),
    )


# ------------------------------------------------------------------------- usage


def window_usage(
    df: DataFrame,
    seconds: int,
    keys: Sequence[str] = ("request_id",),
    client: str = "client_id",
    ts: str = "ts_us",
    tokens: str = "tokens",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Requests and tokens of the last ``seconds`` at each row, and since the start.

    The window is closed at both ends, and rows of the same instant see each
    other.  Each row counts +1 at its time and -1 just after it leaves the
    window, which turns the sliding window into a running sum; running sums
    split over time buckets, so a client with most of the rows spreads over many
    tasks whatever the window's length: a bucket is ``bucket_seconds`` wide.
    """
    width = bucket_seconds * SECOND
    base = df.select(
        *keys,
        F.col(client).alias("_client"),
        F.col(ts).cast("bigint").alias("_ts"),
        F.col(tokens).cast("bigint").alias("_tokens"),
    )
    enter = base.select(
        *keys,
        "_client",
        F.col("_ts").alias("_at"),
        F.lit(0).alias("_kind"),
        F.lit(1).cast("bigint").alias("_n"),
        F.col("_tokens").alias("_t"),
        F.lit(1).cast("bigint").alias("_life_n"),
        F.col("_tokens").alias("_life_t"),
    )
    zero = F.lit(0).cast("bigint")
    leave = base.select(
        *[F.lit(None).cast(base.schema[k].dataType).alias(k) for k in keys],
        "_client",
        (F.col("_ts") + seconds * SECOND).alias("_at"),
        F.lit(1).alias("_kind"),
        F.lit(-1).cast("bigint").alias("_n"),
        (-F.col("_tokens")).alias("_t"),
        zero.alias("_life_n"),
        zero.alias("_life_t"),
    )
    moves = enter.unionByName(leave).withColumn("_bucket", whole_steps(F.col("_at"), width))
    sums = ("_n", "_t", "_life_n", "_life_t")
    totals = moves.groupBy("_client", "_bucket").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy("_client").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = totals.select(
        "_client",
        "_bucket",
        *[F.coalesce(F.sum(c).over(earlier), zero).alias(f"{c}_before") for c in sums],
    )
    so_far = (
        Window.partitionBy("_client", "_bucket")
        .orderBy("_at", "_kind")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = moves.select(
        *keys, "_client", "_bucket", "_at", "_kind", *[F.sum(c).over(so_far).alias(c) for c in sums]
    ).where(F.col("_kind") == 0)
    named = {
        "_n": "window_requests",
        "_t": "window_tokens",
        "_life_n": "lifetime_requests",
        "_life_t": "lifetime_tokens",
    }
    return running.join(before, ["_client", "_bucket"]).select(
        *keys,
        F.col("_client").alias(client),
        F.col("_at").alias(ts),
        *[(F.col(c) + F.col(f"{c}_before")).alias(n) for c, n in named.items()],
    )


def usage_at(
    df: DataFrame,
    now_us: int,
    seconds: int,
    client: str = "client_id",
    ts: str = "ts_us",
    tokens: str = "tokens",
) -> DataFrame:
    """Every client's current window and lifetime use at one instant."""
    inside = F.col(ts) >= now_us - seconds * SECOND  # plain comparisons reach the scan
    zero = F.lit(0).cast("bigint")
    return (
        df.where(F.col(ts) <= now_us)
        .groupBy(client)
        .agg(
            F.count_if(inside).alias("window_requests"),
            F.coalesce(F.sum(F.when(inside, F.col(tokens))), zero).alias("window_tokens"),
            F.count(F.lit(1)).alias("lifetime_requests"),
            F.coalesce(F.sum(tokens), zero).alias("lifetime_tokens"),
        )
    )


def client_totals(df: DataFrame, client: str = "client_id", tokens: str = "tokens") -> DataFrame:
    """Requests and tokens per client since the start."""
    return df.groupBy(client).agg(
        F.count(F.lit(1)).alias("lifetime_requests"),
        F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("lifetime_tokens"),
    )


def settle_usage(
    requests: DataFrame,
    replies: DataFrame,
    key: str = "request_id",
    estimate: str = "tokens",
    total: str = "total_tokens",
    chunks: str | None = None,
) -> DataFrame:
    """Tokens to record per request that was answered.

    ``replies`` holds the answered requests, one row each.  Reported usage wins;
    without it a positive estimate is recorded, and with neither nothing is.
    ``chunks`` names the number of content chunks of a streamed reply: such a
    request is settled at its estimate plus the chunks.
    """
    columns = [key, total] + ([chunks] if chunks else [])
    answered = requests.join(as_long(replies.select(*columns)), key)
    fallback = F.when(F.col(estimate) > 0, F.col(estimate))
    amount = F.coalesce(F.col(total), fallback)
    if chunks:
        amount = F.when(
            F.col(chunks).isNotNull(), F.coalesce(F.col(estimate), F.lit(0)) + F.col(chunks)
        ).otherwise(amount)
    return answered.withColumn("settled_tokens", amount.cast("bigint")).where(
        F.col("settled_tokens").isNotNull()
    )
