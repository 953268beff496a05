"""Counters over an outcome log.

An outcome is one finished request: ``outcome`` (success, failed, blocked),
``prompt_tokens, completion_tokens`` (successes), ``repaired, violation``,
``duration_ms`` and what was masked.  Each event counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---
LATENCY_ROWS = 1000
PERCENTILES = {"p50": 0.50, "p90": 0.90, "p99": 0.99}
# --- end of fixed values ---


def request_counts() -> list[Column]:
    outcome = F.col("outcome")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(outcome == "success").alias("successful"),
        F.count_if(outcome != "success").alias("failed"),
        F.count_if(outcome == "blocked").alias("blocked_rate_limit"),
    ]


def schema_totals() -> list[Column]:
    return [
        F.count_if(F.col("repaired")).alias("schema_repairs"),
        F.count_if(F.col("violation")).alias("schema_violations"),
    ]


def token_totals() -> list[Column]:
    """Usage of successes: reported prompt tokens or the estimate, and completion tokens."""
    success = F.col("outcome") == "success"
    zero = F.lit(0).cast("bigint")
    prompt = F.coalesce(F.col("prompt_tokens"), F.col("estimated_tokens"), zero)
    completion = F.coalesce(F.col("completion_tokens"), zero)

    def total(amount: Column) -> Column:
        return F.coalesce(F.sum(F.when(success, amount)), zero).cast("bigint")

    return [
        total(prompt).alias("prompt_total"),
        total(completion).alias("completion_total"),
        total(prompt + completion).alias("overall_total"),
    ]


def redaction_totals(counts: DataFrame, category: str = "category", n: str = "n_values") -> DataFrame:
    """Masked values per category, and over all as category null."""
    return counts.rollup(category).agg(F.sum(n).cast("bigint").alias("n_redactions"))


def latency_stats(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Over the last 1000 successes by ``order``: count, average and percentiles.

    Percentile p is the sorted value at floor(count * p), counted from 0.
    """
    last = (
        df.where(F.col("outcome") == "success")
        .select(*order, "duration_ms")
        .orderBy(*[F.desc(c) for c in order])
        .limit(LATENCY_ROWS)
    )
    values = last.agg(F.sort_array(F.collect_list("duration_ms")).alias("v"))
    n = F.size("v")
    zero = F.lit(0.0)
    total = F.aggregate("v", zero, lambda a, x: a + x)

    def at(p: float) -> Column:
        return F.coalesce(F.round(F.get(F.col("v"), F.floor(n * p).cast("int")), 2), zero)

    return values.select(
        n.cast("bigint").alias("latency_count"),
        F.when(n > 0, F.round(total / n, 2)).otherwise(zero).alias("latency_average"),
        *[at(p).alias(f"latency_{name}") for name, p in PERCENTILES.items()],
    )


def metrics_summary(
    outcomes: DataFrame, order: Sequence[str], redactions: DataFrame | None = None
) -> DataFrame:
    """The whole summary in one row."""
    counts = outcomes.agg(*request_counts(), *schema_totals(), *token_totals())
    return summary_of(counts, outcomes.where("outcome = 'success'"), order, redactions)


def summary_of(
    counts: DataFrame, successes: DataFrame, order: Sequence[str], redactions: DataFrame | None = None
) -> DataFrame:
    """The summary from a row of counters, the latencies of successes and the masked values per category."""
    one = counts.withColumn("_one", F.lit(1))
    latencies = latency_stats(successes.withColumn("outcome", F.lit("success")), order)
    one = one.join(latencies.withColumn("_one", F.lit(1)), "_one")
    if redactions is not None:
        masked = redactions.groupBy("category").agg(F.sum("n_values").cast("bigint").alias("n"))
        masked = masked.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("pii_redactions_total"),
            F.map_from_entries(
                F.sort_array(F.collect_list(F.struct("category", "n")))
            ).alias("pii_redactions_by_type"),
        )
        one = one.join(masked.withColumn("_one", F.lit(1)), "_one")
    return one.drop("_one")


def summary_json(summary: DataFrame) -> DataFrame:
    """The summary row as the nested JSON document of a metrics endpoint."""
    has_masked = "pii_redactions_total" in summary.columns
    masked = ["pii_redactions_total", "pii_redactions_by_type"] if has_masked else []
    return summary.select(
        F.to_json(
            F.struct(
                F.struct("total", "successful", "failed", "blocked_rate_limit").alias("requests"),
                F.struct(*masked, "schema_repairs", "schema_violations").alias("safeguards"),
                F.struct("prompt_total", "completion_total", "overall_total").alias("tokens"),
                F.struct(
                    F.col("latency_count").alias("count"),
                    F.col("latency_average").alias("average"),
                    *[F.col(f"latency_{p}").alias(p) for p in PERCENTILES],
                ).alias("latency_ms"),
            )
        ).alias("metrics")
    )


def redaction_counts(outcomes: DataFrame) -> DataFrame:
    """``category, n_values`` over the ``redactions`` of an outcome log."""
    return outcomes.select(F.explode("redactions").alias("category", "n")).groupBy("category").agg(F.sum("n").cast("bigint").alias("n_values"))


def write_outcomes(outcomes: DataFrame, path: str, batch: int | str) -> None:
    """Write a batch of outcomes to a parquet table, once: the same ``batch`` written again takes its own place."""
    outcomes.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def outcome_sink(path: str):
    """For ``foreachBatch``: a micro-batch that is retried after a failure adds no row."""
    return lambda outcomes, batch: write_outcomes(outcomes, path, batch)
