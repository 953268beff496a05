"""Time the headline queries; print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is run once to warm up and once on the clock, into a sink that
computes every row and column and keeps none.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veilwork import catalog  # noqa: E402
from veilwork.session import build_session  # noqa: E402

# query -> table whose rows it works through
HEADLINE = {
    "mask_documents": "documents",
    "mask_seeded": "documents",
    "detect_entities": "documents",
    "mask_sessions": "documents",
    "unmask_roundtrip": "documents",
    "doc_tokens": "documents",
    "redaction_report": "documents",
    "admit_events": "events",
    "admit_orders": "orders",
    "window_usage": "events",
    "settle_usage": "events",
    "parse_or_repair": "events",
    "enforce_outcomes": "events",
    "retry_join": "events",
    "validate_nested": "part",
    "metrics_summary": "events",
    "guard_short_requests": "events",
    "guard_requests": "documents",
    "guard_replies": "documents",
    "parse_sse": "documents",
    "chunk_mask": "documents",
    "stream_admit": "events",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("veilwork-bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in set(HEADLINE.values())}
    seconds, per_second = {}, {}
    for name, table in HEADLINE.items():
        run(name)
        seconds[name] = round(run(name), 3)
        per_second[name] = round(rows[table] / seconds[name])
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": per_second,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
