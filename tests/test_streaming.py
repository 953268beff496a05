from __future__ import annotations

import random

import plain
from pyspark.sql import functions as F

from veilwork.operators import budgets, telemetry
from veilwork.operators.budgets import SECOND, Limits
from veilwork.rules import ScrubRules
from veilwork.streaming import chunks, online


def as_stream(spark, df, path, batches, order):
    """Write ``df`` in order as several files, read back one file per micro-batch."""
    rows = df.orderBy(*order).collect()
    size = -(-len(rows) // batches)
    for k in range(batches):
        part = spark.createDataFrame(rows[k * size : (k + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def pieces(spark, texts, size):
    rows = []
    for stream, text in enumerate(texts):
        cut = [text[i : i + size] for i in range(0, len(text), size)]
        rows += [(stream, i, p, False) for i, p in enumerate(cut)]
        rows.append((stream, len(cut), None, True))
    return spark.createDataFrame(rows, "stream_id long, seq long, piece string, is_done boolean")


def put_together(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.stream_id, r.seq)):
        out[r.stream_id] = out.get(r.stream_id, "") + r.safe
    return out


def test_value_split_over_pieces():
    masker = chunks.ChunkMasker(ScrubRules(), buffer=10)
    out = [masker.push(p) for p in ("Rota: kim", ".vale@ward-7.exa", "mple.net", " swaps Tuesday")]
    text = "".join(out) + masker.flush()
    assert text == "Rota: [EMAIL_1] swaps Tuesday"


def test_long_run_is_cut_by_force():
    masker = chunks.ChunkMasker(ScrubRules(), buffer=10)
    assert masker.push("x" * 40) == ""
    assert masker.push("x") == "x" * 31
    assert masker.flush() == "x" * 10


def test_pieces_in_batch_and_stream_equal_the_whole(spark, tmp_path):
    rng = random.Random(4)
    words = ["a@b.co", "c.d@e.org", "10.1.2.3", "word", "é", "x,", "\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) for _ in range(40)]
    df = pieces(spark, texts, 17)
    rules = ScrubRules()
    batch = put_together(chunks.mask_chunks(df, rules).collect())
    assert batch == {i: plain.mask_session([t], rules)[0][0] for i, t in enumerate(texts)}
    stream = as_stream(spark, df, str(tmp_path / "in"), 3, ["seq", "stream_id"])
    done = online.run_available(chunks.stream_mask_chunks(stream, rules))
    assert put_together(done.collect()) == batch


def test_online_admission_equals_replay(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 0, 1, 2]), i * SECOND, rng.randint(0, 70)) for i in range(600)]
    df = spark.createDataFrame(rows, "request_id long, client_id long, ts_us long, tokens long")
    limits = Limits(60, 8, 200, 60)
    stream = as_stream(spark, df, str(tmp_path / "in"), 3, ["ts_us"])
    online_rows = online.run_available(online.stream_admit(stream, limits)).collect()
    replayed = budgets.admit_requests(df, limits).collect()
    assert {r.request_id: r.decision for r in online_rows} == {r.request_id: r.decision for r in replayed}


def test_out_of_order_equals_replay(spark, tmp_path):
    """Rows up to half a minute out of order over micro-batches; a last row of another client lets time pass."""
    rng = random.Random(18)
    rows = [(i, rng.choice([0, 0, 1, 2]), (1_000_000 + i) * SECOND, rng.randint(0, 70)) for i in range(500)]
    arrival = sorted(rows, key=lambda r: r[2] + rng.randrange(30) * SECOND)
    rows_in = [(*r, n) for n, r in enumerate([*arrival, (1000, 9, 2_000_000 * SECOND, 1)])]
    df = spark.createDataFrame(rows_in, "request_id long, client_id long, ts_us long, tokens long, came long")
    limits = Limits(60, 8, 200, 60)
    stream = as_stream(spark, df, str(tmp_path / "in"), 4, ["came"]).drop("came")
    got = online.run_available(online.stream_admit_in_order(stream, limits, "2 minutes")).collect()
    replayed = budgets.admit_requests(df.where("client_id < 9").drop("came"), limits).collect()
    assert {r.request_id: (r.decision, r.status) for r in got} == {r.request_id: (r.decision, r.status) for r in replayed}
    assert len(got) == len(rows)


def test_rows_behind_a_decision_are_late(spark, tmp_path):
    rows = [(0, 1, 100 * SECOND, 1), (1, 1, 50 * SECOND, 1), (2, 1, 101 * SECOND, 1)]
    df = spark.createDataFrame(rows, "request_id long, client_id long, ts_us long, tokens long")
    stream = as_stream(spark, df, str(tmp_path / "in"), 3, ["request_id"])
    got = online.run_available(online.stream_admit(stream, Limits(max_requests_per_minute=2))).collect()
    assert {r.request_id: r.decision for r in got} == {0: "ok", 1: "late", 2: "ok"}


def test_windows_and_metrics(spark, tmp_path):
    rows = [(i, i % 2, i) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, client_id long, tokens long").withColumn(
        "ts", F.timestamp_seconds("seq")
    )
    stream = as_stream(spark, df, str(tmp_path / "in"), 2, ["seq"])
    usage = online.run_available(online.stream_window_usage(stream, 60, 10, "10 seconds"))
    got = {(r.client_id, r.window_start_us // SECOND): (r.window_requests, r.window_tokens) for r in usage.collect()}
    for (client, start), value in got.items():
        inside = [t for s, c, t in rows if c == client and start <= s < start + 60]
        assert value == (len(inside), sum(inside))
    assert max(start for _, start in got) == 220
    whole = online.run_to_the_end(online.stream_window_usage(stream, 60, 10, "10 seconds"), ["client_id", "window_start_us"])
    ended = {(r.client_id, r.window_start_us // SECOND): (r.window_requests, r.window_tokens) for r in whole.collect()}
    assert got.items() <= ended.items() and sum(n for n, _ in ended.values()) == 6 * len(rows)
    outcomes = stream.select(
        "ts",
        F.when(F.col("seq") % 3 == 0, "blocked").otherwise("success").alias("outcome"),
        F.lit(None).cast("long").alias("prompt_tokens"),
        F.col("tokens").alias("estimated_tokens"),
        F.lit(1).cast("long").alias("completion_tokens"),
        F.lit(True).alias("repaired"),
        F.lit(False).alias("violation"),
    )
    metrics = online.run_available(online.stream_metrics(outcomes, "1 minute", "10 seconds")).collect()
    assert [(r.total, r.blocked_rate_limit, r.completion_total) for r in metrics] == [(60, 20, 40)] * 4


def test_whole_messages(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.co a@b.co"), (2, "")], "id long, text string")
    stream = as_stream(spark, df, str(tmp_path / "in"), 2, ["id"])
    got = online.run_available(online.stream_mask(stream)).collect()
    assert {r.id: r.masked for r in got} == {1: "[EMAIL_1] [EMAIL_1]", 2: ""}


def test_running_summary_equals_the_whole(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (i, rng.choice(["success", "success", "failed", "blocked"]), rng.random() * 900, None, i % 50, i % 7, i % 5 == 0, i % 9 == 0,
         rng.choice([None, {}, {"ssn": 2, "ipv4": i % 3}]))
        for i in range(2500)
    ]
    kind = (
        "seq long, outcome string, duration_ms double, prompt_tokens long, estimated_tokens long, completion_tokens long, "
        "repaired boolean, violation boolean, redactions map<string,bigint>"
    )
    df = spark.createDataFrame(rows, kind)
    whole = telemetry.metrics_summary(df, ["seq"], telemetry.redaction_counts(df)).first()
    assert whole.latency_count == 1000 and whole.pii_redactions_total > 0
    stream = as_stream(spark, df, str(tmp_path / "in"), 4, ["seq"])
    assert online.stream_summary(stream, ["seq"]).first().asDict() == whole.asDict()
    running = online.RunningSummary(str(tmp_path / "again"), ["seq"])
    for batch in (0, 1, 1, 2):  # the second comes twice
        running.add(df.where(f"seq % 3 = {batch}"), batch)
    assert running.summary(spark, 2).first().asDict() == whole.asDict()
