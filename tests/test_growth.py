"""What keeps queries whole on large tables: how their plans join and how their inputs are dealt."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilwork.catalog import base, queries
from veilwork.operators import sessions
from veilwork.plans import streamed
from veilwork.rules import ScrubRules
from veilwork.session import shared_dir
from veilwork.sources import sse

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["repair_requests", "guard_short_requests", "retry_error_bodies"])
def test_sides_that_grow_are_not_broadcast(spark, name):
    # however small the files are: their rows may be a hundred times as large
    plan = plan_of(queries()[name](spark, SMALL))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_large_tables_of_one_row_group_are_dealt(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "documents.parquet")
    spark.range(4000).selectExpr("id AS doc_id", "'a text ' || id AS text").coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    monkeypatch.setattr(base, "SMALL_BYTES", 1000)  # it is beyond that
    dealt = base.spread(one)
    assert dealt.groupBy(F.spark_partition_id()).count().count() >= spark.sparkContext.defaultParallelism
    assert dealt.exceptAll(one).isEmpty() and dealt.count() == 4000
    # one that has splits enough is left as it is scanned
    one.repartition(4 * spark.sparkContext.defaultParallelism).write.parquet(path + "2")
    even = spark.read.parquet(path + "2")
    assert base.spread(even) is even


def test_sessions_are_scanned_once(spark):
    turns = spark.createDataFrame(
        [(1, 0, "mail a@b.io"), (1, 1, "nothing here"), (1, 2, None), (1, 2, "a@b.io again")], "session_id int, turn int, text string"
    )
    masked, _ = sessions.mask_sessions(turns)
    assert plan_of(masked).count("RLIKE") == 0  # what was found is read, not looked for again
    rows = sorted((tuple(r) for r in masked.collect()), key=str)
    assert rows == [(1, 0, "mail [EMAIL_1]"), (1, 1, "nothing here"), (1, 2, "[EMAIL_1] again"), (1, 2, None)]


def test_payloads_are_parsed_once(spark):
    lines = spark.range(3).selectExpr("id AS stream_id", "id AS seq", "concat('data: {\"choices\": [{\"text\": \"', id, '\"}]}') AS line")
    parsed = sse.parse_sse_lines(lines)
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [r["piece"] for r in parsed.orderBy("seq").collect()] == ["0", "1", "2"]


def test_lines_are_kept_once(spark):
    lines = spark.createDataFrame(
        [(1, 0, 'data: {"choices": [{"delta": {"content": "to a@b.io now"}}]}'), (1, 1, "data: [DONE]"), (1, 2, "data: late")],
        "stream_id int, seq bigint, line string",
    )
    rules = ScrubRules(reversible=False)
    out = streamed.streamed_replies(lines, rules)
    assert [r["kind"] for r in out.orderBy("seq").collect()] == ["piece", "done"]
    assert "to [EMAIL_1] now" in "".join(r["out"] for r in out.collect())
    kept = {p.name for p in Path(shared_dir(spark).removeprefix("file:")).glob("table-*")}
    assert kept and all("payload" not in spark.read.parquet(f"{shared_dir(spark)}/{p}").columns for p in kept)
