"""The pipeline's stages on a table with odd rows, and the registry."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from veilwork import llm

SF_DIR = os.environ.get("VEILWORK_SF_DIR", "/root/testdata/sf0.001")
has_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "near_duplicates", "benchmark_decontamination", "best_fit_packing",
    ]
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 14))


@has_tables
def test_stages_keep_columns_and_clean_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (7, "12 34", "en", "s", 1)], docs.schema)
    docs.union(extra).write.parquet(str(tmp_path / "in"))
    read = spark.read.parquet(str(tmp_path / "in"))
    counts = [read.count()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, read, SF_DIR)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name))
        counts.append(read.count())
    assert counts[1] == counts[0] - 2  # no text, no letter
    assert counts[0] > counts[2] >= counts[3] > counts[4] > 0.5 * counts[0]
    packed = read.groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 2048 for r in packed)


@has_tables
def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 100
