"""Session settings the operators rely on, and where they may cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "veilwork", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster job brings its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings: UTC, adaptive plans with skew splitting, Python-like JSON keys."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",  # the last one wins
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": "4m",  # of what a Python worker holds at a time
    }.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veilwork-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that no later loss redoes it."""
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` computed once, as a table in the shared folder: of wide rows a small part of what a checkpoint takes."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def as_long(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that grows with the other one: both are sorted, neither is broadcast.

    The optimizer knows a side by the size of the files it comes from. Files of few distinct values are a hundredth of
    their rows, so it would send millions of texts through the driver.
    """
    return df.hint("merge")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables once nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
