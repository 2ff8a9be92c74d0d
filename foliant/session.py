"""A session with the settings that the operators expect, and what else they set: sizes of batches and numbers of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution, ANSI arithmetic. On a cluster, master and partitions come from its own configuration."""
    builder = SparkSession.builder.appName("foliant")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true"}
    for key, value in (fixed | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows of an Arrow batch; texts are long, so Spark's default of 10,000 would hold tens of MB in each worker.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """BATCH_ROWS from now on, where the session still has Spark's default."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


#: Rows whose work in Python makes a task, about.
ROWS_A_TASK = 50_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in a task a core, or more, by its rows: small rows lie in few files, and by their bytes would be the work of few tasks."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
    return df.repartition(tasks, *keys)
