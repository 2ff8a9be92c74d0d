"""The download queue over the events: a reader is a site, an event a job. The queue is a fold that SQL can't express; tests hold it against a simulation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.links import shared_dir
from ..sources.tables import table
from ..streaming import days, downloads


def r5_download_attempts(spark, d):
    """Attempts of each reader's jobs as far as the watermark has come; a job takes hours, so that jobs meet."""
    out = f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}"
    e = days.session_stream(spark, d, table(spark, d, "events").schema, "events.parquet")
    kind = F.when(F.col("event_id") % 11 == 0, "limit").when(F.col("event_id") % 13 == 0, "reader").otherwise("plain")
    jobs = e.select(F.col("user_id").cast("string").alias("site"), F.col("event_id").alias("job"), F.col("event_type").alias("book"), "ts", (F.col("event_id") % 40 * 600).cast("double").alias("lasts"), F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 6).otherwise(0).alias("fails"), kind.alias("kind"), F.lit(7200.0).alias("retry"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, downloads.STATE_STORE)  # timers need it
    try:
        days.to_table(downloads.attempts(jobs, pace=600.0, backoff=60.0), f"{out}/rows", f"{out}/checkpoint")
    finally:
        spark.conf.set(key, before)
    rows = spark.read.schema(downloads.ATTEMPTS).parquet(f"{out}/rows")
    return rows.select(F.col("site").cast("long").alias("user_id"), F.col("job").alias("event_id"), "tried", F.round("started", 3).alias("started"), F.round("ended", 3).alias("ended"), "outcome")


QUERIES = {"r5_download_attempts": r5_download_attempts}
ORACLE_SQL: dict[str, str] = {}
