"""Reading statistics from a stream of sessions.

Day totals follow an event-time window that begins at four in the morning, under a watermark, so
that the state of closed days goes. Repeats of an event are dropped within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.days import DAY_STARTS_AT


def session_stream(spark: SparkSession, folder: str, schema, pattern: str = "*") -> DataFrame:
    """Parquet files of a folder as they come; ts as a timestamp with zone, which watermarks need."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "2 days") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def day_totals(stream: DataFrame, who: str, amount: str, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """who, day, total, sessions by days from four to four."""
    by_day = F.window(ts, "1 day", startTime=f"{DAY_STARTS_AT} hours")
    sums = stream.withWatermark(ts, late).groupBy(who, by_day.alias("w")).agg(F.round(F.sum(amount), 6).alias("total"), F.count("*").alias("sessions"))
    return sums.select(who, F.to_date("w.start").alias("day"), "total", "sessions")


def session_windows(stream: DataFrame, who: str, gap: str = "30 minutes", ts: str = "ts", late: str = "2 days") -> DataFrame:
    """who, start, end, events: stretches of a reader's events with no longer gap (an addition, not in the survey's reference)."""
    found = stream.withWatermark(ts, late).groupBy(who, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"))
    return found.select(who, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs what is there into a Parquet table and ends; may be run again for what comes later."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def upserts(stream: DataFrame, keys: list[str], order: str, path: str, checkpoint: str) -> None:
    """A change log by batch: each batch's newest row of a key, with the batch's number; `latest` reads it."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def changes(stream: DataFrame, path: str, checkpoint: str) -> None:
    """A change log of an aggregate: each batch's changed rows, with the batch's number; `latest` reads it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """A row a key of an upsert log. Batches may be written again without harm."""
    log = spark.read.parquet(path)
    columns = [c for c in log.columns if c != "batch"]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(order, "batch")).alias("r")).select("r.*")
