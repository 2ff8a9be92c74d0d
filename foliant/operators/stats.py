"""Reading statistics: day totals, goals, streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.days import day_key


def day_totals(sessions: DataFrame, who: str, ts: str, amount: str) -> DataFrame:
    """who, day, total, sessions: a row a reader and day."""
    return sessions.groupBy(who, day_key(F.col(ts)).alias("day")).agg(F.round(F.sum(amount), 6).alias("total"), F.count("*").alias("sessions"))


def streaks(days: DataFrame, who: str, goal: float, today) -> DataFrame:
    """who, current, best: days in a row on which the total met the goal.

    The current streak ends today; a goal not yet met today doesn't break it. Readers who
    never met the goal have no row.
    """
    met = days.filter(F.col("total") >= goal).select(who, "day")
    island = met.withColumn("island", F.date_sub("day", F.row_number().over(Window.partitionBy(who).orderBy("day"))))
    runs = island.groupBy(who, "island").agg(F.max("day").alias("last"), F.count("*").alias("run"))
    alive = F.col("last") >= F.date_sub(F.lit(today).cast("date"), 1)
    until_today = F.col("last") <= F.lit(today).cast("date")
    return runs.groupBy(who).agg(F.max(F.when(alive & until_today, F.col("run")).otherwise(0)).alias("current"), F.max("run").alias("best"))


def last_days(days: DataFrame, n: int, today) -> DataFrame:
    """day, total of each of the last n days, 0 for a day without any."""
    end = F.lit(today).cast("date")
    calendar = days.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, n - 1), end)).alias("day"))
    sums = days.groupBy("day").agg(F.round(F.sum("total"), 6).alias("total"))
    return calendar.join(sums, "day", "left").select("day", F.coalesce("total", F.lit(0.0)).alias("total"))


def kept_days(days: DataFrame, who: str, keep: int = 30) -> DataFrame:
    """The newest `keep` days of each reader."""
    rank = F.dense_rank().over(Window.partitionBy(who).orderBy(F.desc("day")))
    return days.withColumn("r", rank).filter(F.col("r") <= keep).drop("r")


def map_totals(days: DataFrame, key: str, figures: str) -> DataFrame:
    """key -> sum over all days of a map column's figures, a row a key."""
    return days.select(F.explode(figures).alias(key, "value")).groupBy(key).agg(F.round(F.sum("value"), 6).alias("total"))
