"""Places of rows in an order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .links import written

_LOW = (1 << 33) - 1  # of monotonically_increasing_id: the row in its partition; above it the partition


def with_places(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place from 1. Sorted by ranges; a partition's rows are counted, and its places begin after those of the partitions before."""
    at = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    sizes = at.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = at.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, (F.col("_before") + F.col("_at").bitwiseAND(F.lit(_LOW)) + 1).cast("int")).drop("_at", "_part", "_before")
