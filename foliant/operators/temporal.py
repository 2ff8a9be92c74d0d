"""Facts that hold for a while: half-open intervals [since, until), null until for what still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fact_intervals(statements: DataFrame, keys: list[str], value: str, at: str, tie: str) -> DataFrame:
    """keys, value, since, until: a statement that repeats the value before it is dropped, another ends it.

    Derived from all statements at once, so late ones fall into their places. tie orders statements of one time.
    """
    by_time = Window.partitionBy(*keys).orderBy(at, tie)
    before = F.lag(value).over(by_time)
    changes = statements.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col(value)))
    until = F.lead(at).over(by_time)
    return changes.select(*keys, F.col(value), F.col(at).alias("since"), until.alias("until"))


def valid_at(t: Column, since: str = "since", until: str = "until") -> Column:
    return (F.col(since) <= t) & (F.col(until).isNull() | (F.col(until) > t))


def masked_until(line: Column, until: str = "until") -> Column:
    """An end is told only up to the line."""
    return F.when(F.col(until) <= line, F.col(until))


def latest_at(statements: DataFrame, keys: list[str], value: str, at: str, t: Column) -> DataFrame:
    """keys, value: the last statement up to t. One pass of partial aggregates, no window."""
    return statements.filter(F.col(at) <= t).groupBy(*keys).agg(F.max_by(value, F.struct(at, value)).alias(value))


def largest_gap(appearances: DataFrame, who: str, at: str) -> DataFrame:
    """who, gap, before, after: the largest step between appearances, the first of equal ones."""
    previous = F.lag(at).over(Window.partitionBy(who).orderBy(at))
    steps = appearances.select(who, at).distinct().withColumn("before", previous).filter("before IS NOT NULL")
    best = steps.groupBy(who).agg(F.max(F.struct((F.col(at) - F.col("before")).alias("gap"), (-F.col("before")).alias("m"), F.col(at).alias("after"))).alias("b"))
    return best.select(who, F.col("b.gap").alias("gap"), (-F.col("b.m")).alias("before"), F.col("b.after").alias("after"))


def recent_score(appearances: DataFrame, who: str, at: str, now: int, window: int = 50) -> DataFrame:
    """who, recent, total, last: appearances in (now - window, now], and up to now."""
    seen = appearances.filter(F.col(at) <= now)
    return seen.groupBy(who).agg(F.count_if(F.col(at) > now - window).alias("recent"), F.count("*").alias("total"), F.max(at).alias("last"))


def relation_intervals(statements: DataFrame, keys: list[str], at: str, ends: str, tie: str) -> DataFrame:
    """keys, since, until of relations that statements begin or end.

    A begin while the relation holds, and an end while it doesn't, change nothing; so of statements in their order
    those count whose kind differs from the one before, from the first begin on. As all are read at once, a late
    begin before others moves the start to the front.
    """
    by_time = Window.partitionBy(*keys).orderBy(at, tie)
    before = F.coalesce(F.lag(ends).over(by_time), F.lit(True))
    changes = statements.withColumn("_before", before).filter(F.col("_before") != F.col(ends))
    until = F.lead(at).over(by_time)
    return changes.select(*keys, F.col(at).alias("since"), until.alias("until"), F.col(ends).alias("_ends")).filter(~F.col("_ends")).drop("_ends")


def without_chapter(statements: DataFrame, at: str, chapter) -> DataFrame:
    """The statements as if a chapter had never been read. Intervals are derived from statements, so this undoes all that it began, ended or moved."""
    return statements.filter(F.col(at).isNull() | (F.col(at) != F.lit(chapter)))


def orphans(entities: DataFrame, id_col: str, *uses: DataFrame) -> DataFrame:
    """Entities that none of the tables of uses (each one column of ids) names. Anti joins, so null ids in a table hide nothing."""
    out = entities
    for used in uses:
        out = out.join(used.select(F.col(used.columns[0]).alias(id_col)), id_col, "left_anti")
    return out


def resolved(rows: DataFrame, who: list[str], merges: DataFrame) -> DataFrame:
    """rows with the ids in `who` replaced by those that stand for them. merges(id, live); without the merges undone."""
    out = rows
    for c in who:
        out = out.join(merges.select(F.col("id").alias(c), F.col("live").alias("_live")), c, "left").withColumn(c, F.coalesce("_live", c)).drop("_live")
    return out.select(*rows.columns)


def handed_over(rows: DataFrame, who: str, at: str, log: DataFrame) -> DataFrame:
    """rows in which an entity's from a chapter on belong to another: log(from_id, into_id, ch), an entity once."""
    joined = rows.join(F.broadcast(log.select(F.col("from_id").alias(who), "into_id", F.col("ch").alias("_from"))), who, "left")  # a row that a reader or a model has decided on
    return joined.withColumn(who, F.when(F.col(at) >= F.col("_from"), F.col("into_id")).otherwise(F.col(who))).select(*rows.columns)


def carried_over(facts: DataFrame, ids: DataFrame, keys: list[str], last) -> DataFrame:
    """What still holds at the end of a book, for the next one's entities, from its begin on. ids(old, new)."""
    holds = facts.filter(valid_at(F.lit(last)))
    entity = keys[0]
    moved = holds.join(ids.select(F.col("old").alias(entity), "new"), entity).withColumn(entity, F.col("new")).drop("new")
    return moved.withColumns({"since": F.lit(0).cast(facts.schema["since"].dataType), "until": F.lit(None).cast(facts.schema["until"].dataType)}).select(*facts.columns)
