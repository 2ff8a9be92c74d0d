"""Entities, events they share, relations between them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN_DIR: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local master, whose executor is the driver, may leave it unset; a temporary one takes its place there."""
    global _OWN_DIR
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN_DIR


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/foliant-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Roles whose pairs a task makes and counts, about.
ROLES_A_TASK = 500_000


def co_participants(roles: DataFrame, event: str, entity: str, least: int = 2) -> DataFrame:
    """a, b, events: pairs of entities, a < b, in at least `least` events together. An event has few roles.

    Roles are small and pairs are many, so tasks go by the number of roles: shuffles that Spark puts together by their
    bytes would give a task more pairs than it can hold.
    """
    tasks = max(roles.sparkSession.sparkContext.defaultParallelism, -(-roles.count() // ROLES_A_TASK))
    once = roles.select(F.col(event).alias("event"), F.col(entity).alias("a")).repartition(tasks, "event").distinct()
    pairs = once.join(once.withColumnRenamed("a", "b"), "event").filter("a < b").select("a", "b")
    return pairs.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("events")).filter(F.col("events") >= least)


def events_of_both(roles: DataFrame, event: str, entity: str, a, b) -> DataFrame:
    """event: those in which both take part; one pass, no join."""
    mine = roles.filter(F.col(entity).isin(a, b)).select(event, entity).distinct()
    return mine.groupBy(event).agg(F.count("*").alias("n")).filter("n = 2").select(event)


def edge_weights(relations: DataFrame, shared: DataFrame) -> DataFrame:
    """a, b, weight (a < b): two for each relation stated, and half of the shared events, three at most."""
    stated = relations.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(2.0).alias("w")).filter("a <> b")
    events = shared.select("a", "b", F.least(F.lit(3.0), F.col("events") / 2).alias("w"))
    return stated.unionByName(events).groupBy("a", "b").agg(F.sum("w").alias("weight"))


def co_event_edges(shared: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs that share events and have no relation stated in either direction."""
    stated = relations.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return shared.join(stated, ["a", "b"], "left_anti")


def neighbourhood(edges: DataFrame, focus: DataFrame, depth: int) -> DataFrame:
    """node, hop: nodes within `depth` steps of the focus, edges(a, b) read in both directions. Each hop meets only the frontier."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    seen = frontier = focus.select("node").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        reached = both.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        frontier = written(reached.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def live_ids(merges: DataFrame, most_hops: int = 20) -> DataFrame:
    """id, live: where a chain of merges (id, into) ends. Each round doubles the steps followed."""
    at = merges.select("id", F.col("into").alias("live"))
    rounds = 0
    while 1 << rounds < most_hops:
        on = at.select(F.col("id").alias("live"), F.col("live").alias("further"))
        at = written(at.join(on, "live", "left").select("id", F.coalesce("further", "live").alias("live")))
        rounds += 1
    return at


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each component of edges(a, b), by labels that spread and jump."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("m"))
        jump = labels.select(F.col("node").alias("m"), F.col("label").alias("further"))
        after = written(least.join(jump, "m", "left").select("node", F.least("m", F.coalesce("further", "m")).alias("now"), "label"))
        done = not after.filter("now <> label").limit(1).count()
        labels = after.select("node", F.col("now").alias("label"))
        if done:
            return labels
