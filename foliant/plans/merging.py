"""A log of merges made of customers: a nation is a book, a third of its customers are merged into the one before, a third hand over their later months; some of it is undone."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import merge_log
from ..sources.tables import table

#: Steps as of which owners are asked for: before all, in the middle, before and after what was undone.
STEPS, UNDOING = (0, 700, 100_000, 10_000_000), 1_000_000


def _log(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("book"), F.col("c_custkey").cast("long").alias("a"))
    c = c.withColumn("b", F.lag("a").over(Window.partitionBy("book").orderBy("a"))).filter("b IS NOT NULL AND a % 3 < 2")
    done = c.select("book", F.col("a").alias("step"), F.when(F.col("a") % 3 == 0, "merge").otherwise("hand").alias("op"), "a", "b", F.when(F.col("a") % 3 == 1, 40).cast("int").alias("ch"))
    undone = done.filter("a % 5 = 0").select("book", (F.col("step") + UNDOING).alias("step"), F.lit("undo").alias("op"), "a", F.lit(None).cast("long").alias("b"), F.lit(None).cast("int").alias("ch"))
    return done.unionByName(undone)


def u11_merge_log(spark, d):
    """Orders by whose they are, as of each step."""
    ch = ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1).cast("int")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("book"), F.col("o_custkey").cast("long").alias("who"), ch.alias("ch"), F.explode(F.array(*(F.lit(s).cast("long") for s in STEPS))).alias("step"))
    mine = merge_log.owned(rows, ["who"], "ch", merge_log.owner_intervals(_log(spark, d)), F.col("step"))
    return mine.groupBy("step", "who").agg(F.count("*").alias("orders"), F.min("ch").alias("first"))


def u11_owner_intervals(spark, d):
    """How many ids of each book have had another owner, and how many intervals hold in the end."""
    i = merge_log.owner_intervals(_log(spark, d))
    return i.groupBy("book").agg(F.countDistinct("id").alias("ids"), F.count_if(F.col("until").isNull()).alias("open"))


QUERIES = {f.__name__: f for f in (u11_merge_log, u11_owner_intervals)}

_P = """p AS (SELECT a, b, a % 3 = 1 AS hand, a % 5 = 0 AS undone FROM (SELECT c_custkey AS a, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS b FROM customer) WHERE b IS NOT NULL AND a % 3 < 2),
    s AS (SELECT unnest([0, 700, 100000, 10000000]) AS step), ways AS (SELECT step, a, b, hand FROM p, s WHERE a <= step AND NOT (undone AND a + 1000000 <= step)),
    starts AS (SELECT step, c_custkey AS id, late FROM customer, s, (SELECT unnest([true, false]) AS late)),
    walk AS (SELECT step, id, late, id AS here FROM starts UNION ALL SELECT walk.step, id, late, b FROM walk JOIN ways ON ways.step = walk.step AND ways.a = walk.here AND (NOT hand OR late)),
    owner AS (SELECT step, id, late, min(here) AS who FROM walk GROUP BY ALL)"""
ORACLE_SQL = {
    "u11_merge_log": f"""WITH RECURSIVE {_P}, o AS (SELECT o_custkey, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS ch FROM orders)
        SELECT CAST(step AS BIGINT) AS step, CAST(who AS BIGINT) AS who, count(*) AS orders, CAST(min(ch) AS INTEGER) AS first FROM o JOIN owner ON id = o_custkey AND late = (ch >= 40) GROUP BY 1, 2""",
    "u11_owner_intervals": f"""WITH RECURSIVE {_P}, x AS (SELECT o.id, late, who FROM owner o WHERE step = 10000000 AND id <> who), y AS (SELECT id, count(DISTINCT who) AS w, count(*) AS n, bool_and(late) AS only_late FROM x GROUP BY 1),
        f AS (SELECT 'n' || c_nationkey AS book, sum(CASE WHEN n = 2 AND w = 2 THEN 2 ELSE 1 END) AS open FROM y JOIN customer ON c_custkey = id GROUP BY 1),
        e AS (SELECT 'n' || c_nationkey AS book, count(DISTINCT a) AS ids FROM p JOIN customer ON c_custkey = a GROUP BY 1)
        SELECT book, ids, CAST(coalesce(open, 0) AS BIGINT) AS open FROM e LEFT JOIN f USING (book)""",
}
