"""Joins and graph queries: orders are events, suppliers their participants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links
from ..sources.tables import table


def j1_entities_with_kinds(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    kinds = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").filter("n_nationkey % 4 <> 0")
    return c.join(kinds, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


def j3_named_ends(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    relations = s.select(F.col("s_nationkey").alias("a"), (F.col("s_suppkey") % 25).cast("int").alias("b"))
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("a_name")), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("b_name"))
    return relations.join(a, "a").join(b, "b").groupBy("a_name", "b_name").agg(F.count("*").alias("n"))


def j7_open_threads(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.max("o_orderdate").alias("moved"), F.count("o_orderkey").alias("steps"))


def j10_semi(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority LIKE '1%'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def j11_orphans(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.select("doc_id").join(labels, "doc_id", "left_anti")


def j12_counts(spark, d):
    return spark.sql(
        "SELECT c_custkey, (SELECT count(*) FROM {orders} o WHERE o.o_custkey = c_custkey) AS n, (SELECT max(o_totalprice) FROM {orders} o WHERE o.o_custkey = c_custkey) AS most FROM {customer}",
        customer=table(spark, d, "customer"), orders=table(spark, d, "orders"),
    )


def j14_full_outer(spark, d):
    a = table(spark, d, "labels").groupBy("doc_id").agg(F.count("*").alias("marks"))
    b = table(spark, d, "documents").withColumn("doc_id", F.col("doc_id") + 100).groupBy("doc_id").agg(F.count("*").alias("pages"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.coalesce("marks", F.lit(0)).alias("marks"), F.coalesce("pages", F.lit(0)).alias("pages"))


def a5_conditional_sums(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.groupBy("l_suppkey").agg(F.count_if(F.col("l_quantity") <= 10).alias("few"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("returned"), F.count("*").alias("n"))


def a8_recount(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("mentions"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"))


def a16_roll_up(spark, d):
    """25 chapters to an arc, only complete ones."""
    o = table(spark, d, "orders").withColumn("arc", F.floor(F.col("o_orderkey") / 25).cast("long"))
    return o.groupBy("arc").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).filter("n = 25").select("arc", "total")


def a17_signature(spark, d):
    o = table(spark, d, "orders")
    return o.agg(F.concat_ws(":", F.count("*").cast("string"), F.max("o_orderkey").cast("string"), F.count_if(F.col("o_orderstatus") == "F").cast("string")).alias("signature"))


def _shared(spark, d):
    return links.co_participants(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", 2)


def _relations(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").cast("long").alias("b")).filter("a <> b")


_SHARED = """SELECT x.s AS a, y.s AS b, count(*) AS events FROM (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) x
    JOIN (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) y ON x.o = y.o AND x.s < y.s GROUP BY 1, 2 HAVING count(*) >= 2"""
_RELATIONS = "SELECT s_suppkey AS a, CAST(s_nationkey AS BIGINT) AS b FROM supplier WHERE s_suppkey <> s_nationkey"


def j4_co_participants(spark, d):
    return _shared(spark, d)


def j5_events_of_both(spark, d):
    return links.events_of_both(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", 1, 2)


def m11_edge_weights(spark, d):
    return links.edge_weights(_relations(spark, d), _shared(spark, d))


def m3_co_event_edges(spark, d):
    return links.co_event_edges(_shared(spark, d), _relations(spark, d))


def m3_neighbourhood(spark, d):
    focus = spark.createDataFrame([(1,)], "node long")
    return links.neighbourhood(_relations(spark, d), focus, 3)


def u12_live_ids(spark, d):
    merges = table(spark, d, "customer").filter("c_custkey % 8 <> 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") - 1).alias("into"))
    return links.live_ids(merges)


def t13_components(spark, d):
    edges = table(spark, d, "customer").filter("c_custkey % 8 <> 0 AND c_custkey > 1").select(F.col("c_custkey").alias("a"), F.floor(F.col("c_custkey") / 2).cast("long").alias("b"))
    return links.components(edges)


QUERIES = {f.__name__: f for f in (j1_entities_with_kinds, j3_named_ends, j7_open_threads, j10_semi, j11_orphans, j12_counts, j14_full_outer, a5_conditional_sums, a8_recount, a16_roll_up, a17_signature, j4_co_participants, j5_events_of_both, m11_edge_weights, m3_co_event_edges, m3_neighbourhood, u12_live_ids, t13_components)}

ORACLE_SQL = {
    "j1_entities_with_kinds": """SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN (SELECT * FROM nation LEFT JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0) k ON c_nationkey = n_nationkey""",
    "j3_named_ends": "SELECT x.n_name AS a_name, y.n_name AS b_name, count(*) AS n FROM supplier JOIN nation x ON s_nationkey = x.n_nationkey JOIN nation y ON s_suppkey % 25 = y.n_nationkey GROUP BY 1, 2",
    "j7_open_threads": "SELECT c_custkey, max(o_orderdate) AS moved, count(o_orderkey) AS steps FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "j10_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')",
    "j11_orphans": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "j12_counts": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer",
    "j14_full_outer": """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(marks, 0) AS marks, coalesce(pages, 0) AS pages FROM (SELECT doc_id, count(*) AS marks FROM labels GROUP BY 1) a
        FULL OUTER JOIN (SELECT doc_id + 100 AS doc_id, count(*) AS pages FROM documents GROUP BY 1) b ON a.doc_id = b.doc_id""",
    "a5_conditional_sums": "SELECT l_suppkey, count(*) FILTER (l_quantity <= 10) AS few, max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS returned, count(*) AS n FROM lineitem GROUP BY 1",
    "a8_recount": "SELECT l_partkey, count(DISTINCT l_orderkey) AS mentions, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem GROUP BY 1",
    "a16_roll_up": "SELECT CAST(o_orderkey // 25 AS BIGINT) AS arc, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING count(*) = 25",
    "a17_signature": "SELECT count(*) || ':' || max(o_orderkey) || ':' || count(*) FILTER (o_orderstatus = 'F') AS signature FROM orders",
    "j4_co_participants": _SHARED,
    "j5_events_of_both": "SELECT DISTINCT x.l_orderkey FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey WHERE x.l_suppkey = 1 AND y.l_suppkey = 2",
    "m11_edge_weights": f"SELECT a, b, sum(w) AS weight FROM (SELECT least(a, b) AS a, greatest(a, b) AS b, 2.0::DOUBLE AS w FROM ({_RELATIONS}) UNION ALL SELECT a, b, least(3.0, events / 2)::DOUBLE FROM ({_SHARED})) GROUP BY 1, 2",
    "m3_co_event_edges": f"SELECT a, b, events FROM ({_SHARED}) s WHERE NOT EXISTS (SELECT 1 FROM ({_RELATIONS}) r WHERE (r.a = s.a AND r.b = s.b) OR (r.a = s.b AND r.b = s.a))",
    "m3_neighbourhood": f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_RELATIONS}) UNION SELECT b, a FROM ({_RELATIONS})),
        w AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hop UNION SELECT e.b, w.hop + 1 FROM w JOIN e ON e.a = w.node WHERE w.hop < 3)
        SELECT node, min(hop) AS hop FROM w GROUP BY 1""",
    "u12_live_ids": """SELECT c_custkey AS id, c_custkey - c_custkey % 8 AS live FROM customer WHERE c_custkey % 8 <> 0""",
    "t13_components": """WITH RECURSIVE e AS (SELECT c_custkey AS a, CAST(c_custkey // 2 AS BIGINT) AS b FROM customer WHERE c_custkey % 8 <> 0 AND c_custkey > 1),
        up AS (SELECT a AS node, b AS top FROM e UNION ALL SELECT b, b FROM e UNION ALL SELECT up.node, e.b FROM up JOIN e ON e.a = up.top)
        SELECT node, min(top) AS label FROM up GROUP BY 1""",
}
