"""Statistics, shelves, facts in time and merges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.days import day_key
from ..operators import library, merge, stats, temporal
from ..sources.tables import table

TODAY = "2024-01-30"
LINE = "1998-01-01"


def _days(spark: SparkSession, d: str) -> DataFrame:
    return stats.day_totals(table(spark, d, "events"), "user_id", "ts", "value")


_DAYS = "SELECT user_id, CAST(ts - INTERVAL 4 HOUR AS DATE) AS day, round(sum(value), 6) AS total, count(*) AS sessions FROM events GROUP BY 1, 2"


def d1_day_totals(spark, d):
    return _days(spark, d)


def w1_w2_streaks(spark, d):
    return stats.streaks(_days(spark, d), "user_id", 20.0, TODAY)


def w3_last_days(spark, d):
    return stats.last_days(_days(spark, d), 14, TODAY)


def a18_kept_days(spark, d):
    return stats.kept_days(_days(spark, d), "user_id", 10)


def a11_map_totals(spark, d):
    by_day = table(spark, d, "events").groupBy(day_key(F.col("ts")).alias("day"), "event_type").agg(F.sum("value").alias("v"))
    maps = by_day.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("figures"))
    return stats.map_totals(maps, "event_type", "figures")


def z15_top_readers(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("total")).orderBy(F.desc("total"), "user_id").limit(5)


def x3_props(spark, d):
    props = F.from_json("props", "k INT")
    return table(spark, d, "events").groupBy(props["k"].alias("k")).agg(F.count("*").alias("n"))


def p6_read_states(spark, d):
    return table(spark, d, "customer").groupBy(library.read_state(F.col("c_acctbal") / 10000).alias("state")).agg(F.count("*").alias("n"))


def _parts(spark, d) -> DataFrame:
    spelled = F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).when(F.col("p_partkey") % 3 == 1, F.initcap("p_type")).otherwise(F.col("p_type"))
    return table(spark, d, "part").withColumn("tags", F.array(spelled, F.split("p_name", " ")[0]))


_PART_TAGS = """SELECT p_partkey, p_brand, CASE p_partkey % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN upper(p_type[1]) || lower(p_type[2:]) ELSE p_type END AS tag FROM part
    UNION ALL SELECT p_partkey, p_brand, split_part(p_name, ' ', 1) AS tag FROM part"""


def p4_shelf_filter(spark, d):
    return library.shelf_filter(_parts(spark, d), {"p_brand": ["Brand#2", "Brand#4", "Brand#17"], "p_size": []}, ["economy", "blue"]).select("p_partkey", "p_brand")


def p5_values_here(spark, d):
    chosen = spark.createDataFrame([("Brand#2",), ("Brand#4",), ("Brand#999",)], "p_brand string")
    return library.values_here(table(spark, d, "part"), "p_brand", chosen)


def o1_shelf_order(spark, d):
    order = [F.desc("p_size"), F.lower("p_brand"), F.col("p_retailprice"), F.lower("p_name"), F.col("p_partkey")]
    return library.ranked_shelf(table(spark, d, "part"), order).select("p_partkey", "place")


def a9_tag_facet(spark, d):
    return library.tag_facet(_parts(spark, d).select(F.explode("tags").alias("tag")))


def a10_series_facet(spark, d):
    spelled = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    return library.series_facet(table(spark, d, "part").withColumn("series", spelled), "series", "p_partkey")


def u1_distinct_tags(spark, d):
    return library.distinct_tags(_parts(spark, d).select("p_brand", "p_partkey", F.posexplode("tags").alias("i", "tag")).withColumn("o", F.struct("p_partkey", "i")), "p_brand", "tag", "o")


def a4_kinds(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("kind")).agg(F.count("*").alias("n"), F.max(F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int")).alias("core"))


def _facts(spark, d) -> DataFrame:
    return temporal.fact_intervals(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderdate", "o_orderkey")


_FACTS = """SELECT o_custkey, o_orderpriority, o_orderdate AS since, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS until FROM (
    SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NULL OR b <> o_orderpriority"""


def u8_fact_intervals(spark, d):
    return _facts(spark, d)


def p9_valid_at(spark, d):
    t = F.lit(LINE).cast("timestamp_ntz")
    return _facts(spark, d).filter(temporal.valid_at(t)).select("o_custkey", "o_orderpriority")


def p10_masked(spark, d):
    t = F.lit(LINE).cast("timestamp_ntz")
    return _facts(spark, d).filter(F.col("since") <= t).select("o_custkey", "since", temporal.masked_until(t).alias("until"))


def j13_latest_at(spark, d):
    return temporal.latest_at(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderdate", F.lit(LINE).cast("timestamp_ntz"))


def _chapters(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_custkey", F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).alias("ch"))


def w5_largest_gap(spark, d):
    return temporal.largest_gap(_chapters(spark, d), "o_custkey", "ch")


def w8_recent_score(spark, d):
    return temporal.recent_score(_chapters(spark, d), "o_custkey", "ch", 1500, 400)


def w7_latest_order(spark, d):
    o = table(spark, d, "orders")
    return merge.newest(o, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


def _replicas(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, d, "events").select("event_id", "ts", "value")
    shifted = F.when(F.col("value") > 50, F.col("ts") + F.expr("INTERVAL 1 HOUR")).when(F.col("value") < 20, F.col("ts")).otherwise(F.col("ts") - F.expr("INTERVAL 1 HOUR"))
    a = e.filter("event_id % 3 < 2").select("event_id", F.col("ts").alias("changed"), F.lit("a").alias("mark"))
    b = e.filter("event_id % 3 > 0").select("event_id", shifted.alias("changed"), F.lit("b").alias("mark"))
    gone = e.filter("event_id % 7 = 0").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("at"))
    return a, b, gone


def u5_merge_marks(spark, d):
    return merge.merge_marks(*_replicas(spark, d), "event_id", "changed", "at")


def u6_merge_days(spark, d):
    days = _days(spark, d)
    other = days.filter(F.col("user_id") % 2 == 0).withColumns({"total": F.col("total") - 5, "sessions": F.col("sessions") + 2})
    return merge.merge_days(days, other, ["user_id", "day"], ["total", "sessions"])


def u4_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return merge.upsert(c, c.filter("c_custkey % 4 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


def u15_import_plan(spark, d):
    p = table(spark, d, "part")
    return merge.import_plan(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") + (F.col("p_partkey") % 5 == 0).cast("int")), "p_partkey", "p_size")


def u14_list_verdict(spark, d):
    o = table(spark, d, "orders")
    return merge.list_verdict(o, o.filter("o_custkey % 5 <> 0 AND (o_custkey % 5 <> 1 OR o_orderkey % 3 = 0)").withColumn("o_orderkey", F.when(F.col("o_custkey") % 5 == 2, F.col("o_orderkey") + 1_000_000).otherwise(F.col("o_orderkey"))), "o_custkey", "o_orderkey")


QUERIES = {f.__name__: f for f in (d1_day_totals, w1_w2_streaks, w3_last_days, a18_kept_days, a11_map_totals, z15_top_readers, x3_props, p6_read_states, p4_shelf_filter, p5_values_here, o1_shelf_order, a9_tag_facet, a10_series_facet, u1_distinct_tags, a4_kinds, u8_fact_intervals, p9_valid_at, p10_masked, j13_latest_at, w5_largest_gap, w8_recent_score, w7_latest_order, u5_merge_marks, u6_merge_days, u4_upsert, u15_import_plan, u14_list_verdict)}

ORACLE_SQL = {
    "d1_day_totals": _DAYS,
    "w1_w2_streaks": f"""WITH met AS (SELECT user_id, day FROM ({_DAYS}) WHERE total >= 20),
        i AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM met),
        r AS (SELECT user_id, max(day) AS last, count(*) AS run FROM i GROUP BY user_id, island)
        SELECT user_id, CAST(max(CASE WHEN last >= DATE '{TODAY}' - 1 AND last <= DATE '{TODAY}' THEN run ELSE 0 END) AS BIGINT) AS current, max(run) AS best FROM r GROUP BY user_id""",
    "w3_last_days": f"""SELECT CAST(c.day AS DATE) AS day, coalesce(s.total, 0.0) AS total FROM (SELECT unnest(generate_series(DATE '{TODAY}' - 13, DATE '{TODAY}', INTERVAL 1 DAY)) AS day) c
        LEFT JOIN (SELECT day, round(sum(total), 6) AS total FROM ({_DAYS}) GROUP BY day) s ON CAST(c.day AS DATE) = s.day""",
    "a18_kept_days": f"SELECT user_id, day, total, sessions FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY day DESC) AS r FROM ({_DAYS})) WHERE r <= 10",
    "a11_map_totals": "SELECT event_type, round(sum(value), 6) AS total FROM events GROUP BY 1",
    "z15_top_readers": "SELECT user_id, round(sum(value), 6) AS total FROM events GROUP BY 1 ORDER BY total DESC, user_id LIMIT 5",
    "x3_props": "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
    "p6_read_states": "SELECT CASE WHEN c_acctbal / 10000 >= 0.995 THEN 'finished' WHEN c_acctbal / 10000 > 0 THEN 'reading' ELSE 'unread' END AS state, count(*) AS n FROM customer GROUP BY 1",
    "p4_shelf_filter": f"SELECT DISTINCT p_partkey, p_brand FROM ({_PART_TAGS}) WHERE p_brand IN ('Brand#2', 'Brand#4', 'Brand#17') AND lower(tag) IN ('economy', 'blue')",
    "p5_values_here": "SELECT DISTINCT p_brand FROM part WHERE p_brand IN ('Brand#2', 'Brand#4', 'Brand#999')",
    "o1_shelf_order": "SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size DESC, lower(p_brand), p_retailprice, lower(p_name), p_partkey) AS INTEGER) AS place FROM part",
    "a9_tag_facet": f"""WITH s AS (SELECT lower(tag) AS key, tag AS name, count(*) AS n FROM ({_PART_TAGS}) GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, name) AS r, sum(n) OVER (PARTITION BY key) AS c FROM s)
        SELECT key, name, CAST(c AS BIGINT) AS count FROM r WHERE r = 1""",
    "a10_series_facet": "SELECT lower(s) AS key, arg_min(s, p_partkey) AS name, count(*) AS count FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS s FROM part) GROUP BY 1",
    "u1_distinct_tags": """WITH t AS (SELECT p_partkey, p_brand, 0 AS i, CASE p_partkey % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN upper(p_type[1]) || lower(p_type[2:]) ELSE p_type END AS tag FROM part
        UNION ALL SELECT p_partkey, p_brand, 1, split_part(p_name, ' ', 1) FROM part)
        SELECT p_brand, tag FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(tag) ORDER BY p_partkey, i) AS r FROM t) WHERE r = 1""",
    "a4_kinds": "SELECT c_mktsegment AS kind, count(*) AS n, max(CAST(c_mktsegment IN ('BUILDING', 'MACHINERY') AS INTEGER)) AS core FROM customer GROUP BY 1",
    "u8_fact_intervals": _FACTS,
    "p9_valid_at": f"SELECT o_custkey, o_orderpriority FROM ({_FACTS}) WHERE since <= TIMESTAMP '{LINE}' AND (until IS NULL OR until > TIMESTAMP '{LINE}')",
    "p10_masked": f"SELECT o_custkey, since, CASE WHEN until <= TIMESTAMP '{LINE}' THEN until END AS until FROM ({_FACTS}) WHERE since <= TIMESTAMP '{LINE}'",
    "j13_latest_at": f"SELECT o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority DESC) AS r FROM orders WHERE o_orderdate <= TIMESTAMP '{LINE}') WHERE r = 1",
    "w5_largest_gap": """WITH c AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS ch FROM orders),
        s AS (SELECT o_custkey, ch, lag(ch) OVER (PARTITION BY o_custkey ORDER BY ch) AS before FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ch - before DESC, before) AS r FROM s WHERE before IS NOT NULL)
        SELECT o_custkey, CAST(ch - before AS INTEGER) AS gap, CAST(before AS INTEGER) AS before, CAST(ch AS INTEGER) AS after FROM r WHERE r = 1""",
    "w8_recent_score": """WITH c AS (SELECT o_custkey, CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS ch FROM orders)
        SELECT o_custkey, count(*) FILTER (ch > 1100) AS recent, count(*) AS total, CAST(max(ch) AS INTEGER) AS last FROM c WHERE ch <= 1500 GROUP BY 1""",
    "w7_latest_order": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1",
    "u5_merge_marks": """WITH m AS (SELECT event_id, ts AS changed, 'a' AS mark FROM events WHERE event_id % 3 < 2
        UNION ALL SELECT event_id, CASE WHEN value > 50 THEN ts + INTERVAL 1 HOUR WHEN value < 20 THEN ts ELSE ts - INTERVAL 1 HOUR END, 'b' FROM events WHERE event_id % 3 > 0),
        g AS (SELECT event_id, max(CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL 30 MINUTE END) AS gone FROM events WHERE event_id % 7 = 0 GROUP BY 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY changed DESC, mark) AS r FROM m)
        SELECT r.event_id, changed, mark FROM r LEFT JOIN g ON r.event_id = g.event_id WHERE r = 1 AND (gone IS NULL OR changed > gone)""",
    "u6_merge_days": f"SELECT user_id, day, total, sessions + CASE WHEN user_id % 2 = 0 THEN 2 ELSE 0 END AS sessions FROM ({_DAYS})",
    "u4_upsert": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer",
    "u15_import_plan": "SELECT p_partkey, CASE WHEN p_partkey % 2 <> 0 THEN 'new' WHEN p_partkey % 5 = 0 THEN 'conflict' ELSE 'same' END AS state FROM part WHERE p_partkey % 3 = 0",
    "u14_list_verdict": """WITH n AS (SELECT o_custkey, CASE WHEN o_custkey % 5 = 2 THEN o_orderkey + 1000000 ELSE o_orderkey END AS k FROM orders WHERE o_custkey % 5 <> 0 AND (o_custkey % 5 <> 1 OR o_orderkey % 3 = 0)),
        b AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT o_custkey, count(*) AS m FROM n GROUP BY 1),
        g AS (SELECT o.o_custkey, count(*) AS gone FROM orders o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.o_custkey = o.o_custkey AND n.k = o.o_orderkey) GROUP BY 1)
        SELECT b.o_custkey, CASE WHEN coalesce(m, 0) = 0 THEN 'empty' WHEN n - m > greatest(3.0, n * 0.02) THEN 'shrunk' WHEN coalesce(gone, 0) * 2 > n THEN 'moved' ELSE 'fine' END AS verdict
        FROM b LEFT JOIN a ON a.o_custkey = b.o_custkey LEFT JOIN g ON g.o_custkey = b.o_custkey""",
}
