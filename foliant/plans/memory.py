"""A book's memory over the driver's tables: customers are entities, orders are events and chapters are their months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ledger, merge, temporal
from ..operators.order import with_places
from ..sources.tables import table

LINE = 50


def _ch(date: str = "o_orderdate"):
    return ((F.year(date) - 1992) * 12 + F.month(date) - 1).cast("int")


def _entities(spark, d) -> DataFrame:
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(_ch()).alias("first_ch"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "person").otherwise(F.lower("c_mktsegment"))
    merged = F.when(F.col("c_custkey") % 16 == 5, F.col("c_custkey") - 1)
    c = table(spark, d, "customer").join(first, "c_custkey", "left")
    return c.select(F.col("c_custkey").alias("id"), kind.alias("kind"), F.col("c_name").alias("name"), F.concat(F.lit("Known from "), F.col("c_nationkey").cast("string")).alias("about"), "first_ch", merged.alias("merged_into"))


def _aliases(spark, d) -> DataFrame:
    e = _entities(spark, d)
    second = F.concat(F.lit("The "), F.upper("kind"), F.lit(" "), F.col("id").cast("string"))
    return e.select(F.col("id").alias("entity"), F.col("name").alias("alias"), F.lit(None).cast("int").alias("ch")).union(e.select("id", second, "first_ch"))


def _appearances(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), _ch().alias("ch")).distinct()


def _facts(spark, d) -> DataFrame:
    o = table(spark, d, "orders").withColumn("ch", _ch())
    stands = temporal.fact_intervals(o, ["o_custkey"], "o_orderstatus", "ch", "o_orderkey")
    status = stands.select(F.col("o_custkey").alias("entity"), F.lit("status").alias("attr"), F.col("o_orderstatus").alias("value"), F.col("since").alias("from_ch"), F.col("until").alias("until_ch"))
    told = o.filter("o_orderkey % 5 = 0").select("o_custkey", F.lit("description"), F.concat(F.lit("Asks for "), "o_orderpriority"), "ch", F.lit(None).cast("int"))
    return status.union(told)


def _relations(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    until = F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 40 + 20).cast("int"))
    return c.select(F.col("c_custkey").alias("a"), F.lit("trusts").alias("rel"), (F.col("c_custkey") + 1).alias("b"), (F.col("c_custkey") % 40).cast("int").alias("from_ch"), until.alias("until_ch"))


def _events(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), _ch().alias("ch"), F.concat("o_orderpriority", F.lit(" order")).alias("what"), (F.col("o_orderkey") % 5).alias("importance"))


def _roles(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("entity"))


_KNOWN = "known(name string, core int)"
_CORE = [("person", 1), ("machinery", 1), ("household", 0)]


def m1_ledger(spark, d):
    return ledger.ledger(_entities(spark, d), _appearances(spark, d), _facts(spark, d), LINE)


def m1_ledger_by_name(spark, d):
    rows = ledger.ledger(_entities(spark, d), _appearances(spark, d), _facts(spark, d), LINE, kind="machinery", mode="name", most=50)
    return rows.select("id", "name", "seen")


def p11_named_like(spark, d):
    return ledger.named_like(_entities(spark, d), _aliases(spark, d), "the Person 1").select("id")


def a4_kinds_in_order(spark, d):
    known = spark.createDataFrame(_CORE, "name string, core int")
    return ledger.kinds(_entities(spark, d), known, LINE)


def m2_main_entity(spark, d):
    return ledger.main_entity(_entities(spark, d), _appearances(spark, d), LINE)


def m3_graph_nodes(spark, d):
    return ledger.graph_nodes(_entities(spark, d), _appearances(spark, d), 70, 70, most=60, window=12).select("id", "weight", "recent", "last_seen", "forgotten")


def m5_card(spark, d):
    e, a, f = _entities(spark, d), _aliases(spark, d), _facts(spark, d)
    return ledger.card(7, LINE, e, a, _appearances(spark, d), f, _relations(spark, d), _events(spark, d), _roles(spark, d))


def _threads(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").withColumn("ch", _ch())
    ends = o.groupBy("o_custkey").agg(F.min("ch").alias("raised_ch"), F.max("ch").alias("last"))
    threads = table(spark, d, "customer").join(ends, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), "raised_ch", F.when(F.col("c_acctbal") < 4000, F.col("last")).alias("resolved_ch"))
    return threads, o.select(F.col("o_custkey").alias("thread"), "ch")


def m8_threads(spark, d):
    return with_places(ledger.threads_at(*_threads(spark, d), LINE), ledger.thread_order())


def w5_takeovers(spark, d):
    return ledger.takeovers(_appearances(spark, d), gap=9, early=10, after=4)


def w6_first_gap(spark, d):
    return ledger.first_gap(_appearances(spark, d).filter("ch >= 0"), "entity", "ch")


def t6_pending(spark, d):
    done = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    return ledger.pending(_events(spark, d), done, "id", "importance", 2, 200)


def o5_key_events(spark, d):
    e = _events(spark, d).filter(F.col("ch") <= LINE)
    return ledger.latest_top(e, [F.desc("importance"), F.desc("ch"), F.col("id")], 25, [F.col("ch")]).select("id", "ch", "importance")


def u9_relations(spark, d):
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 2).alias("rel"), _ch().alias("ch"), (F.col("o_orderstatus") == "F").alias("ends"), "o_orderkey")
    return temporal.relation_intervals(o, ["o_custkey", "rel"], "ch", "ends", "o_orderkey")


def u10_retracted(spark, d):
    o = table(spark, d, "orders").withColumn("ch", _ch())
    return temporal.fact_intervals(temporal.without_chapter(o, "ch", 30), ["o_custkey"], "o_orderstatus", "ch", "o_orderkey")


def j11_orphans_of_all(spark, d):
    e = _entities(spark, d)
    used = [_appearances(spark, d).filter(F.col("ch") < 20).select("entity"), _facts(spark, d).filter(F.col("from_ch") < 20).select("entity"), _relations(spark, d).filter("from_ch < 5").select("a"), _relations(spark, d).filter("from_ch < 5").select("b"), _roles(spark, d).filter("event % 32 = 0").select("entity"), e.select("merged_into")]
    return temporal.orphans(e, "id", *used).select("id")


def u11_merged(spark, d):
    e = _entities(spark, d)
    log = e.filter("merged_into IS NOT NULL").select("id", F.col("merged_into").alias("live"), (F.col("id") % 32 == 5).alias("undone"))
    return temporal.resolved(_appearances(spark, d), ["entity"], log.filter("NOT undone")).groupBy("entity").agg(F.countDistinct("ch").alias("mentions"), F.min("ch").alias("first"), F.max("ch").alias("last"))


def u11_handed_over(spark, d):
    log = table(spark, d, "customer").filter("c_custkey % 10 = 3").select(F.col("c_custkey").alias("from_id"), (F.col("c_custkey") + 1).alias("into_id"), (F.col("c_custkey") % 60).cast("int").alias("ch"))
    return temporal.handed_over(_appearances(spark, d), "entity", "ch", log).distinct()


def j17_carried_over(spark, d):
    f = _facts(spark, d).filter("attr = 'status'").select("entity", "attr", "value", F.col("from_ch").alias("since"), F.col("until_ch").alias("until"))
    ids = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1_000_000).alias("new"))
    return temporal.carried_over(f, ids, ["entity", "attr"], 79).select("entity", "attr", "value", "since", F.col("until").isNull().alias("open"))


def j2_live_aliases(spark, d):
    e = _entities(spark, d).filter("merged_into IS NULL").select("id")
    a = _aliases(spark, d)
    return a.join(e, a["entity"] == e["id"], "left_semi").groupBy("alias").agg(F.count("*").alias("n"))


def _notes(spark, d) -> DataFrame:
    return table(spark, d, "conversations").filter("turn % 2 = 1").select("conv_id", F.col("turn").alias("ch"), F.length("text").alias("size"), F.when(F.col("turn") % 3 == 0, "failed").alias("error"))


def j6_noted_chapters(spark, d):
    chapters = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ch"), "role")
    return chapters.join(_notes(spark, d), ["conv_id", "ch"]).groupBy("role").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def j8_chapters_with_notes(spark, d):
    chapters = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ch"))
    return chapters.join(_notes(spark, d), ["conv_id", "ch"], "left").select("conv_id", "ch", F.coalesce("size", F.lit(-1)).alias("size"), F.col("error").isNotNull().alias("failed"))


def a7_failed_notes(spark, d):
    return _notes(spark, d).groupBy("conv_id").agg(F.count_if(F.col("error").isNotNull()).alias("failed"), F.count("*").alias("noted"))


def p15_to_note(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ch"), (F.col("role") == "user").alias("indexed"))
    x = rows.join(_notes(spark, d), ["conv_id", "ch"], "left")
    return x.filter(F.col("indexed") & F.col("size").isNull() & F.col("error").isNull()).select("conv_id", "ch")


def a1_table_state(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").agg(F.count("*").alias("n"), F.max("turn").alias("last"))


def a3_chapter_sizes(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.sum(F.length("text")).alias("chars"))


def a16_roll_up_twice(spark, d):
    """25 chapters an arc, ten arcs a part; only what is complete."""
    arcs = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 25).alias("arc")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total")).filter("n = 25")
    return arcs.groupBy(F.floor(F.col("arc") / 10).alias("part")).agg(F.count("*").alias("arcs"), F.sum("total").alias("total")).filter("arcs = 10").select("part", "total")


def u13_changed(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.sha1("text").alias("digest"))
    have = t.filter("turn % 4 <> 0").withColumn("digest", F.when(F.col("conv_id") % 5 == 0, F.lit("old")).otherwise(F.col("digest")))
    return merge.changed_chapters(have, t, ["conv_id", "turn"], "digest").select("conv_id", "turn")


def o8_kept_last(spark, d):
    return merge.kept_last(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 20)


def o9_marks_in_book_order(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("sec"), F.col("l_partkey").alias("blk"), F.col("l_suppkey").alias("sen"))
    by = Window.partitionBy("book").orderBy("sec", "blk", "sen")
    return m.withColumn("place", F.row_number().over(by))


def p7_without_secret(spark, d):
    secret = spark.createDataFrame([("HOUSEHOLD",)], "c_mktsegment string")
    return table(spark, d, "customer").join(F.broadcast(secret), "c_mktsegment", "left_anti").select("c_custkey")


def p1_by_role(spark, d):
    return table(spark, d, "conversations").filter(~F.col("role").isin("system", "assistant")).select("conv_id", "turn")


def p13_chapters_read(spark, d):
    """Read if marked so, or before the current chapter and not marked unread."""
    c = table(spark, d, "conversations").select("conv_id", "turn")
    marks = c.filter("turn % 3 <> 1").select("conv_id", "turn", (F.col("turn") % 3 == 0).alias("marked"))
    at = c.groupBy("conv_id").agg(F.floor(F.max("turn") / 2).alias("current"))
    read = F.coalesce("marked", F.col("turn") < F.col("current"))
    return c.join(marks, ["conv_id", "turn"], "left").join(at, "conv_id").select("conv_id", "turn", read.alias("read"))


def p14_window(spark, d):
    """Chapters read with chapter 50 of each customer: up to 3 that are there among the 20 before it, and those from it on without a gap, 5 at most."""
    have = _appearances(spark, d)
    before = Window.partitionBy("entity").orderBy(F.desc("ch"))
    back = have.filter("ch < 50 AND ch >= 30").withColumn("r", F.row_number().over(before)).filter("r <= 3").select("entity", "ch")
    ahead = Window.partitionBy("entity").orderBy("ch")
    on = have.filter("ch >= 50 AND ch < 55").withColumn("r", F.row_number().over(ahead)).filter("ch = 49 + r").select("entity", "ch")
    return back.union(on)


def j16_same_query_of_books(spark, d):
    """The main entity of each kind as a book, by one pass over all books."""
    seen = ledger.seen(_appearances(spark, d), LINE)
    rows = ledger.live(_entities(spark, d), LINE).join(seen, "id", "left")
    return rows.groupBy("kind").agg(F.max_by("id", F.struct(F.coalesce("seen", F.lit(0)), -F.col("id"))).alias("id"))


QUERIES = {
    f.__name__: f
    for f in (m1_ledger, m1_ledger_by_name, p11_named_like, a4_kinds_in_order, m2_main_entity, m3_graph_nodes, m5_card, m8_threads, w5_takeovers, w6_first_gap, t6_pending, o5_key_events, u9_relations, u10_retracted, j11_orphans_of_all, u11_merged, u11_handed_over, j17_carried_over, j2_live_aliases, j6_noted_chapters, j8_chapters_with_notes, a7_failed_notes, p15_to_note, a1_table_state, a3_chapter_sizes, a16_roll_up_twice, u13_changed, o8_kept_last, o9_marks_in_book_order, p7_without_secret, p1_by_role, p13_chapters_read, p14_window, j16_same_query_of_books)
}

_C = "CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS INTEGER)"
_ENT = f"""(SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'person' ELSE lower(c_mktsegment) END AS kind, c_name AS name, 'Known from ' || c_nationkey AS about, first_ch, CASE WHEN c_custkey % 16 = 5 THEN c_custkey - 1 END AS merged_into
    FROM customer LEFT JOIN (SELECT o_custkey, min({_C}) AS first_ch FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""
_APP = f"(SELECT DISTINCT o_custkey AS entity, {_C} AS ch FROM orders)"
_LIVE = f"(SELECT * FROM {_ENT} WHERE merged_into IS NULL AND coalesce(first_ch, 0) <= {LINE})"
_SEEN = f"(SELECT entity, count(*) AS seen, max(ch) AS last_seen FROM {_APP} WHERE ch <= {LINE} GROUP BY 1)"
_STATUS = f"""(SELECT o_custkey AS entity, o_orderstatus AS value, ch AS since, lead(ch) OVER (PARTITION BY o_custkey ORDER BY ch, o_orderkey) AS until FROM
    (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY ch, o_orderkey) AS b FROM (SELECT *, {_C} AS ch FROM orders)) WHERE b IS NULL OR b <> o_orderstatus)"""
_TOLD = f"(SELECT o_custkey, 'Asks for ' || o_orderpriority AS p FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {_C} DESC, o_orderpriority DESC) AS r FROM orders WHERE o_orderkey % 5 = 0 AND {_C} <= {LINE}) WHERE r = 1)"
_LEDGER = f"(SELECT e.id, kind, name, coalesce(p, about) AS about, first_ch, coalesce(seen, 0) AS seen, last_seen FROM {_LIVE} e LEFT JOIN {_SEEN} s ON s.entity = e.id LEFT JOIN {_TOLD} t ON t.o_custkey = e.id)"
_NOTE = "(SELECT conv_id, turn AS ch, length(text) AS size, CASE WHEN turn % 3 = 0 THEN 'failed' END AS error FROM conversations WHERE turn % 2 = 1)"

ORACLE_SQL = {
    "m1_ledger": f"SELECT * FROM {_LEDGER} ORDER BY seen DESC, name, id LIMIT 2000",
    "m1_ledger_by_name": f"SELECT id, name, seen FROM {_LEDGER} WHERE kind = 'machinery' ORDER BY lower(name), id LIMIT 50",
    "p11_named_like": f"SELECT id FROM {_ENT} WHERE kind = 'person' AND starts_with(CAST(id AS VARCHAR), '1')",
    "a4_kinds_in_order": f"SELECT *, CAST(row_number() OVER (ORDER BY core DESC, n DESC, kind) AS INTEGER) AS place FROM (SELECT kind, count(*) AS n, CAST(max(CASE WHEN kind IN ('person', 'machinery') THEN 1 ELSE 0 END) AS INTEGER) AS core FROM {_LIVE} GROUP BY 1)",
    "m2_main_entity": f"SELECT id FROM {_LEDGER} ORDER BY CASE WHEN kind = 'person' THEN 0 ELSE 1 END, seen DESC, id LIMIT 1",
    "m3_graph_nodes": f"""WITH w AS (SELECT e.id, count(*) AS weight, count(*) FILTER (ch > 58 AND ch <= 70) AS recent, max(ch) AS last_seen FROM {_ENT} e JOIN {_APP} a ON a.entity = e.id
            WHERE merged_into IS NULL AND coalesce(first_ch, 0) <= 70 AND ch <= 70 GROUP BY 1),
        g AS (SELECT id FROM w WHERE weight >= 3 AND 70 - last_seen > 12 ORDER BY sqrt(weight) * ln(71 - last_seen) DESC, id LIMIT CASE WHEN (SELECT count(*) FROM w) > 60 THEN 15 ELSE 0 END),
        r AS (SELECT id FROM w WHERE id NOT IN (SELECT id FROM g) ORDER BY recent * 4 + sqrt(weight) * 3 DESC, id LIMIT 60 - (SELECT count(*) FROM g))
        SELECT w.*, w.id IN (SELECT id FROM g) AS forgotten FROM w WHERE id IN (SELECT id FROM g) OR id IN (SELECT id FROM r)""",
    "m5_card": f"""WITH e AS (SELECT e.*, p FROM {_ENT} e LEFT JOIN {_TOLD} t ON t.o_custkey = e.id WHERE id = 7 AND coalesce(first_ch, 0) <= {LINE}),
        f AS (SELECT * FROM {_STATUS} WHERE entity = 7 AND since <= {LINE} AND (until IS NULL OR until > {LINE})),
        r AS (SELECT c_custkey AS a, c_custkey + 1 AS b, c_custkey % 40 AS since FROM customer WHERE (c_custkey = 7 OR c_custkey + 1 = 7) AND c_custkey % 40 <= {LINE} AND (c_custkey % 3 <> 0 OR c_custkey % 40 + 20 > {LINE})),
        v AS (SELECT *, {_C} AS ch FROM orders WHERE o_custkey = 7 AND {_C} <= {LINE} ORDER BY o_orderkey % 5 DESC, {_C} DESC, o_orderkey LIMIT 10)
        SELECT 0 AS section, 0 AS place, name || ' (' || kind || ')' || CASE WHEN first_ch <= {LINE} OR first_ch IS NULL THEN ', also called The ' || upper(kind) || ' ' || id ELSE '' END || '. ' || coalesce(p, about) || '. First met in chapter ' || (coalesce(first_ch, 0) + 1) || '.' AS text FROM e
        UNION ALL SELECT 1, CAST(row_number() OVER (ORDER BY since, value) AS INTEGER), 'status: ' || value || ' (from chapter ' || (since + 1) || ')' FROM f WHERE EXISTS (SELECT 1 FROM e)
        UNION ALL SELECT 2, CAST(row_number() OVER (ORDER BY since, a, b) AS INTEGER), x.c_name || ' trusts ' || y.c_name FROM r JOIN customer x ON x.c_custkey = a JOIN customer y ON y.c_custkey = b WHERE EXISTS (SELECT 1 FROM e)
        UNION ALL SELECT 3, CAST(row_number() OVER (ORDER BY ch, o_orderkey) AS INTEGER), 'chapter ' || (ch + 1) || ': ' || o_orderpriority || ' order' FROM v WHERE EXISTS (SELECT 1 FROM e)""",
    "m8_threads": f"""WITH o AS (SELECT o_custkey, {_C} AS ch FROM orders), x AS (SELECT o_custkey, min(ch) AS raised, max(ch) AS last, count(*) FILTER (ch <= {LINE}) AS steps, max(ch) FILTER (ch <= {LINE}) AS moved FROM o GROUP BY 1),
        t AS (SELECT c_custkey AS id, c_name AS title, raised, CASE WHEN c_acctbal < 4000 AND last <= {LINE} THEN last END AS resolved, steps, moved FROM x JOIN customer ON c_custkey = o_custkey WHERE raised <= {LINE})
        SELECT *, CAST(row_number() OVER (ORDER BY resolved IS NOT NULL, moved DESC, id) AS INTEGER) AS place FROM t""",
    "w5_takeovers": f"""WITH s AS (SELECT entity, ch, ch - lag(ch) OVER w AS step, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM {_APP} WINDOW w AS (PARTITION BY entity ORDER BY ch)),
        r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY step DESC, i) AS r FROM s WHERE step IS NOT NULL)
        SELECT entity, ch FROM r WHERE r = 1 AND step >= 9 AND i <= 10 AND n - i >= 4""",
    "w6_first_gap": f"""WITH n AS (SELECT c_custkey AS entity, i FROM customer, range(0, 400) t(i)), h AS (SELECT * FROM {_APP})
        SELECT entity, CAST(min(i) AS INTEGER) AS ch FROM n WHERE entity IN (SELECT entity FROM h) AND NOT EXISTS (SELECT 1 FROM h WHERE h.entity = n.entity AND h.ch = n.i) GROUP BY 1""",
    "t6_pending": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 >= 2 AND o_orderkey % 3 <> 0 ORDER BY o_orderkey % 5 DESC, o_orderkey LIMIT 200",
    "o5_key_events": f"SELECT o_orderkey AS id, {_C} AS ch, o_orderkey % 5 AS importance FROM orders WHERE {_C} <= {LINE} ORDER BY importance DESC, ch DESC, id LIMIT 25",
    "u9_relations": f"""WITH o AS (SELECT o_custkey, o_orderkey % 2 AS rel, {_C} AS ch, o_orderstatus = 'F' AS ends, o_orderkey FROM orders),
        g AS (SELECT *, count(*) FILTER (NOT ends) OVER (PARTITION BY o_custkey, rel ORDER BY ch, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS begun, count(*) FILTER (ends) OVER (PARTITION BY o_custkey, rel ORDER BY ch, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM o),
        b AS (SELECT o_custkey, rel, closed, min(struct_pack(c := ch, k := o_orderkey)) AS first FROM g WHERE NOT ends GROUP BY 1, 2, 3)
        SELECT b.o_custkey, b.rel, first.c AS since, (SELECT min(struct_pack(c := o.ch, k := o.o_orderkey)) FROM o WHERE o.ends AND o.o_custkey = b.o_custkey AND o.rel = b.rel AND (o.ch, o.o_orderkey) > (b.first.c, b.first.k)).c AS until FROM b""",
    "u10_retracted": f"""SELECT o_custkey, o_orderstatus, ch AS since, lead(ch) OVER (PARTITION BY o_custkey ORDER BY ch, o_orderkey) AS until FROM
        (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY ch, o_orderkey) AS b FROM (SELECT *, {_C} AS ch FROM orders) WHERE ch <> 30) WHERE b IS NULL OR b <> o_orderstatus""",
    "j11_orphans_of_all": f"""SELECT id FROM {_ENT} e WHERE NOT EXISTS (SELECT 1 FROM {_APP} a WHERE a.entity = e.id AND ch < 20) AND NOT EXISTS (SELECT 1 FROM {_STATUS} f WHERE f.entity = e.id AND since < 20)
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = e.id AND o_orderkey % 5 = 0 AND {_C} < 20) AND NOT (id % 40 < 5 OR (id > 1 AND (id - 1) % 40 < 5))
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = e.id AND o_orderkey % 32 = 0) AND NOT (id + 1) % 16 = 5""",
    "u11_merged": f"SELECT CASE WHEN entity % 16 = 5 AND entity % 32 <> 5 THEN entity - 1 ELSE entity END AS entity, count(DISTINCT ch) AS mentions, min(ch) AS first, max(ch) AS last FROM {_APP} GROUP BY 1",
    "u11_handed_over": f"SELECT DISTINCT CASE WHEN entity % 10 = 3 AND ch >= entity % 60 THEN entity + 1 ELSE entity END AS entity, ch FROM {_APP}",
    "j17_carried_over": f"SELECT entity + 1000000 AS entity, 'status' AS attr, value, 0 AS since, true AS open FROM {_STATUS} WHERE entity % 3 = 0 AND since <= 79 AND (until IS NULL OR until > 79)",
    "j2_live_aliases": f"SELECT alias, count(*) AS n FROM (SELECT id, name AS alias, merged_into FROM {_ENT} UNION ALL SELECT id, 'The ' || upper(kind) || ' ' || id, merged_into FROM {_ENT}) WHERE merged_into IS NULL GROUP BY 1",
    "j6_noted_chapters": "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS size FROM conversations WHERE turn % 2 = 1 GROUP BY 1",
    "j8_chapters_with_notes": "SELECT conv_id, turn AS ch, CAST(CASE WHEN turn % 2 = 1 THEN length(text) ELSE -1 END AS INTEGER) AS size, turn % 6 = 3 AS failed FROM conversations",
    "a7_failed_notes": f"SELECT conv_id, count(error) AS failed, count(*) AS noted FROM {_NOTE} GROUP BY 1",
    "p15_to_note": "SELECT conv_id, turn AS ch FROM conversations WHERE role = 'user' AND turn % 2 = 0",
    "a1_table_state": "SELECT count(*) AS n, max(turn) AS last FROM conversations WHERE role = 'user'",
    "a3_chapter_sizes": "SELECT conv_id, min(turn) AS first, max(turn) AS last, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1",
    "a16_roll_up_twice": """SELECT CAST(arc // 10 AS BIGINT) AS part, CAST(sum(t) AS BIGINT) AS total FROM (SELECT o_orderkey // 25 AS arc, sum(o_custkey) AS t FROM orders GROUP BY 1 HAVING count(*) = 25) GROUP BY 1 HAVING count(*) = 10""",
    "u13_changed": "SELECT conv_id, turn FROM conversations WHERE turn % 4 = 0 OR conv_id % 5 = 0",
    "o8_kept_last": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20",
    "o9_marks_in_book_order": "SELECT l_orderkey AS book, l_linenumber AS sec, l_partkey AS blk, l_suppkey AS sen, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS place FROM lineitem",
    "p7_without_secret": "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'",
    "p1_by_role": "SELECT conv_id, turn FROM conversations WHERE role NOT IN ('system', 'assistant')",
    "p13_chapters_read": """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN true WHEN 2 THEN false ELSE turn < m // 2 END AS read FROM conversations JOIN (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1) USING (conv_id)""",
    "p14_window": f"""WITH a AS (SELECT * FROM {_APP}) SELECT entity, ch FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ch DESC) AS r FROM a WHERE ch BETWEEN 30 AND 49) WHERE r <= 3
        UNION ALL SELECT entity, ch FROM a WHERE ch BETWEEN 50 AND 54 AND (SELECT count(*) FROM a b WHERE b.entity = a.entity AND b.ch BETWEEN 50 AND a.ch) = a.ch - 49""",
    "j16_same_query_of_books": f"SELECT kind, id FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY seen DESC, id) AS r FROM {_LEDGER}) WHERE r = 1",
}
