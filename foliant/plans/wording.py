"""Names, titles, numbers and lines: text functions over strings that the tables' numbers spell out, so that SQL knows the answer without the rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.tables import table


def _spelled(key: str, forms: list):
    """The form whose number the key has, of len(forms)."""
    out = F
    for i, form in enumerate(forms):
        out = out.when(F.col(key) % len(forms) == i, form)
    return out.otherwise(F.lit(None))


def f12_chapter_numbers(spark, d):
    n, s = (F.col("o_orderkey") % 3000).cast("string"), lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    forms = [
        s("Chapter ", n), s("Vol. 2 Chapter ", n), s("The ", n, " Doors"), s("第 ", n, " 章 vol 3"), s(n, " - Dawn"), s("Ep. ", n, ".5: Dusk"), F.lit("Prologue"), s("c", n), s("Book 7, part 2"), s("Chapter ", F.format_number((F.col("o_orderkey") % 3000).cast("int") + 1000, 0)), s("#", n, "!"), s(n, "th day"),
    ]
    return table(spark, d, "orders").select("o_orderkey", fn.chapter_number(_spelled("o_orderkey", forms)).alias("chapter"))


def f14_same_titles(spark, d):
    n = F.col("o_orderkey").cast("string")
    lines = [F.concat(F.lit("Chapter 0"), n, F.lit(": The Dawn!")), F.concat(F.lit("Ch. "), n, F.lit(" the dawn")), F.concat(F.lit("CHAPTER "), (F.col("o_orderkey") + 1).cast("string"), F.lit(" The Dawn")), F.lit("The Dawn"), F.lit("The Dusk"), F.concat(F.lit("Chapter "), n), F.lit("Chapter")]
    title = F.concat(F.lit("Chapter "), n, F.lit(" - The Dawn"))
    bare = F.concat(F.lit("Ch "), n)
    o = table(spark, d, "orders").withColumn("line", _spelled("o_orderkey", lines))
    return o.select("o_orderkey", fn.same_chapter_title(F.col("line"), title).alias("titled"), fn.same_chapter_title(F.col("line"), bare).alias("numbered"))


def f7_tidy_names(spark, d):
    words = F.split(F.initcap("p_name"), " ")
    joined = F.concat(words[0], F.lit("Of"), F.lit("The"), F.get(words, F.lit(1)))
    forms = [F.concat_ws("_", words[0], F.get(words, F.lit(1))), joined, F.concat(F.lit("Mc"), F.lit("Donald")), F.concat(F.lit(" "), words[0], F.lit(" "), F.lit("McDonald "))]
    return table(spark, d, "part").select("p_partkey", fn.tidy_name(_spelled("p_partkey", forms)).alias("name"))


def f6_norm_names(spark, d):
    words = F.split(F.initcap("p_name"), " ")
    forms = [F.concat(F.lit("The "), F.col("p_name"), F.lit(" of Élan-"), F.col("p_brand")), F.concat(words[0], F.lit("Of"), F.get(words, F.lit(1))), F.concat(F.lit("Łódź ğøn, "), F.col("p_name")), F.lit("the")]
    return table(spark, d, "part").select("p_partkey", fn.norm_name(_spelled("p_partkey", forms)).alias("norm"))


def f25_reasons(spark, d):
    forms = [F.concat(F.lit("Because The "), F.col("p_name"), F.lit(".")), F.concat(F.lit(" To find "), F.col("p_name")), F.concat(F.initcap("p_name"), F.lit(". "))]
    reason = fn.because(_spelled("p_partkey", forms))
    return table(spark, d, "part").select("p_partkey", reason.alias("why"), fn.as_sentence(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name"))).alias("about"), fn.chapter_label(F.col("p_size")).alias("label"))


def n2_progress(spark, d):
    lines = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 13).alias("n"), (F.col("o_custkey") % 17 - 2).alias("i"))
    return lines.select("o_orderkey", F.round(fn.progress_fraction(F.col("i"), F.col("n")), 9).alias("progress"))


def n4_backoff(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.backoff_seconds(F.col("p_size") % 12).alias("seconds"))


def z4_versions(spark, d):
    v = F.concat_ws(".", (F.col("p_size") % 4).cast("string"), (F.col("p_partkey") % 12).cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit("0")).when(F.col("p_partkey") % 3 == 1, (F.col("p_partkey") % 11).cast("string")))
    return table(spark, d, "part").select("p_partkey", (fn.version_key(v) > fn.version_key(F.lit("1.9.3"))).alias("newer"))


def d3_clocks(spark, d):
    n = F.col("o_orderkey") % 50
    s = n.cast("string")
    forms = [F.concat(F.lit("1:"), F.lpad(s, 2, "0"), F.lit(":05.5")), F.concat(F.lit("2:"), F.lpad(s, 2, "0")), F.concat(s, F.lit("min")), F.concat(s, F.lit("ms")), F.concat(s, F.lit("h")), s, F.concat(s, F.lit(".25s")), F.concat(s, F.lit(" days"))]
    return table(spark, d, "orders").select("o_orderkey", F.round(fn.clock_seconds(_spelled("o_orderkey", forms)), 6).alias("seconds"))


def p12_junk_lines(spark, d):
    name = F.col("p_name")
    forms = [F.lit("* * *"), F.concat(F.lit("Translator: "), name), F.lit("Previous Chapter | Next"), F.concat(F.lit("The chapter about "), name), F.lit("Read the rest at some-site.com now"), F.lit("═════"), F.concat(F.lit("TOC of "), name), F.lit("If you find any errors, tell us."), F.lit("..."), F.lit("?!"), F.lit(".."), F.concat(F.lit("Please read the original of "), name, F.lit(". "), F.repeat(name, 90)), F.concat(F.lit("Faster updates of "), name, F.lit(" on our page")), F.lit("from novelfull.com")]
    return table(spark, d, "part").select("p_partkey", fn.is_junk_line(_spelled("p_partkey", forms)).alias("junk"))


def w10_merged_intervals(spark, d):
    spans = F.collect_list(F.struct((F.col("l_linenumber") * 10).cast("int").alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity") % 17).cast("int").alias("end")))
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(fn.merged_intervals(spans).alias("m"))
    return orders.select("l_orderkey", F.explode("m").alias("s")).select("l_orderkey", "s.start", "s.end")


def g2_maps_merged(spark, d):
    by_day = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.max("value"), 6).alias("v"), F.count("*").cast("double").alias("n"))
    maps = by_day.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("a"), F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("b"))
    larger = F.map_zip_with("a", "b", lambda k, x, y: F.greatest(x, y))
    return maps.select("user_id", F.round(F.aggregate(F.map_values(larger), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


QUERIES = {f.__name__: f for f in (f12_chapter_numbers, f14_same_titles, f7_tidy_names, f6_norm_names, f25_reasons, n2_progress, n4_backoff, z4_versions, d3_clocks, p12_junk_lines, w10_merged_intervals, g2_maps_merged)}

_N = "o_orderkey % 3000"
_TWO = "upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS a, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS b"

ORACLE_SQL = {
    "f12_chapter_numbers": f"""SELECT o_orderkey, CAST(CASE o_orderkey % 12 WHEN 0 THEN {_N} WHEN 1 THEN {_N} WHEN 2 THEN NULL WHEN 3 THEN {_N} WHEN 4 THEN {_N} WHEN 5 THEN {_N} + 0.5 WHEN 6 THEN NULL WHEN 7 THEN {_N} WHEN 8 THEN NULL
        WHEN 9 THEN {_N} + 1000 WHEN 10 THEN {_N} ELSE NULL END AS DOUBLE) AS chapter FROM orders""",
    "f14_same_titles": "SELECT o_orderkey, o_orderkey % 7 IN (0, 1, 3) AS titled, o_orderkey % 7 = 5 AS numbered FROM orders",
    "f7_tidy_names": f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN a || ' ' || b WHEN 1 THEN a || ' of the ' || b WHEN 2 THEN 'McDonald' ELSE a || ' McDonald' END AS name FROM (SELECT p_partkey, {_TWO} FROM part)",
    "f6_norm_names": f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(p_name) || ' of elan ' || replace(lower(p_brand), '#', ' ') WHEN 1 THEN lower(a) || ' of ' || lower(b) WHEN 2 THEN 'łodz ğon ' || lower(p_name) ELSE 'the' END AS norm
        FROM (SELECT p_partkey, p_name, p_brand, {_TWO} FROM part)""",
    "f25_reasons": f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'because the ' || p_name WHEN 1 THEN 'because to find ' || p_name ELSE 'because ' || array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(p_name, ' ')], ' ') END AS why,
        CASE WHEN p_partkey % 2 = 0 THEN upper(p_name[1]) || p_name[2:] || '. ' ELSE '' END AS about, 'chapter ' || (p_size + 1) AS label FROM part""",
    "n2_progress": "SELECT o_orderkey, round(CASE WHEN o_orderkey % 13 > 0 THEN greatest(0.0, least(1.0, (o_custkey % 17 - 1)::DOUBLE / (o_orderkey % 13))) ELSE 0.0 END, 9) AS progress FROM orders",
    "n4_backoff": "SELECT p_partkey, CASE WHEN p_size % 12 = 0 THEN 0.0 ELSE least(600.0, 5.0 * (1 << (p_size % 12 - 1))) END::DOUBLE AS seconds FROM part",
    "z4_versions": """SELECT p_partkey, (p_size % 4) * 10000 + (p_partkey % 12) * 100 + CASE p_partkey % 3 WHEN 1 THEN p_partkey % 11 ELSE 0 END > 10903 AS newer FROM part""",
    "d3_clocks": """SELECT o_orderkey, round(CASE o_orderkey % 8 WHEN 0 THEN 3600 + n * 60 + 5.5 WHEN 1 THEN 120 + n WHEN 2 THEN n * 60 WHEN 3 THEN n / 1000.0 WHEN 4 THEN n * 3600 WHEN 5 THEN n WHEN 6 THEN n + 0.25 END::DOUBLE, 6) AS seconds
        FROM (SELECT o_orderkey, (o_orderkey % 50)::DOUBLE AS n FROM orders)""",
    "p12_junk_lines": "SELECT p_partkey, p_partkey % 14 IN (0, 1, 2, 4, 5, 7, 8, 12, 13) AS junk FROM part",
    "w10_merged_intervals": """WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS INTEGER) % 17 AS b FROM lineitem), g AS (SELECT * FROM s WHERE b > a),
        m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM g),
        i AS (SELECT *, count(*) FILTER (e IS NULL OR a > e) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
        SELECT l_orderkey, CAST(min(a) AS INTEGER) AS start, CAST(max(b) AS INTEGER) AS "end" FROM i GROUP BY l_orderkey, island""",
    "g2_maps_merged": "SELECT user_id, round(sum(greatest(v, n)), 5) AS total FROM (SELECT user_id, event_type, round(max(value), 6) AS v, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2) GROUP BY 1",
}
