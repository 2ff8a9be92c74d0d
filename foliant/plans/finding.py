"""Shelves in their six orders, series, questions as people type them, merges of whole records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import library, merge, prints, search, series
from ..sources.tables import table
from . import text


def _shelf(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    words = F.split(F.initcap("p_name"), " ")
    author = F.when(k % 5 == 0, F.concat(words[0], F.lit(" van der "), F.get(words, F.lit(1)))).when(k % 5 == 1, F.concat(F.get(words, F.lit(1)), F.lit(", "), words[0])).when(k % 5 == 2, F.concat(words[0], F.lit(" "), F.get(words, F.lit(1)), F.lit(", Jr."))).when(k % 5 == 3, words[0])
    return table(spark, d, "part").select(
        k.alias("id"), F.col("p_name").alias("title"), F.when(k % 3 > 0, F.col("p_brand")).alias("series"), F.when(k % 2 == 0, F.col("p_size")).alias("index"),
        F.array_compact(F.array(F.lit(""), author)).alias("authors"), (k % 97).alias("added"), (F.col("p_size") % 10 / 10).alias("progress"), (k * 7919 % 2003).alias("ordinal"),
    )


def _order(mode):
    def query(spark, d):
        return library.shelf_in_order(_shelf(spark, d), mode).select("id", "place")

    query.__name__ = f"o1_by_{mode}"
    return query


def o2_author_keys(spark, d):
    return _shelf(spark, d).select("id", F.replace(library.author_key(F.col("authors")), F.lit("\0"), F.lit("|")).alias("key"), F.array_join(library.family_names(F.col("authors")), "|").alias("families"))


def _titles(spark, d) -> DataFrame:
    """Titles of series of five, spelled three ways, and titles in none."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("Saga of "), F.initcap(F.split("p_name", " ")[0]), F.lit(" Number-"), F.floor(k / 5).cast("string"))
    n = (k % 5 + 1).cast("string")
    title = F.when(k % 4 == 0, F.concat(name, F.lit(" "), n)).when(k % 4 == 1, F.concat(F.lit("Long Night ("), name, F.lit(", Book "), n, F.lit(")"))).when(k % 4 == 2, F.concat(name, F.lit(", Vol. "), n)).otherwise(F.concat(F.lit("A Tale of "), F.col("p_name"), F.lit(" 451")))
    return table(spark, d, "part").select("p_partkey", title.alias("title"))


def f11_series(spark, d):
    return series.from_title(_titles(spark, d), "p_partkey", "title")


def t14_series_across(spark, d):
    k = F.col("p_partkey")
    part = F.concat(F.lit("The First Law of "), F.floor(k / 4).cast("string"), F.lit("x"))
    title = F.when(k % 4 == 0, F.concat(part, F.lit(" 1 The Blade"))).when(k % 4 == 1, F.concat(F.lit("Before They Hang: "), part, F.lit(" 2"))).when(k % 4 == 2, F.concat(F.lit("Lone Story ("), F.lit("Quiet Sea #"), (k % 9 + 1).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("Nothing "), F.col("p_name")))
    return series.across(table(spark, d, "part").select("p_partkey", title.alias("title")), "p_partkey", "title")


def _chunks(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("ch"), F.col("turn").alias("sec"), "text")


def t2_phrase(spark, d):
    found = search.matching(table(spark, d, "documents"), "text", '"of the" anth')
    return found.select("doc_id", F.col("h0").alias("phrases"), F.col("h1").alias("begins"))


def t2_any_in_order(spark, d):
    found = search.matching(_chunks(spark, d), "text", "ingth edle", every=False, guard=F.col("ch") <= 60)
    return found.select("ch", "sec", F.col("h0").alias("a"), F.col("h1").alias("b")).orderBy("ch", "sec").limit(50)


def t4_find_where(spark, d):
    return search.find_where(_chunks(spark, d), "text", "anth", ["ch", "sec"], "ch")


def a2_hits_by_chapter(spark, d):
    return search.hits_by_chapter(_chunks(spark, d), "text", "th an", "ch")


def t1_spans(spark, d):
    return search.hit_spans(table(spark, d, "benchmark"), "item_id", "text", "THÉ ")


def t1_whole_words(spark, d):
    return search.hit_spans(table(spark, d, "benchmark"), "item_id", "text", "the", whole_words=True)


def _records(spark, d) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer")
    at = lambda n: (F.col("c_custkey") * n % 101).cast("int")
    a = c.filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("book"), F.col("c_name").alias("title"), F.lit("a").alias("cursor"), at(7).alias("at"))
    b = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("book"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.upper("c_name")).alias("title"), F.lit("b").alias("cursor"), at(11).alias("at"))
    return a, b


def u5_merge_places(spark, d):
    a, b = _records(spark, d)
    return merge.merge_places(a, b, "book", "at").select("book", "cursor", "at")


def u5_merge_titles(spark, d):
    a, b = _records(spark, d)
    return merge.merge_titles(a, b, "book", "title")


def u5_merge_removed(spark, d):
    a, b = _records(spark, d)
    return merge.merge_removed(a, b, "book", "at")


def u7_added_books(spark, d):
    a, b = _records(spark, d)
    return merge.added_books(a, b, "book").select("book", "cursor")


def u14_incomplete(spark, d):
    o = table(spark, d, "orders")
    new = o.filter("o_custkey % 5 <> 0")
    complete = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 7 != 1).alias("complete"))
    return merge.list_verdict(o.filter("o_custkey % 11 <> 2"), new, "o_custkey", "o_orderkey", complete)


def k6_sync_records(spark, d):
    o = table(spark, d, "orders").filter("o_orderkey % 7 = 0")
    books = table(spark, d, "customer").select(F.col("c_custkey").alias("book"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("title"))
    marks = o.select(F.col("o_custkey").alias("book"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("changed"))
    removed = o.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").cast("string").alias("id"), F.lit("2024").alias("at"))
    days = o.groupBy(F.col("o_custkey").alias("book"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("ms"))
    return merge.sync_record(books, marks, removed, days, "book")


def z11_joined_lists(spark, d):
    p = table(spark, d, "part")
    first = p.filter("p_partkey % 3 = 0").select(F.concat(F.lit(" "), F.upper("p_brand"), F.col("p_size").cast("string")).alias("word"), F.col("p_partkey").alias("say")).groupBy("word").agg(F.min("say").alias("say"))
    more = p.filter("p_partkey % 3 = 1").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("word"), F.col("p_partkey").alias("say")).groupBy("word").agg(F.min("say").alias("say"))
    return merge.joined_lists(first, more.union(spark.createDataFrame([(" ", 1)], "word string, say long")), "word").select(F.lower(F.trim("word")).alias("word"), "say")


def t12_why_same(spark, d):
    """Pairs of documents with a common print hash, and why they are the same."""
    docs = table(spark, d, "documents")
    pairs = prints.print_pairs(prints.text_prints(docs, "doc_id", "text"), "doc_id")
    source = docs.select("doc_id", "source", "lang")
    x = pairs.join(source.select(F.col("doc_id").alias("a"), F.col("source").alias("sa"), F.col("lang").alias("la")), "a").join(source.select(F.col("doc_id").alias("b"), F.col("source").alias("sb"), F.col("lang").alias("lb")), "b")
    return x.select("a", "b", prints.why_same(F.col("likeness"), F.col("sa") == F.col("sb"), F.col("la") == F.col("lb")).alias("why"))


def z1_chapter_finder(spark, d):
    """Chapters whose number is the query, or whose title holds it."""
    p = table(spark, d, "part")
    return p.filter((F.col("p_size") == 12) | F.contains(F.lower("p_name"), F.lit("12")) | F.contains(F.lower("p_type"), F.lit("12"))).select("p_partkey")


def z3_best_copies(spark, d):
    """Of each brand and type the dearest part, ties to the smaller key."""
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("p_partkey"))


def z5_link_sources(spark, d):
    """Pages and the source of their link's host, with the paths that may name the book: the whole, and without its last part."""
    pages = table(spark, d, "pages").select("page_id", F.lower(F.regexp_replace(F.parse_url("url", F.lit("HOST")), r"^www\.", "")).alias("host"), F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit("")).alias("path"))
    hosts = pages.groupBy("host").agg(F.min("page_id").alias("source"))
    return pages.join(hosts, "host").select("page_id", "source", "path", F.regexp_replace("path", "/[^/]*/?$", "").alias("above"))


def z10_pages_without_text(spark, d):
    letters = F.length(F.regexp_replace(F.regexp_replace("html", r"<[^>]*>", ""), r"[^A-Za-z]", ""))
    return table(spark, d, "pages").filter(letters < 2000).select("page_id")


def z12_highlights(spark, d):
    """Marks on rows: an order's lines that a mark of three from the second on covers."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    marks = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(2).alias("start"), F.lit(3).alias("span"))
    return lines.join(marks, "l_orderkey").filter((F.col("l_linenumber") >= F.col("start")) & (F.col("l_linenumber") < F.col("start") + F.col("span"))).select("l_orderkey", "l_linenumber")


def z14_voices(spark, d):
    """Each unit's voice: its speaker's, else the narrator's."""
    voices = spark.createDataFrame([("user", "warm"), ("assistant", "clear")], "role string, voice string")
    return table(spark, d, "conversations").join(F.broadcast(voices), "role", "left").groupBy(F.coalesce("voice", F.lit("narrator")).alias("voice")).agg(F.count("*").alias("n"))


def d4_relative_days(spark, d):
    day = F.datediff(F.lit("2024-01-30").cast("date"), F.to_date("ts"))
    label = F.when(day <= 0, "today").when(day == 1, "yesterday").when(day < 7, "this week").otherwise("earlier")
    return table(spark, d, "events").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def a18_over_cap(spark, d):
    """Readers' days over a cap of 40."""
    use = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("used"))
    return use.filter("used > 40").select("user_id", "day", "used")


_MODES = ["recent", "added", "title", "author", "series", "progress"]
QUERIES = {
    f.__name__: f
    for f in (*map(_order, _MODES), o2_author_keys, f11_series, t14_series_across, t2_phrase, t2_any_in_order, t4_find_where, a2_hits_by_chapter, t1_spans, t1_whole_words, u5_merge_places, u5_merge_titles, u5_merge_removed, u7_added_books, u14_incomplete, k6_sync_records, z11_joined_lists, t12_why_same, z1_chapter_finder, z3_best_copies, z5_link_sources, z10_pages_without_text, z12_highlights, z14_voices, d4_relative_days, a18_over_cap)
}

_TWO = "upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS a, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS b"
_BOOKS = f"""(SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS series, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS i, p_partkey % 97 AS added, p_size % 10 AS progress, p_partkey * 7919 % 2003 AS ordinal,
    CASE p_partkey % 5 WHEN 0 THEN 'van der ' || lower(b) || '|' || lower(a) WHEN 1 THEN lower(b) || '|' || lower(a) WHEN 2 THEN lower(b) || '|' || lower(a) WHEN 3 THEN lower(a) || '|' ELSE '' END AS author FROM (SELECT *, {_TWO} FROM part))"""
_THEN = "lower(coalesce(series, '')), i NULLS LAST, lower(title), id"
_BY = {"recent": "ordinal, id", "added": f"added DESC, {_THEN}", "title": f"lower(title), {_THEN}", "author": f"author = '', replace(author, '|', chr(1)), {_THEN}", "series": f"series IS NULL, {_THEN}", "progress": f"progress DESC, {_THEN}"}
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_REC = """a AS (SELECT c_custkey AS book, c_name AS title, c_custkey * 7 % 101 AS at FROM customer WHERE c_custkey % 4 <> 0),
    b AS (SELECT c_custkey AS book, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE upper(c_name) END AS title, c_custkey * 11 % 101 AS at FROM customer WHERE c_custkey % 3 <> 0)"""

_PAIRS = text.ORACLE_SQL["t11_print_pairs"]

ORACLE_SQL = {
    "t12_why_same": f"""SELECT p.a, p.b, CASE WHEN likeness >= 0.375 THEN 'text' WHEN likeness < 0.12 THEN NULL WHEN x.source = y.source AND x.lang = y.lang THEN 'title' END AS why
        FROM ({_PAIRS}) p JOIN documents x ON x.doc_id = p.a JOIN documents y ON y.doc_id = p.b""",
    "t13_duplicate_groups": f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_PAIRS}) WHERE likeness >= 0.375), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
        SELECT a AS doc_id, least(a, min(b)) AS "group" FROM r GROUP BY a""",
    **{f"o1_by_{m}": f"SELECT id, CAST(row_number() OVER (ORDER BY {_BY[m]}) AS INTEGER) AS place FROM {_BOOKS}" for m in _MODES},
    "o2_author_keys": f"SELECT id, author AS key, split_part(author, '|', 1) AS families FROM {_BOOKS}",
    "f11_series": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN s WHEN 1 THEN s WHEN 2 THEN s END AS series, CASE WHEN p_partkey % 4 < 3 THEN (p_partkey % 5 + 1)::DOUBLE END AS place
        FROM (SELECT p_partkey, 'Saga of ' || upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' Number-' || p_partkey // 5 AS s FROM part)""",
    "t14_series_across": """WITH p AS (SELECT p_partkey AS k, p_partkey // 4 AS g FROM part), n AS (SELECT g, count(*) AS n FROM p WHERE k % 4 < 2 GROUP BY 1), q AS (SELECT count(DISTINCT k % 9) AS q FROM p WHERE k % 4 = 2)
        SELECT k AS p_partkey, CASE k % 4 WHEN 0 THEN CASE WHEN n = 2 THEN 'The First Law of ' || g || 'x' END WHEN 1 THEN 'The First Law of ' || g || 'x' WHEN 2 THEN CASE WHEN q > 1 THEN 'Lone Story Quiet Sea' ELSE 'Quiet Sea' END END AS series,
            CASE k % 4 WHEN 0 THEN CASE WHEN n = 2 THEN 1.0 END WHEN 1 THEN 2.0 WHEN 2 THEN k % 9 + 1.0 END::DOUBLE AS place FROM p LEFT JOIN n USING (g), q""",
    "t2_phrase": f"""SELECT doc_id, CAST(p AS INTEGER) AS phrases, CAST(b AS INTEGER) AS begins FROM (SELECT doc_id, len([i FOR i IN range(1, len(w)) IF w[i] = 'of' AND w[i + 1] = 'the']) AS p, len([x FOR x IN w IF starts_with(x, 'anth')]) AS b
        FROM (SELECT doc_id, {_WORDS} AS w FROM documents)) WHERE p > 0 AND b > 0""",
    "t2_any_in_order": f"""SELECT ch, sec, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM (SELECT conv_id AS ch, turn AS sec, len([x FOR x IN w IF starts_with(x, 'ingth')]) AS a, len([x FOR x IN w IF starts_with(x, 'edle')]) AS b
        FROM (SELECT conv_id, turn, {_WORDS} AS w FROM conversations WHERE conv_id <= 60)) WHERE a > 0 OR b > 0 ORDER BY ch, sec LIMIT 50""",
    "t4_find_where": f"""WITH h AS (SELECT conv_id AS ch, turn AS sec, w, list_min([i FOR i IN range(1, len(w) + 1) IF starts_with(w[i], 'anth')]) AS f FROM (SELECT conv_id, turn, {_WORDS} AS w FROM conversations)),
        s AS (SELECT ch, sec, w, greatest(1, least(f - 4, len(w) - 13)) AS a FROM h WHERE f IS NOT NULL ORDER BY ch, sec LIMIT 300)
        SELECT ch, sec, CASE WHEN a > 1 THEN '…' ELSE '' END || array_to_string(w[a:a + 13], ' ') || CASE WHEN a + 13 < len(w) THEN '…' ELSE '' END AS snippet, (SELECT count(DISTINCT ch) FROM s) AS chapters FROM s""",
    "a2_hits_by_chapter": f"SELECT conv_id AS ch, count(*) AS n FROM (SELECT conv_id, {_WORDS} AS w FROM conversations) WHERE len([x FOR x IN w IF starts_with(x, 'th')]) > 0 AND len([x FOR x IN w IF starts_with(x, 'an')]) > 0 GROUP BY 1",
    "t1_spans": """WITH RECURSIVE t AS (SELECT item_id, lower(text) AS t FROM benchmark), r AS (SELECT item_id, t, position('the' IN t) AS p FROM t WHERE contains(t, 'the')
        UNION ALL SELECT item_id, t, p + 2 + position('the' IN t[p + 3:]) FROM r WHERE contains(t[p + 3:], 'the')) SELECT item_id, CAST(p - 1 AS INTEGER) AS start, CAST(p + 2 AS INTEGER) AS "end" FROM r ORDER BY item_id, start LIMIT 2000""",
    "t1_whole_words": """WITH w AS (SELECT item_id, ' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]', ' ', 'g') || ' ' AS t FROM benchmark),
        h AS (SELECT item_id, unnest([i FOR i IN range(1, length(t) + 1) IF t[i:i + 4] = ' the ']) AS p FROM w) SELECT item_id, CAST(p - 1 AS INTEGER) AS start, CAST(p + 2 AS INTEGER) AS "end" FROM h ORDER BY item_id, start LIMIT 2000""",
    "u5_merge_places": f"WITH {_REC} SELECT coalesce(a.book, b.book) AS book, CASE WHEN b.at IS NULL OR a.at >= b.at THEN 'a' ELSE 'b' END AS cursor, CAST(coalesce(greatest(a.at, b.at), a.at, b.at) AS INTEGER) AS at FROM a FULL JOIN b ON a.book = b.book",
    "u5_merge_titles": f"WITH {_REC} SELECT coalesce(a.book, b.book) AS book, CASE WHEN b.title <> '' THEN b.title ELSE coalesce(a.title, b.title) END AS title FROM a FULL JOIN b ON a.book = b.book",
    "u5_merge_removed": f"""WITH {_REC} SELECT book, CAST(max(x) AS INTEGER) AS "at" FROM (SELECT book, a."at" AS x FROM a UNION ALL SELECT book, b."at" FROM b) GROUP BY 1""",
    "u7_added_books": "SELECT c_custkey AS book, CASE WHEN c_custkey % 4 <> 0 THEN 'a' ELSE 'b' END AS cursor FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 3 <> 0",
    "u14_incomplete": """SELECT o_custkey, CASE WHEN o_custkey % 5 = 0 THEN 'empty' WHEN o_custkey % 7 = 1 THEN 'incomplete' ELSE 'fine' END AS verdict FROM orders WHERE o_custkey % 11 <> 2 OR o_custkey % 5 <> 0 GROUP BY 1""",
    "k6_sync_records": """WITH o AS (SELECT o_custkey AS book, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 7 = 0),
        m AS (SELECT book, string_agg('{"id":"' || id || '","changed":"' || book || '"}', ',' ORDER BY id) AS m FROM o GROUP BY 1), r AS (SELECT book, string_agg('"' || id || '":"2024"', ',' ORDER BY id) AS r FROM o WHERE o_orderkey % 2 = 0 GROUP BY 1),
        d AS (SELECT book, string_agg('"' || day || '":' || n, ',' ORDER BY day) AS d FROM (SELECT book, day, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1)
        SELECT c_custkey AS book, '{' || CASE WHEN c_custkey % 2 = 0 THEN '"title":"' || c_name || '",' ELSE '' END || '"marks":[' || coalesce(m, '') || ']' || coalesce(',"removed":{' || r || '}', '') || coalesce(',"days":{' || d || '}', '') || '}' AS record
        FROM customer LEFT JOIN m ON m.book = c_custkey LEFT JOIN r ON r.book = c_custkey LEFT JOIN d ON d.book = c_custkey""",
    "z11_joined_lists": """SELECT word, coalesce(min(say) FILTER (s = 0), min(say)) AS say FROM (SELECT lower(p_brand) || p_size AS word, p_partkey AS say, p_partkey % 3 AS s FROM part WHERE p_partkey % 3 < 2) GROUP BY 1""",
    "z1_chapter_finder": "SELECT p_partkey FROM part WHERE p_size = 12 OR lower(p_name) LIKE '%12%' OR lower(p_type) LIKE '%12%'",
    "z3_best_copies": "SELECT p_brand, p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1",
    "z5_link_sources": r"""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
        SELECT page_id, min(page_id) OVER (PARTITION BY host) AS source, path, regexp_replace(path, '/[^/]*/?$', '') AS above FROM p""",
    "z10_pages_without_text": "SELECT page_id FROM pages WHERE length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[^A-Za-z]', '', 'g')) < 2000",
    "z12_highlights": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) AND l_linenumber BETWEEN 2 AND 4",
    "z14_voices": "SELECT CASE role WHEN 'user' THEN 'warm' WHEN 'assistant' THEN 'clear' ELSE 'narrator' END AS voice, count(*) AS n FROM conversations GROUP BY 1",
    "d4_relative_days": "SELECT CASE WHEN n <= 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n < 7 THEN 'this week' ELSE 'earlier' END AS label, count(*) AS n FROM (SELECT DATE '2024-01-30' - CAST(ts AS DATE) AS n FROM events) GROUP BY 1",
    "a18_over_cap": "SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 6) AS used FROM events GROUP BY 1, 2 HAVING round(sum(value), 6) > 40",
}
