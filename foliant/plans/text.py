"""Texts, pages, talks and vectors over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions.hashes import fnv1a, murmur_final
from ..functions.vectors import packed
from ..operators import language, prints, search, units
from ..sources.tables import table
from .folding import folded

STOP_WORDS = sorted({w for words in language.STOP_WORDS.values() for w in words})
QUESTION = "Where is the letter that the onwhed ingthe wrote, and the thering of it?"
_WORDS = r"list_filter(regexp_split_to_array({}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def f1_collapsed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(fn.collapse_space(F.col("text"))).alias("print"))


def f4_word_counts(spark, d):
    """Documents with letters of scripts without spaces behind them, by doc_id."""
    wide, thai = F.repeat(F.lit("水"), (F.col("doc_id") % 7).cast("int")), F.repeat(F.lit("ก"), (F.col("doc_id") % 4).cast("int"))
    return table(spark, d, "documents").select("doc_id", fn.count_words(F.concat("text", F.lit(" "), wide, F.lit("。 "), thai)).alias("words"))


def f5_folded(spark, d):
    text = F.concat(F.lit("ŁÓDŹ Øre, Ħal’s “ıŋŧ” ŉ ŀ Đ ș "), "text")
    return table(spark, d, "documents").select("doc_id", F.md5(fn.fold_for_search(text)).alias("print"))


def f9_title_keys(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, d, "pages").select("page_id", fn.title_key(title).alias("key"))


def z5_hosts(spark, d):
    return table(spark, d, "pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("n"))


def f24_link_kinds(spark, d):
    return table(spark, d, "documents").groupBy(fn.link_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


def h1_word_hashes(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(fn.plain_words(F.col("text"))).alias("word")).distinct()
    return words.select("word", fnv1a(F.col("word")).alias("fnv"), murmur_final(fnv1a(F.col("word"))).alias("mixed"))


def h3_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("id"), F.sha1("text").alias("sha1"))


def t10_text_prints(spark, d):
    return prints.text_prints(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.array_join(F.col("print").cast("array<string>"), ",").alias("print"))


def t11_print_pairs(spark, d):
    p = prints.text_prints(table(spark, d, "documents"), "doc_id", "text")
    return prints.print_pairs(p, "doc_id").select("a", "b", F.round("likeness", 6).alias("likeness"))


def j9_candidate_pairs(spark, d):
    docs = table(spark, d, "documents")
    titles = docs.select("doc_id", F.lower(F.substring_index("text", " ", 2)).alias("key"))
    return prints.candidate_pairs(prints.text_prints(docs, "doc_id", "text"), titles, "doc_id", "key")


def t13_duplicate_groups(spark, d):
    return prints.duplicate_groups(prints.text_prints(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


def a13_marked_majority(spark, d):
    return language.marked_majority(table(spark, d, "documents"), "source", "lang", "n_chars")


def t9_language(spark, d):
    return language.by_stop_words(table(spark, d, "documents"), "doc_id", "text")


def t1_hits(spark, d):
    return search.hit_counts(table(spark, d, "documents"), "doc_id", "text", "THÉ")


def t2_ranked(spark, d):
    return search.ranked(table(spark, d, "documents"), "doc_id", "text", ["anth", "ingth"], 10)


def t2_ranked_any(spark, d):
    return search.ranked(table(spark, d, "documents"), "doc_id", "text", ["réeux", "keit"], 10, every=False)


def t3_hits_by_source(spark, d):
    found = search.matching(table(spark, d, "documents"), "text", "anth")
    return found.groupBy("source").agg(F.countDistinct("doc_id").alias("docs"), F.sum("h0").alias("hits"))


def t5_nearest(spark, d):
    e = table(spark, d, "embeddings")
    return search.nearest_to(e, "vec_id", "embedding", e.filter("vec_id = 0"), 6)


def v2_packed(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", packed(F.col("embedding")).alias("p"))
    return p.select("vec_id", F.round("p.scale", 9).alias("scale"), F.aggregate("p.codes", F.lit(0), lambda s, x: s + F.abs(x)).alias("size"))


def j15_named(spark, d):
    first = F.array_join(F.slice(fn.plain_words(fn.fold_for_search(F.col("text"))), 1, 3), " ")
    names = table(spark, d, "benchmark").select(first.alias("name"), F.col("item_id").alias("entity"))
    return search.named_in(table(spark, d, "documents"), "doc_id", "text", names, "name", "entity", 3)


def t17_name_cards(spark, d):
    """For each word of a part's name: the part with the longest name that has it."""
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return search.name_cards(words, "word", table(spark, d, "part"), "p_name", "p_partkey")


def f23_relevance(spark, d):
    words = fn.search_words(F.lit(QUESTION), STOP_WORDS)
    talk = table(spark, d, "conversations").select("conv_id", "turn", fn.match_score(words, fn.norm_name(F.col("text"))).alias("s"))
    return talk.select("conv_id", "turn", F.round("s", 6).alias("score")).filter("score > 0")


def n1_next_turn_likeness(spark, d):
    talk = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(fn.plain_words(F.col("text"))).alias("w"))
    after = F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))
    return talk.withColumn("n", after).select("conv_id", "turn", F.round(fn.word_likeness(F.col("w"), F.col("n")), 6).alias("likeness")).filter("likeness IS NOT NULL")


def k3_talk_export(spark, d):
    """A talk as Markdown, in its own order."""
    said = F.concat(F.lit("**"), F.col("role"), F.lit(":** "), F.col("text"))
    turns = F.array_sort(F.collect_list(F.struct("turn", said.alias("said"))))  # a talk is one document in the end, so its turns meet
    body = F.array_join(F.transform(turns, lambda t: t["said"]), "\n\n")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.md5(body).alias("print"))


def p2_units(spark, d):
    return units.units(table(spark, d, "documents"))


def w9_chunks(spark, d):
    return units.chunks(table(spark, d, "documents"))


def t25_sections(spark, d):
    """Talks as books: a heading before every fifth turn."""
    t = table(spark, d, "conversations").filter("text IS NOT NULL")
    headed = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("Chapter "), F.col("turn").cast("string"), F.lit("\n"))).otherwise("")
    books = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(headed, F.replace("text", F.lit("\n"), F.lit(" "))).alias("x")))), lambda v: v["x"]), "\n").alias("text"))
    return units.sections(books, "conv_id", "text").select("id", "sec", "title", "words")


def f13_chapter_lines(spark, d):
    n = (F.col("p_partkey") % 40 + 1).cast("string")
    forms = [F.concat(F.lit("Chapter "), n), F.concat(F.lit("KAPITEL "), n, F.lit(": "), F.col("p_name")), F.concat(F.lit("Chapter one was the best. It had "), F.col("p_name"), F.lit(" and more of it in the end")), F.lit("Prologue"), F.concat(F.lit("The chapter "), n), F.concat(F.lit("第"), n, F.lit("章")), F.concat(F.lit("Part IV of "), F.repeat(F.lit("very long "), 12)), F.concat(F.lit("Chapters "), n)]
    line = F
    for i, form in enumerate(forms):
        line = line.when(F.col("p_partkey") % len(forms) == i, form)
    return table(spark, d, "part").select("p_partkey", units.looks_like_chapter_line(line.otherwise(F.lit(""))).alias("named"))


def a14_document_words(spark, d):
    u = units.units(table(spark, d, "documents"))
    return u.groupBy("id").agg(F.sum(fn.count_words(F.col("text"))).cast("long").alias("words"))


def w4_words_before(spark, d):
    u = units.units(table(spark, d, "documents")).withColumn("words", fn.count_words(F.col("text")))
    return units.words_before(u, "words").select("id", "blk", "sen", "words", "before")


QUERIES = {f.__name__: f for f in (f1_collapsed, f4_word_counts, f5_folded, f9_title_keys, z5_hosts, f24_link_kinds, h1_word_hashes, h3_ids, t10_text_prints, t11_print_pairs, j9_candidate_pairs, t13_duplicate_groups, a13_marked_majority, t9_language, t1_hits, t2_ranked, t2_ranked_any, t3_hits_by_source, t5_nearest, v2_packed, j15_named, t17_name_cards, f23_relevance, n1_next_turn_likeness, k3_talk_export, p2_units, w9_chunks, t25_sections, f13_chapter_lines, a14_document_words, w4_words_before)}

_BM25 = """WITH t AS (SELECT doc_id, {words} AS w FROM documents {where}), c AS (SELECT doc_id, len(w) AS size, {counts} FROM t),
    s AS (SELECT count(*) AS docs, avg(size) AS mean, count(*) FILTER (n0 > 0) AS d0, count(*) FILTER (n1 > 0) AS d1 FROM c)
    SELECT doc_id, round(ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * n0 * 2.2 / (n0 + 1.2 * (0.25 + 0.75 * size / mean)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * n1 * 2.2 / (n1 + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS score
    FROM c, s WHERE n0 > 0 {op} n1 > 0 ORDER BY score DESC, doc_id LIMIT 10"""


def _bm25(prefixes, where, op):
    counts = ", ".join(f"len(list_filter(w, lambda x: starts_with(x, '{p}'))) AS n{i}" for i, p in enumerate(prefixes))
    return _BM25.format(words=_WORDS.format(folded("text")).replace("{{", "{").replace("}}", "}"), where=where, counts=counts, op=op)


_FNV = "list_reduce(list_prepend(2166136261::UBIGINT, [unicode(c)::UBIGINT FOR c IN string_split({}, '')]), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
_MIX1 = "(xor({0}, {0} >> 16)::HUGEINT * 2246822507 % 4294967296)::UBIGINT"
_MIX2 = "(xor({0}, {0} >> 13)::HUGEINT * 3266489909 % 4294967296)::UBIGINT"
_DOC_WORDS = _WORDS.format("lower(text)")
_PRINTS = f"""SELECT doc_id, list_sort(list_distinct(list(m)))[1:16] AS print FROM (
    SELECT doc_id, xor(b, b >> 16)::BIGINT AS m FROM (SELECT doc_id, {_MIX2.format("a")} AS b FROM (SELECT doc_id, {_MIX1.format("h")} AS a FROM (
    SELECT doc_id, list_reduce(list_prepend(2166136261::UBIGINT, list(f) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h, i FROM (
    SELECT doc_id, i, f FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {_DOC_WORDS} AS w FROM documents) WHERE len(w) >= 200) JOIN hashes USING (word))
    ) WHERE i >= 5))) GROUP BY doc_id"""
_HASHES = f"hashes AS (SELECT word, {_FNV.format('word')} AS f FROM (SELECT DISTINCT unnest({_DOC_WORDS}) AS word FROM documents))"
_LEXICON = " UNION ALL ".join(f"SELECT '{w}' AS word, '{lang}' AS lang" for lang, words in language.STOP_WORDS.items() for w in words)
_SEARCHED = [w for w in QUESTION.lower().replace(",", " ").replace("?", " ").split() if len(w) > 2 and w not in STOP_WORDS][:8]
# The parts of names by kind of link, as SQL reads them.
_KIND = """CASE WHEN regexp_matches(lower(text), 'enem|rival|betray|hunt|oppos|against|distrust|hate|kill|fight|feud|war') THEN 'conflict'
    WHEN regexp_matches(lower(text), 'parent|child|sibling|brother|sister|father|mother|son|daughter|family|married|spouse|wife|husband|cousin|uncle|aunt|grand') THEN 'family'
    WHEN regexp_matches(lower(text), 'member|leader|serv|owns|owner|bound|belong|part of|rules|works for|keeper|commands|head of|citizen|resident') THEN 'belongs'
    WHEN regexp_matches(lower(text), 'ally|allie|friend|love|trust|mentor|companion|protect|partner|lover|admire|loyal|help|saved') THEN 'bond' ELSE 'other' END"""

ORACLE_SQL = {
    "a14_document_words": "SELECT doc_id AS id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS words FROM documents WHERE len(regexp_extract_all(text, '\\S+')) > 0",
    "f13_chapter_lines": "SELECT p_partkey, p_partkey % 8 IN (0, 1, 3, 5) AS named FROM part",
    "t25_sections": """WITH s AS (SELECT conv_id AS id, turn, len(regexp_extract_all(text, '\\S+')) AS w, count(*) FILTER (turn % 5 = 0) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec FROM conversations WHERE text IS NOT NULL)
        SELECT id, CAST(sec AS INTEGER) AS sec, CASE WHEN min(turn) % 5 = 0 THEN 'Chapter ' || min(turn) END AS title, CAST(sum(w) + count(*) FILTER (turn % 5 = 0) * 2 AS BIGINT) AS words FROM s GROUP BY id, sec""",
    "f1_collapsed": "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS print FROM documents",
    "f4_word_counts": "SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) + (doc_id % 7 * 5 + 4) // 9 + (doc_id % 4 + 2) // 5 AS INTEGER) AS words FROM documents",
    "f5_folded": "SELECT doc_id, md5('lodz ore, hal' || chr(39) || 's ' || chr(34) || 'iŋt' || chr(34) || ' n l d s ' || " + folded("text") + ") AS print FROM documents",
    "f9_title_keys": f"""WITH t AS (SELECT page_id, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[(\\[][^()\\[\\]]*[)\\]]', ' ', 'g') AS t FROM pages),
        m AS (SELECT page_id, CASE WHEN regexp_matches(t, '^[\\s\\S]{{4,}}?(:| - | – | — )') THEN regexp_extract(t, '^([\\s\\S]{{4,}}?)(:| - | – | — )', 1) ELSE t END AS t FROM t)
        SELECT page_id, regexp_replace(trim(regexp_replace(replace({folded('t')}, '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '^(the|a|an) ', '') AS key FROM m""",
    "z5_hosts": "SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1",
    "f24_link_kinds": f"SELECT {_KIND} AS kind, count(*) AS n FROM documents GROUP BY 1",
    "h1_word_hashes": f"""WITH w AS (SELECT DISTINCT unnest({_DOC_WORDS}) AS word FROM benchmark), f AS (SELECT word, {_FNV.format('word')} AS f FROM w),
        a AS (SELECT word, f, {_MIX1.format('f')} AS a FROM f), b AS (SELECT word, f, {_MIX2.format('a')} AS b FROM a)
        SELECT word, f::BIGINT AS fnv, xor(b, b >> 16)::BIGINT AS mixed FROM b""",
    "h3_ids": "SELECT doc_id, sha256(text)[1:16] AS id, sha1(text) AS sha1 FROM documents",
    "t10_text_prints": f"WITH {_HASHES} SELECT doc_id, array_to_string(print, ',') AS print FROM ({_PRINTS})",
    "t11_print_pairs": f"""WITH {_HASHES}, p AS ({_PRINTS}), b AS (SELECT doc_id, unnest(print) AS h FROM p), u AS (SELECT h FROM b GROUP BY h HAVING count(*) BETWEEN 2 AND 40),
        k AS (SELECT doc_id, h FROM b WHERE h IN (SELECT h FROM u)), pairs AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y ON x.h = y.h AND x.doc_id < y.doc_id),
        l AS (SELECT a, b, list_sort(list_distinct(list_concat(x.print, y.print)))[1:16] AS s, x.print AS px, y.print AS py FROM pairs JOIN p x ON a = x.doc_id JOIN p y ON b = y.doc_id)
        SELECT a, b, round(len(list_intersect(list_intersect(s, px), py)) / len(s), 6) AS likeness FROM l""",
    "j9_candidate_pairs": f"""WITH {_HASHES}, p AS ({_PRINTS}), b AS (SELECT doc_id, 'h' || unnest(print) AS k FROM p UNION ALL SELECT doc_id, 't' || t FROM (SELECT doc_id, lower(array_to_string(string_split(text, ' ')[1:2], ' ')) AS t FROM documents) WHERE t <> ''),
        u AS (SELECT k FROM b GROUP BY k HAVING count(*) BETWEEN 2 AND 40), x AS (SELECT * FROM b WHERE k IN (SELECT k FROM u)) SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM x JOIN x y ON x.k = y.k AND x.doc_id < y.doc_id""",
    "a13_marked_majority": "SELECT source, lang, n FROM (SELECT source, lang, CAST(sum(n_chars) AS BIGINT) AS n, row_number() OVER (PARTITION BY source ORDER BY sum(n_chars) DESC, lang) AS r FROM documents GROUP BY 1, 2) WHERE r = 1",
    "t9_language": f"""WITH x AS ({_LEXICON}), l AS (SELECT word, lang, 1.0::DOUBLE / count(*) OVER (PARTITION BY word) AS weight FROM x),
        w AS (SELECT doc_id, lang, round(sum(weight), 6) AS w FROM (SELECT doc_id, unnest({_DOC_WORDS}) AS word FROM documents) JOIN l USING (word) GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, lang) AS r FROM w),
        t AS (SELECT doc_id, max(CASE WHEN r = 1 THEN lang END) AS lang, max(CASE WHEN r = 1 THEN w END) AS w1, coalesce(max(CASE WHEN r = 2 THEN w END), 0) AS w2 FROM r GROUP BY 1)
        SELECT d.doc_id, CASE WHEN w1 >= 4 AND w1 >= w2 * 1.5 THEN t.lang END AS lang_found FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id""",
    "t1_hits": f"SELECT doc_id, CAST((length(t) - length(replace(t, 'the', ''))) // 3 AS INTEGER) AS hits FROM (SELECT doc_id, {folded('text')} AS t FROM documents) WHERE contains(t, 'the')",
    "t2_ranked": _bm25(["anth", "ingth"], "", "AND"),
    "t2_ranked_any": _bm25(["réeux", "keit"], "", "OR"),
    "t3_hits_by_source": f"SELECT source, count(DISTINCT doc_id) AS docs, count(*) AS hits FROM (SELECT doc_id, source, unnest({_WORDS.format(folded('text'))}) AS t FROM documents) WHERE starts_with(t, 'anth') GROUP BY 1",
    "t5_nearest": "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 6",
    "v2_packed": "SELECT vec_id, round(s, 9) AS scale, CAST(list_sum([abs(round(x::DOUBLE / s)) FOR x IN embedding]) AS INTEGER) AS size FROM (SELECT vec_id, embedding, list_max([abs(x::DOUBLE) FOR x IN embedding]) / 127.0::DOUBLE AS s FROM embeddings)",
    "j15_named": f"""WITH n AS (SELECT array_to_string(({_WORDS.format(folded('text'))})[1:3], ' ') AS name, item_id AS entity FROM benchmark), t AS (SELECT doc_id, ' ' || array_to_string({_WORDS.format(folded('text'))}, ' ') || ' ' AS t FROM documents)
        SELECT doc_id, entity FROM t JOIN n ON contains(t, ' ' || name || ' ')""",
    "t17_name_cards": "SELECT word, p_partkey FROM (SELECT word, p_partkey, row_number() OVER (PARTITION BY word ORDER BY length(p_name) DESC, p_name, p_partkey) AS r FROM (SELECT unnest(string_split(p_name, ' ')) AS word, p_name, p_partkey FROM part)) WHERE r = 1",
    "f23_relevance": f"""SELECT conv_id, turn, score FROM (SELECT conv_id, turn, round(({' + '.join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in _SEARCHED)}) / {len(_SEARCHED)}.0::DOUBLE, 6) AS score
        FROM (SELECT conv_id, turn, trim(regexp_replace({folded('text')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t FROM conversations)) WHERE score > 0""",
    "n1_next_turn_likeness": f"""WITH w AS (SELECT conv_id, turn, list_distinct({_DOC_WORDS}) AS w FROM conversations), n AS (SELECT conv_id, turn, w, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM w)
        SELECT conv_id, turn, round(len(list_intersect(w, n)) / len(list_distinct(list_concat(w, n))), 6) AS likeness FROM n WHERE len(w) > 0 AND len(n) > 0""",
    "k3_talk_export": "SELECT conv_id, md5(string_agg('**' || role || ':** ' || text, chr(10) || chr(10) ORDER BY turn)) AS print FROM conversations GROUP BY 1",
}
