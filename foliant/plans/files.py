"""Files made from the tables' texts, read again: what comes back is known. Languages, speech, web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import merged_intervals
from ..operators import audio, dialogue, notes, scripts, speech
from ..sources import books, detect, web
from ..sources.tables import table


def _pick(key: str, forms: list):
    out = F
    for i, form in enumerate(forms):
        out = out.when(F.col(key) % len(forms) == i, form)
    return out.otherwise(F.lit(None))


def s5_decoded(spark, d):
    """Documents in UTF-8, in UTF-16 of both orders with a mark, and in UTF-8 with one."""
    t = F.coalesce(F.col("text"), F.lit(""))
    raw = _pick("doc_id", [F.encode(t, "UTF-8"), F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE")), F.concat(F.unhex(F.lit("FEFF")), F.encode(t, "UTF-16BE")), F.concat(F.unhex(F.lit("EFBBBF")), F.encode(t, "UTF-8"))])
    return table(spark, d, "documents").select("doc_id", F.md5(detect.text_of(raw)).alias("print"))


_MAGIC = ["255044462D312E37", "7B5C727466315C616E7369", "41542654464F524D0000", "89504E470D0A1A0A", "664C614300000022", "3C68746D6C3E", "23204865616420", "68656C6C6F20776F726C64", "00010203040506070000000001"]


def s3_formats(spark, d):
    raw = _pick("p_partkey", [F.concat(F.unhex(F.lit(h)), F.encode(F.col("p_name"), "UTF-8")) for h in _MAGIC])
    found = detect.described(table(spark, d, "part").select("p_partkey", raw.alias("content")))
    return found.select("p_partkey", "media", "format", "is_binary")


def _escaped(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def s10_fb2(spark, d):
    x = F.concat(F.lit("<FictionBook><body><section><title><p>"), F.col("item_id").cast("string"), F.lit("</p></title><p>"), _escaped(F.col("text")), F.lit("</p></section></body><body name='notes'><section><p>note</p></section></body></FictionBook>"))
    got = books.books(table(spark, d, "benchmark").select("item_id", F.encode(x, "UTF-8").alias("content")), "item_id")
    return got.select("item_id", "format", "sec", "title", "blk", "role", F.md5("text").alias("print"))


def s12_rtf(spark, d):
    plain = F.regexp_replace(F.col("text"), r"[^ -\[\]-z|~]", "")
    x = F.concat(F.lit("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}\\f0 "), plain, F.lit("\\par last \\b line\\b0\\par}"))
    got = books.books(table(spark, d, "benchmark").select("item_id", F.encode(x, "UTF-8").alias("content")), "item_id")
    return got.select("item_id", "blk", F.md5("text").alias("print"))


def s13_html_blocks(spark, d):
    """Talks as pages: a heading and a paragraph or item a turn."""
    t = table(spark, d, "conversations").filter("text IS NOT NULL")
    line = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<p>"), _escaped(F.col("text")), F.lit("<b>&nbsp;x</b>"))).otherwise(F.concat(F.lit("<ul><li>"), _escaped(F.col("text")), F.lit("</ul>")))
    pages = t.groupBy("conv_id").agg(F.concat(F.lit("<html><head><title>t</title></head><body><h1>Talk</h1>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda v: v["x"]), "")).alias("html"))
    return web.block_rows(pages, "conv_id", "html").select("conv_id", "role", F.md5("text").alias("print"))


def s14_markdown(spark, d):
    body = F.regexp_replace(F.col("text"), r"[^A-Za-z0-9 .,]", "")
    x = F.concat(F.lit("---\na: b\n---\n# Head *"), F.col("item_id").cast("string"), F.lit("*\n\n"), F.lit("It is "), body, F.lit("\n\n- one\n- two\n"))
    return web.block_rows(table(spark, d, "benchmark").select("item_id", x.alias("md")), "item_id", "md", "markdown").select("item_id", "n", "role", F.md5("text").alias("print"))


def t20_articles(spark, d):
    rows = web.block_rows(table(spark, d, "pages"), "page_id", "html", "article")
    return rows.groupBy("page_id").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


def s19_web_chapters(spark, d):
    n = F.col("p_partkey").cast("string")
    page = F.concat(F.lit("<h1>Chapter "), n, F.lit(": "), F.initcap("p_name"), F.lit("</h1><p>Translator: Somebody</p><p>The "), F.col("p_name"), F.lit(" was here.</p><p>* * *</p><p>Previous Chapter</p>"))
    rows = table(spark, d, "part").select("p_partkey", page.alias("html"), F.concat(F.lit("Chapter 0"), n, F.lit(" - "), F.col("p_name")).alias("title"))
    return web.web_chapters(rows, "p_partkey", "html", "title").select("p_partkey", "text")


def s22_imported(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("b"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_name").alias("title"))
    o = table(spark, d, "orders")
    chapters = o.select(F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("book_url"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("position"))
    bodies = o.filter("o_orderkey % 3 <> 0").select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderstatus").alias("body"))
    return books.imported(c, chapters, bodies)


def t7_scripts(spark, d):
    """Part names with letters of a script behind them, and a few in Latin letters beside much of another."""
    forms = [F.lit("বাংলা ভাষা ও সাহিত্য এবং ইতিহাস"), F.lit("Русский язык и литература, мы были там"), F.lit("Українська мова і література, її історія"), F.lit("اردو زبان میں لکھی ہوئی یہ ایک بہت اچھی کہانی ہے"), F.lit("زبان فارسی و گفتگوی پارسی"), F.lit("اللغة العربية الفصيحة في المدرسة"), F.lit("漢字だけではなく、かなも使う"), F.lit("中文是一种语言文字"), F.lit("한국어 문장입니다"), F.concat("p_name", F.lit(" γ")), F.lit("Ελληνική γλώσσα"), F.lit("Српски језик и њихова књижевност")]
    return table(spark, d, "part").select("p_partkey", scripts.script_language(_pick("p_partkey", forms)).alias("language"))


def t9_resolved(spark, d):
    """Documents whose metadata says nothing, something wrong, or the truth."""
    declared = _pick("doc_id", [F.lit(None).cast("string"), F.lit("bn"), F.col("lang"), F.lit("fi-FI")])
    return scripts.resolved(table(spark, d, "documents").withColumn("declared", declared), "doc_id", "text", "declared")


def f3_word_spans(spark, d):
    spans = speech.word_spans(F.concat(F.lit("水。木 "), F.col("text")))
    return table(spark, d, "benchmark").select("item_id", F.size(spans).alias("n"), F.element_at(spans, 3)["start"].alias("third"), F.element_at(spans, -1)["end"].alias("end"))


def f15_speech_hints(spark, d):
    t = F.concat(F.lit("write to a"), F.col("p_partkey").cast("string"), F.lit("@mail.org or see https://x.org/"), F.col("p_partkey").cast("string"), F.lit("?q now [12] \n* * *\n"), F.col("p_name"))
    rows = table(spark, d, "part").select("p_partkey", t.alias("t"), F.explode(speech.speech_hints(t)).alias("h"))
    return rows.select("p_partkey", "h.kind", F.substring("t", F.col("h.start") + 1, F.col("h.end") - F.col("h.start")).alias("said"))


def f16_respelled(spark, d):
    rules = spark.createDataFrame([("the", "thee", 2), ("of the", "o'the", 1), ("anth", "ANTH", 3)], "word string, say string, ordinal int")
    got = speech.respelled(table(spark, d, "benchmark").select("item_id", F.lower("text").alias("text")), "text", rules)
    return got.select("item_id", F.md5("said").alias("print"), F.size("changes").alias("changes"))


def f17_spoken(spark, d):
    """Texts without the stretches that lines of an order name."""
    spans = table(spark, d, "lineitem").groupBy("l_orderkey").agg(merged_intervals(F.collect_list(F.struct((F.col("l_linenumber") * 3).cast("int").alias("start"), (F.col("l_linenumber") * 3 + 2).cast("int").alias("end")))).alias("spans"))
    o = table(spark, d, "orders").join(spans, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select("o_orderkey", speech.without_spans(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), F.col("spans")).alias("said"))


def f18_quiet_lines(spark, d):
    t = F.concat(F.lit("The "), F.col("p_name"), F.lit("!\nTL note: a word\n"), F.col("p_name"), F.lit(" went.\n* * *\n\nA/N: thanks"))
    quiet = speech.quiet_lines(t, F.concat(F.lit("the "), F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", F.array_join(quiet.cast("array<string>"), ",").alias("quiet"))


def f20_quotations(spark, d):
    """Quotations of texts with quotation marks round every fifth word."""
    words = F.split(F.regexp_replace(F.col("text"), "[“”\"«»„「」『』\n]", ""), " ")
    quoted = F.array_join(F.transform(words, lambda w, i: F.when(i % 5 == 2, F.concat(F.lit("“"), w, F.lit("”"))).otherwise(w)), " ")
    rows = dialogue.quotation_rows(table(spark, d, "benchmark").select("item_id", quoted.alias("text")), "item_id", "text")
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"), F.count_if("closed").alias("closed"))


def a12_running_heads(spark, d):
    """Lines that stand at the top of three pages or more, and of three in ten: turns are pages of a talk."""
    t = table(spark, d, "conversations")
    heads = t.select("conv_id", "turn", F.explode(F.array(F.concat(F.lit("Talk "), F.col("conv_id").cast("string")), F.concat(F.lit("Part "), F.floor(F.col("turn") / 4).cast("string")), F.col("role"))).alias("head"))
    key = F.regexp_replace(F.lower("head"), "[0-9]+", "#")
    pages = t.groupBy("conv_id").agg(F.countDistinct("turn").alias("pages"))
    n = heads.groupBy("conv_id", key.alias("head")).agg(F.countDistinct("turn").alias("n"))
    return n.join(pages, "conv_id").filter(F.col("n") >= F.greatest(F.lit(3.0), F.ceil(F.col("pages") * 0.3))).select("conv_id", "head", "n")


def x1_objects(spark, d):
    """The first object of a reply, with or without fences, words, loose braces and other objects around it; parts of the wrong kind are null."""
    body = F.concat(F.lit('{"summary": "'), F.col("p_name"), F.lit('", "size": '), F.when(F.col("p_partkey") % 5 == 0, '"big"').otherwise(F.col("p_size").cast("string")), F.lit("}"))
    reply = _pick("p_partkey", [body, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")), F.concat(F.lit("```\n"), body, F.lit("```")), F.lit("I can't say."), F.concat(F.lit("As {asked}: "), body, F.lit(' and {more}, as {"summary": "other"}')), F.lit("{no} {object}")])
    said = notes.first_objects(table(spark, d, "part").select("p_partkey", reply.alias("reply")), "reply", "json")
    rows = said.select("p_partkey", F.from_json("json", "summary string, size int").alias("o"))
    return rows.filter("o.summary IS NOT NULL").select("p_partkey", "o.summary", "o.size")


def t24_relocated(spark, d):
    """Where a turn's text is in a talk read again: the same text, a turn that holds it, one with its opening words, or in proportion."""
    old = table(spark, d, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", "text", F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    changed = _pick("turn", [F.col("text"), F.concat(F.lit("Well, "), F.col("text")), F.concat(F.array_join(F.slice(F.split("text", " "), 1, 4), " "), F.lit(" and then all else")), F.lit("another thing")])
    new = old.select("conv_id", (F.col("turn") + 1).alias("at"), changed.alias("now"))
    opening = lambda c: F.array_join(F.slice(F.split(c, " "), 1, 4), " ")
    near = old.join(new, "conv_id").filter(F.abs(F.col("at") - F.col("turn")) <= 8)  # a place moves little; no talk meets itself whole
    rank = F.when(F.col("text") == F.col("now"), 0).when(F.contains("now", F.col("text")), 1).when(opening(F.col("text")) == opening(F.col("now")), 2)
    best = near.withColumn("rank", rank).filter("rank IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.struct("rank", F.abs(F.col("at") - F.col("turn")).alias("far"), "at")).alias("b"))
    return old.join(best, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("b.rank", F.lit(3)).alias("rank"), F.coalesce("b.at", F.col("turn")).alias("at"))


def q2_measured(spark, d):
    """Clips of 16-bit sound, a tenth of a second of one level and one of a hum of 10 steps, by order: the hum is silence only beside a loud voice."""
    head = bytes.fromhex("52494646") + (36 + 3200).to_bytes(4, "little") + b"WAVEfmt " + bytes.fromhex("10000000" "01000100" "401F0000" "803E0000" "02001000") + b"data" + (3200).to_bytes(4, "little")
    level = F.lpad(F.hex(((F.col("o_orderkey") % 30 + 1) * 400).cast("int")), 4, "0")
    sample = F.concat(F.substring(level, 3, 2), F.substring(level, 1, 2))
    content = F.unhex(F.concat(F.lit(head.hex()), F.repeat(sample, 800), F.repeat(F.lit("0a00"), 800)))
    m = audio.measured(table(spark, d, "orders").select("o_orderkey", content.alias("content")), "o_orderkey", "content")
    return m.select("o_orderkey", "rate", F.round("seconds", 6).alias("seconds"), F.round("peak", 6).alias("peak"), F.round("rms", 6).alias("rms"), F.round("largest_step", 6).alias("step"), F.round(F.get("silences", F.lit(0))["start"], 6).alias("quiet_from"))


QUERIES = {
    f.__name__: f
    for f in (q2_measured, s5_decoded, s3_formats, s10_fb2, s12_rtf, s13_html_blocks, s14_markdown, t20_articles, s19_web_chapters, s22_imported, t7_scripts, t9_resolved, f3_word_spans, f15_speech_hints, f16_respelled, f17_spoken, f18_quiet_lines, f20_quotations, a12_running_heads, x1_objects, t24_relocated)
}

_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"

ORACLE_SQL = {
    "q2_measured": """SELECT o_orderkey, 8000 AS rate, 0.2::DOUBLE AS seconds, round(x / 32768, 6) AS peak, round(sqrt((x * x + 100) / 2) / 32768, 6) AS rms, round((x - 10) / 32768, 6) AS step, CASE WHEN 20 * log10(10 / x) < -50 THEN 0.1::DOUBLE END AS quiet_from
        FROM (SELECT o_orderkey, ((o_orderkey % 30 + 1) * 400)::DOUBLE AS x FROM orders)""",
    "s5_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS print FROM documents",
    "s3_formats": """SELECT p_partkey, CASE p_partkey % 9 WHEN 3 THEN 'picture' WHEN 4 THEN 'audio' END AS media, CASE p_partkey % 9 WHEN 0 THEN 'pdf' WHEN 1 THEN 'rtf' WHEN 2 THEN 'djvu' WHEN 3 THEN 'unknown' WHEN 4 THEN 'unknown' WHEN 5 THEN 'html' WHEN 6 THEN 'markdown' ELSE 'text' END AS format,
        p_partkey % 9 IN (2, 4, 8) AS is_binary FROM part""",
    "s10_fb2": r"""SELECT item_id, 'fb2' AS format, 0 AS sec, CAST(item_id AS VARCHAR) AS title, CAST(b AS INTEGER) AS blk, CASE b WHEN 0 THEN 'heading' ELSE 'paragraph' END AS role, md5(CASE b WHEN 0 THEN CAST(item_id AS VARCHAR) ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END) AS print FROM benchmark, range(2) t(b)""",
    "s12_rtf": r"""SELECT item_id, CAST(b AS INTEGER) AS blk, md5(CASE b WHEN 0 THEN trim(regexp_replace(regexp_replace(text, '[^ -\[\]-z|~]', '', 'g'), ' +', ' ', 'g')) ELSE 'last line' END) AS print FROM benchmark, range(2) t(b)""",
    "s13_html_blocks": r"""SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'paragraph' ELSE 'item' END AS role, md5(trim(regexp_replace(text, '\s+', ' ', 'g')) || CASE WHEN turn % 2 = 0 THEN ' x' ELSE '' END) AS print FROM conversations WHERE text IS NOT NULL
        UNION ALL SELECT DISTINCT conv_id, 'heading', md5('Talk') FROM conversations WHERE text IS NOT NULL""",
    "s14_markdown": r"""SELECT item_id, CAST(n AS INTEGER) AS n, CASE n WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' ELSE 'item' END AS role, md5(CASE n WHEN 0 THEN 'Head ' || item_id WHEN 1 THEN trim(regexp_replace('It is ' || regexp_replace(text, '[^A-Za-z0-9 .,]', '', 'g'), ' +', ' ', 'g')) WHEN 2 THEN 'one' ELSE 'two' END) AS print FROM benchmark, range(4) t(n)""",
    "s19_web_chapters": "SELECT p_partkey, 'The ' || p_name || ' was here.' AS text FROM part",
    "s22_imported": "SELECT c_name AS book, o_orderkey AS place, o_orderpriority AS title, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS text FROM orders JOIN customer ON c_custkey = o_custkey",
    "t7_scripts": "SELECT p_partkey, ['bn', 'ru', 'uk', 'ur', 'fa', 'ar', 'ja', 'zh', 'ko', NULL, 'el', 'sr'][p_partkey % 12 + 1] AS language FROM part",
    "f3_word_spans": r"SELECT item_id, CAST(len(regexp_extract_all(text, '\S+')) + 2 AS INTEGER) AS n, CAST(4 + length(regexp_extract(text, '^\s*')) AS INTEGER) AS third, CAST(4 + length(regexp_replace(text, '\s+$', '')) AS INTEGER) AS \"end\" FROM benchmark".replace('\\"', '"'),
    "f15_speech_hints": """SELECT p_partkey, k[1] AS kind, k[2] AS said FROM (SELECT p_partkey, unnest([['email', 'a' || p_partkey || '@mail.org'], ['url', 'https://x.org/' || p_partkey || '?q'], ['citation', '[12]'], ['symbols', '* * *']]) AS k FROM part)""",
    "f16_respelled": r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w, regexp_split_to_array(' ' || lower(text) || ' ', '[\p{L}\p{N}]+') AS g FROM benchmark),
        m AS (SELECT item_id, w, g, [i > 1 AND w[i - 1] = 'of' AND w[i] = 'the' AND g[i] = ' ' FOR i IN range(1, len(w) + 1)] AS second FROM w),
        p AS (SELECT item_id, w, g, second, [CASE WHEN second[i] THEN '' WHEN i < len(w) AND second[i + 1] THEN 'o''the' WHEN w[i] = 'the' THEN 'thee' WHEN w[i] = 'anth' THEN 'ANTH' ELSE w[i] END FOR i IN range(1, len(w) + 1)] AS said,
            [CASE WHEN i <= len(w) AND second[i] THEN '' ELSE g[i] END FOR i IN range(1, len(g) + 1)] AS gap FROM m)
        SELECT item_id, md5(x[2:length(x) - 1]) AS print, CAST(n AS INTEGER) AS changes FROM (SELECT item_id, array_to_string([gap[i] || coalesce(said[i], '') FOR i IN range(1, len(gap) + 1)], '') AS x, len([i FOR i IN range(1, len(w) + 1) IF NOT second[i] AND said[i] <> w[i]]) AS n FROM p)""",
    "f17_spoken": "SELECT l_orderkey AS o_orderkey, array_to_string([CASE WHEN list_contains(l, i // 3) AND i % 3 < 2 THEN '' ELSE 'abcdefghijklmnopqrstuvwxyz0123456789'[i + 1] END FOR i IN range(0, 36)], '') AS said FROM (SELECT l_orderkey, list(l_linenumber) AS l FROM lineitem GROUP BY 1)",
    "f18_quiet_lines": "SELECT p_partkey, 'true,true,false,true,false,true' AS quiet FROM part",
    "f20_quotations": r"""WITH w AS (SELECT item_id AS id, string_split(regexp_replace(text, '[“”"«»„「」『』\n]', '', 'g'), ' ') AS w FROM benchmark), q AS (SELECT id, [length(w[i]) + 2 FOR i IN range(3, len(w) + 1, 5)] AS q FROM w)
        SELECT id, len(q) AS n, CAST(list_sum(q) AS BIGINT) AS chars, len(q) AS closed FROM q WHERE len(q) > 0""",
    "a12_running_heads": """WITH p AS (SELECT conv_id, count(DISTINCT turn) AS p FROM conversations GROUP BY 1), h AS (SELECT conv_id, turn, unnest(['talk #', 'part #', role]) AS head FROM conversations)
        SELECT conv_id, head, count(DISTINCT turn) AS n FROM h JOIN p USING (conv_id) GROUP BY conv_id, head, p HAVING count(DISTINCT turn) >= greatest(3, ceil(p * 0.3))""",
    "t24_relocated": """WITH o AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL), n AS (SELECT conv_id, turn + 1 AS place, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN 'Well, ' || text WHEN 2 THEN array_to_string(string_split(text, ' ')[1:4], ' ') || ' and then all else' ELSE 'another thing' END AS now FROM o),
        m AS (SELECT o.conv_id, o.turn, place, abs(place - turn) AS far, CASE WHEN text = now THEN 0 WHEN contains(now, text) THEN 1 WHEN array_to_string(string_split(text, ' ')[1:4], ' ') = array_to_string(string_split(now, ' ')[1:4], ' ') THEN 2 END AS rank FROM o JOIN n ON n.conv_id = o.conv_id AND abs(place - turn) <= 8),
        b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY rank, far, place) AS r FROM m WHERE rank IS NOT NULL)
        SELECT o.conv_id, o.turn, CAST(coalesce(rank, 3) AS INTEGER) AS rank, coalesce(place, o.turn) AS "at" FROM o LEFT JOIN b ON b.conv_id = o.conv_id AND b.turn = o.turn AND r = 1""",
    "x1_objects": "SELECT p_partkey, p_name AS summary, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS size FROM part WHERE p_partkey % 6 IN (0, 1, 2, 4)",
}
