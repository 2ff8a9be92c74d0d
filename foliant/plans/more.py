"""Names and their owners, notes from replies, what a reader asked, theories, indexes that are kept up to date, feeds and clips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import ledger, search, temporal
from ..operators.links import shared_dir
from ..sources import books
from ..sources.tables import table
from ..streaming import days
from . import memory


def f8_name_tests(spark, d):
    w = F.split(F.initcap("p_name"), " ")
    forms = [F.initcap("p_name"), F.concat(F.lit("her "), F.col("p_name")), F.lit("she"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")), F.concat(F.lit("the masked "), w[0]), F.concat(F.lit("Lady "), w[0]), F.lit("Lord"), w[0], F.lower(w[0])]
    c = F
    for i, form in enumerate(forms):
        c = c.when(F.col("p_partkey") % len(forms) == i, form)
    c = c.otherwise(F.lit(""))
    return table(spark, d, "part").select("p_partkey", names.not_a_name(c).alias("number"), names.keeps_as_name(c).alias("kept"), names.looks_described(c).alias("described"), names.is_proper_name(c).alias("proper"))


def z2_contents_parts(spark, d):
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Part One: "), F.col("p_name"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_brand"), F.lit(" – "), F.col("p_name"))).otherwise(F.col("p_name"))
    p = table(spark, d, "part").select("p_partkey", names.part_of_contents(line).alias("x"))
    return p.select("p_partkey", "x.part", "x.name")


def x2_notes(spark, d):
    """Notes from a model's replies: an object with a summary for its chapter, and the entities that have a kind and a name; other parts are dropped."""
    entity = lambda kind, name: F.concat(F.lit('{"kind": '), kind, F.lit(', "name": "'), name, F.lit('"}'))
    good = entity(F.lit('"person"'), F.col("c_name"))
    bad = F.when(F.col("c_custkey") % 3 == 0, entity(F.lit("null"), F.lit("x"))).otherwise(F.lit('{"kind": "place"}'))
    summary = F.when(F.col("c_custkey") % 5 == 0, F.lit("null")).otherwise(F.concat(F.lit('"Of '), F.col("c_mktsegment"), F.lit('"')))
    reply = F.concat(F.lit('```json\n{"summary": '), summary, F.lit(', "entities": ['), good, F.lit(", "), bad, F.lit("]}\n```"))
    found = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "summary string, entities array<struct<kind:string,name:string>>")
    rows = table(spark, d, "customer").select("c_custkey", found.alias("n")).filter("n.summary IS NOT NULL")
    kept = F.filter("n.entities", lambda e: e["kind"].isNotNull() & (F.coalesce(e["name"], F.lit("")) != ""))
    return rows.select("c_custkey", "n.summary", F.size(kept).alias("entities"), kept[0]["name"].alias("first"))


def t18_resolved_names(spark, d):
    """Whom a name means: the live entity that answers to it, of the kind asked for if there is one, else the most seen, else the smallest id."""
    e = memory._entities(spark, d).filter("merged_into IS NULL").select(F.col("id").alias("entity"), "kind")
    seen = ledger.seen(memory._appearances(spark, d), 999).select(F.col("id").alias("entity"), "seen")
    aliases = memory._aliases(spark, d).select("entity", text.norm_name(F.regexp_replace("alias", "[0-9]+$", "")).alias("norm"))
    asked = spark.createDataFrame([("The PERSON", "person"), ("machinery", "person"), ("Customer#", "machinery"), ("nobody", "person")], "name string, kind string").withColumn("norm", text.norm_name(F.col("name")))
    hits = asked.join(aliases, "norm").join(e.withColumnRenamed("kind", "own"), "entity").join(seen, "entity", "left")
    best = F.max_by("entity", F.struct((F.col("own") == F.col("kind")).cast("int"), F.coalesce("seen", F.lit(0)), -F.col("entity")))
    return hits.groupBy("name").agg(best.alias("entity"))


def t19_relevant_talks(spark, d):
    """The eight turns of other talks that share most of a question's words, newest first among equals."""
    words = text.search_words(F.lit("Where is the letter that the onwhed ingthe wrote, and the thering of it?"), ["where", "the", "that", "and"])
    talk = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.round(text.match_score(words, text.norm_name(F.col("text"))), 6).alias("score"))
    return talk.filter("score > 0").orderBy(F.desc("score"), F.desc("conv_id"), F.desc("turn")).limit(8)


def m13_theories(spark, d):
    """Theories made by the line; a verdict past it is hidden, and so is that there is one."""
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), memory._ch().alias("made"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("verdict"), (memory._ch() + (F.col("o_orderkey") % 30).cast("int")).alias("judged"))
    told = F.col("judged") <= memory.LINE
    return t.filter(F.col("made") <= memory.LINE).select("id", "made", F.when(told, F.col("verdict")).alias("verdict"), (F.when(told, F.col("verdict")).isNull()).alias("open"))


def m9_recent_cast(spark, d):
    """Who a builder is told of: the twenty most seen of the last thirty chapters, with how they stand."""
    recent = memory._appearances(spark, d).filter((F.col("ch") > memory.LINE - 30) & (F.col("ch") <= memory.LINE)).groupBy(F.col("entity").alias("id")).agg(F.count("*").alias("n"))
    rows = ledger.described(ledger.live(memory._entities(spark, d), memory.LINE), memory._facts(spark, d), memory.LINE)
    return rows.join(recent, "id").orderBy(F.desc("n"), "id").limit(20).select("id", "name", "about", "n")


def m6_answer_pack(spark, d):
    """What a question is answered from: five places in the text, and three each of the newest events and facts of whom it names; each with its source."""
    found = search.find_where(table(spark, d, "conversations").select(F.col("conv_id").alias("ch"), "turn", "text"), "text", "anth", ["ch", "turn"], "ch", most=5)
    places = found.select(F.lit("text").alias("source"), F.col("ch").cast("long").alias("at"), "snippet")
    mine = memory._events(spark, d).join(memory._roles(spark, d).filter("entity IN (4, 7)").select(F.col("event").alias("id")), "id").filter(F.col("ch") <= memory.LINE)
    events = mine.orderBy(F.desc("ch"), "id").limit(3).select(F.lit("events"), F.col("id").cast("long"), F.concat(text.chapter_label(F.col("ch")), F.lit(": "), "what"))
    facts = memory._facts(spark, d).filter((F.col("entity") == 7) & (F.col("from_ch") <= memory.LINE) & (F.col("attr") == "status")).orderBy(F.desc("from_ch"), "value").limit(3)
    return places.union(events).union(facts.select(F.lit("facts"), F.col("from_ch").cast("long"), F.concat("attr", F.lit(": "), "value")))


def t23_moved_files(spark, d):
    """Chapters of an old list in a new one: by address, else by name where one has it, else not."""
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("old"), F.concat(F.lit("/c/"), F.col("o_orderkey").cast("string")).alias("path"), F.concat(F.lit("N"), (F.col("o_orderkey") % 701).cast("string")).alias("name"))
    new = old.select((F.col("old") + 1_000_000).alias("new"), F.when(F.col("old") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("/x"), "path")).alias("path"), "name")
    by_path = old.join(new.select("new", "path"), "path").select("old", "new", F.lit("path").alias("by"))
    rest, free = old.join(by_path, "old", "left_anti"), new.join(by_path, "new", "left_anti")
    once = lambda t, k: t.groupBy("name").agg(F.min(k).alias(k), F.count("*").alias("n")).filter("n = 1").drop("n")
    return by_path.union(once(rest, "old").join(once(free, "new"), "name").select("old", "new", F.lit("name")))


def p3_reading_sections(spark, d):
    """Sections that one reads: those near a book's edges that are contents, short front matter or of no text are left out; all stay where none would."""
    t = table(spark, d, "conversations").filter("text IS NOT NULL")
    title = F.when(F.col("turn") == 0, "Contents").when(F.col("turn") == 1, "Copyright").otherwise(F.concat(F.lit("Chapter "), F.col("turn").cast("string")))
    s = t.select("conv_id", "turn", title.alias("title"), F.length("text").alias("size"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    edge = (F.col("turn") < F.greatest(F.lit(6), F.ceil(F.col("n") / 10))) | (F.col("turn") >= F.col("n") - F.greatest(F.lit(4), F.ceil(F.col("n") / 20)))
    chapter = F.lower("title").rlike(r"^chapter\s+\d")
    front = edge & (F.lower("title").isin("contents", "table of contents") | F.lower("title").isin("copyright", "dedication", "cover", "title page") & (F.col("size") < 1500))
    kept = chapter | ~front & (F.col("size") >= 80)
    x = s.withColumn("kept", kept).withColumn("some", F.max("kept").over(Window.partitionBy("conv_id")))
    return x.filter("kept OR NOT some").select("conv_id", "turn")


def k2_replaced_chapters(spark, d):
    """An index kept by book and chapter: what comes again replaces its chapters alone, all else stays."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    t = table(spark, d, "conversations").select(F.col("role").alias("book"), (F.col("conv_id") % 5).alias("ch"), "conv_id", "turn", F.md5("text").alias("print"))
    t.write.partitionBy("book", "ch").parquet(path)
    again = t.filter("ch = 2 AND turn % 2 = 0").withColumn("print", F.lit("new"))
    again.write.partitionBy("book", "ch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return spark.read.schema(t.schema).parquet(path).select("book", F.col("ch").cast("long").alias("ch"), "conv_id", "turn", "print")


def k4_hand_off(spark, d):
    """A memory in Markdown: a heading a kind, a line an entity, the most seen first."""
    rows = ledger.ledger(memory._entities(spark, d), memory._appearances(spark, d), memory._facts(spark, d), memory.LINE, most=200)
    line = F.concat(F.lit("- **"), "name", F.lit("** (in "), F.col("seen").cast("string"), F.lit(" chapters): "), "about")
    lines = F.array_sort(F.collect_list(F.struct((-F.col("seen")).alias("s"), "id", line.alias("line"))))  # of at most 200
    return rows.groupBy("kind").agg(F.concat(F.lit("## "), F.first("kind"), F.lit("\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("markdown"))


def r3_late_chapters(spark, d):
    """Facts in valid time from a stream of statements in any order: a log by batch, intervals derived from all of it."""
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "orders").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(d).select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    days.to_table(stream, f"{out}/log", f"{out}/checkpoint")
    log = spark.read.schema(stream.schema).parquet(f"{out}/log").dropDuplicates(["o_orderkey"])
    return temporal.fact_intervals(log, ["o_custkey"], "o_orderstatus", "o_orderdate", "o_orderkey")


def r7_resumed_build(spark, d):
    """Chapters noted in runs: a run takes up what the log lacks, so one that is run again adds nothing."""
    out = f"{shared_dir(spark)}/notes-{uuid.uuid4().hex}"
    t = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    t.filter("conv_id % 3 = 0").withColumn("run", F.lit(1)).write.parquet(out)
    for run in (2, 3):
        done = spark.read.parquet(out).select("conv_id", "turn")
        t.join(done, ["conv_id", "turn"], "left_anti").withColumn("run", F.lit(run)).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def s21_feeds(spark, d):
    entry = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), F.col("p_name"), F.lit("</title><author><name>"), F.col("p_brand"), F.lit('</name></author><link rel="alternate" href="/a"/><link rel="http://opds-spec.org/acquisition" href="/b/'), F.col("p_partkey").cast("string"), F.lit('" type="application/epub+zip"/></entry></feed>'))
    opds = F.concat(F.lit('{"publications":[{"metadata":{"title":"'), F.col("p_name"), F.lit('","author":"'), F.col("p_brand"), F.lit('"},"links":[{"href":"/b/'), F.col("p_partkey").cast("string"), F.lit('","type":"application/epub+zip"}]}]}'))
    return books.feed_rows(table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, entry).otherwise(opds).alias("feed")), "p_partkey", "feed")


def s18_clips(spark, d):
    n = F.col("p_partkey").cast("string")
    smil = F.concat(F.lit('<smil xmlns="http://www.w3.org/ns/SMIL"><body><par><text src="c.xhtml#s'), n, F.lit('"/><audio src="a.mp3" clipBegin="0:00:'), F.lpad((F.col("p_size") % 60).cast("string"), 2, "0"), F.lit('" clipEnd="1:00.5"/></par></body></smil>'))
    rows = books.clip_rows(table(spark, d, "part").select("p_partkey", smil.alias("smil")), "p_partkey", "smil")
    return rows.select("p_partkey", "place", text.clock_seconds(F.col("begin")).alias("begin"), text.clock_seconds(F.col("end")).alias("end"))


def z13_narration(spark, d):
    """Sentences and the clips that say them: pieces of both that overlap."""
    l = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).cast("int").alias("a"), (F.col("l_linenumber") * 10 + 8).cast("int").alias("b"))  # noqa: E741
    clips = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(F.lit(5), F.lit(33))).alias("from")).withColumn("to", F.col("from") + 20)
    both = l.join(clips, "l_orderkey").filter((F.col("a") < F.col("to")) & (F.col("from") < F.col("b")))
    return both.select("l_orderkey", F.greatest("a", "from").alias("start"), F.least("b", "to").alias("end"))


def f26_joined_lines(spark, d):
    """Lines of a hard-wrapped paragraph as one: a word that a hyphen parts at a line's end is whole again."""
    wrapped = F.concat(F.lit("The gar-\nden of "), F.col("p_name"), F.lit("\nand the well-\nKnown one"))
    joined = F.regexp_replace(F.regexp_replace(wrapped, r"(?<=\p{L})-\n(?=\p{Ll})", ""), r"\s*\n\s*", " ")
    return table(spark, d, "part").select("p_partkey", joined.alias("text"))


QUERIES = {
    f.__name__: f
    for f in (f8_name_tests, z2_contents_parts, x2_notes, t18_resolved_names, t19_relevant_talks, m13_theories, m9_recent_cast, m6_answer_pack, t23_moved_files, p3_reading_sections, k2_replaced_chapters, k4_hand_off, r3_late_chapters, r7_resumed_build, s21_feeds, s18_clips, z13_narration, f26_joined_lines)
}

_E, _C, _LINE = memory._ENT, memory._C, memory.LINE
ORACLE_SQL = {
    "f8_name_tests": """SELECT p_partkey, k = 3 AS number, k IN (0, 4, 5, 6, 7) AS kept, k = 4 OR k < 2 AND regexp_matches(p_name, w) OR k IN (5, 7, 8) AND regexp_matches(f, w) AS described,
        k IN (0, 5, 7) AND NOT (k = 0 AND regexp_matches(p_name, w) OR k > 0 AND regexp_matches(f, w)) AS proper
        FROM (SELECT p_partkey, p_partkey % 9 AS k, p_name, split_part(p_name, ' ', 1) AS f, '(^| )(girl|boy|man|woman|kid|child|old|young|stranger|masked)( |$)' AS w FROM part)""",
    "z2_contents_parts": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Part One' WHEN 1 THEN p_brand END AS part, p_name AS name FROM part",
    "x2_notes": "SELECT c_custkey, 'Of ' || c_mktsegment AS summary, 1 AS entities, c_name AS first FROM customer WHERE c_custkey % 5 <> 0",
    "t18_resolved_names": f"""WITH s AS (SELECT e.id, kind, coalesce(seen, 0) AS seen FROM {_E} e LEFT JOIN (SELECT entity, count(*) AS seen FROM {memory._APP} GROUP BY 1) a ON a.entity = e.id WHERE merged_into IS NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seen DESC, id) AS r FROM s)
        SELECT 'The PERSON' AS name, id AS entity FROM r WHERE kind = 'person' AND r = 1 UNION ALL SELECT 'machinery', id FROM r WHERE kind = 'machinery' AND r = 1 UNION ALL SELECT 'Customer#', id FROM r WHERE kind = 'machinery' AND r = 1""",
    "t19_relevant_talks": r"""SELECT conv_id, turn, score FROM (SELECT conv_id, turn, round((CAST(contains(t, 'letter') AS INTEGER) + CAST(contains(t, 'onwhed') AS INTEGER) + CAST(contains(t, 'ingthe') AS INTEGER) + CAST(contains(t, 'wrote') AS INTEGER) + CAST(contains(t, 'thering') AS INTEGER)) / 5.0::DOUBLE, 6) AS score
        FROM (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM conversations WHERE role = 'user')) WHERE score > 0 ORDER BY score DESC, conv_id DESC, turn DESC LIMIT 8""",
    "m13_theories": f"""SELECT id, made, CASE WHEN j <= {_LINE} AND s <> 'O' THEN s END AS verdict, NOT (j <= {_LINE} AND s <> 'O') AS open FROM (SELECT o_orderkey AS id, {_C} AS made, {_C} + o_orderkey % 30 AS j, o_orderstatus AS s FROM orders) WHERE made <= {_LINE}""",
    "m9_recent_cast": f"SELECT id, name, about, n FROM {memory._LEDGER} l JOIN (SELECT entity, count(*) AS n FROM {memory._APP} WHERE ch > {_LINE} - 30 AND ch <= {_LINE} GROUP BY 1) r ON r.entity = l.id ORDER BY n DESC, id LIMIT 20",
    "m6_answer_pack": None,
    "t23_moved_files": """SELECT o_orderkey AS old, o_orderkey + 1000000 AS "new", 'path' AS "by" FROM orders WHERE o_orderkey % 2 = 0
        UNION ALL SELECT min(o_orderkey), min(o_orderkey) + 1000000, 'name' FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_orderkey % 701 HAVING count(*) = 1""",
    "p3_reading_sections": """WITH s AS (SELECT conv_id, turn, length(text) AS size, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE text IS NOT NULL), k AS (SELECT *, turn > 1 OR (turn = 1 AND size >= 1500) AS kept FROM s)
        SELECT conv_id, turn FROM (SELECT *, bool_or(kept) OVER (PARTITION BY conv_id) AS any_kept FROM k) WHERE kept OR NOT any_kept""",
    "k2_replaced_chapters": """SELECT role AS book, conv_id % 5 AS ch, conv_id, turn, CASE WHEN conv_id % 5 = 2 AND r THEN 'new' ELSE md5(text) END AS print FROM (SELECT *, bool_or(turn % 2 = 0 AND conv_id % 5 = 2) OVER (PARTITION BY role, conv_id % 5) AS r FROM conversations) WHERE NOT (r AND turn % 2 <> 0)""",
    "k4_hand_off": f"""SELECT kind, '## ' || kind || chr(10) || string_agg('- **' || name || '** (in ' || seen || ' chapters): ' || about, chr(10) ORDER BY seen DESC, id) AS markdown FROM (SELECT * FROM {memory._LEDGER} ORDER BY seen DESC, name, id LIMIT 200) GROUP BY kind""",
    "r3_late_chapters": """SELECT o_custkey, o_orderstatus, o_orderdate AS since, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS until FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NULL OR b <> o_orderstatus""",
    "r7_resumed_build": "SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS size, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 2 END AS run FROM conversations",
    "s21_feeds": "SELECT p_partkey, 0 AS n, p_name AS title, p_brand AS author, '/b/' || p_partkey AS link, 'application/epub+zip' AS type FROM part",
    "s18_clips": "SELECT p_partkey, 'c.xhtml#s' || p_partkey AS place, (p_size % 60)::DOUBLE AS begin, 60.5::DOUBLE AS \"end\" FROM part",
    "z13_narration": """SELECT l_orderkey, greatest(l_linenumber * 10, f) AS start, least(l_linenumber * 10 + 8, f + 20) AS "end" FROM lineitem, (VALUES (5), (33)) v(f) WHERE l_linenumber * 10 < f + 20 AND f < l_linenumber * 10 + 8""",
    "f26_joined_lines": "SELECT p_partkey, 'The garden of ' || p_name || ' and the well- Known one' AS text FROM part",
}
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if v}
