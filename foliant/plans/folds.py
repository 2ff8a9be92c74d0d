"""Operators that fold over an ordered group; a talk or a nation's suppliers stand for a book. SQL can't express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import communities, dialogue, links, sequences, speakers
from ..sources.tables import table


def a15_batches(spark, d):
    talk = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("cost"))
    return sequences.batches(talk, "conv_id", "turn", "cost", 1500)


def t22_list_alignment(spark, d):
    names = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("name"))
    return sequences.list_alignment(names, names.filter("turn <> 1"), "conv_id", "turn", "name")


def f19_dialogue(spark, d):
    return dialogue.dialogue(table(spark, d, "conversations"), "conv_id", "text")


def m10_communities(spark, d):
    shared = links.co_participants(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", 1)
    nation = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    a, b = nation.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("nation")), nation.select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("nation"))
    edges = shared.join(a, "a").join(b, ["b", "nation"]).select("nation", "a", "b", F.least(F.lit(3.0), F.col("events") / 2).alias("weight"))
    return communities.communities(edges, "nation")


def t16_speakers(spark, d):
    """Talks as stories: two speakers with tags, and a third turn of theirs without one."""
    line = F.when(F.col("turn") % 3 == 0, "“Go on,” said Anna.").when(F.col("turn") % 3 == 1, "“No, and why should I?” Tom answered.").otherwise("“Well.”")
    return speakers.speakers(table(spark, d, "conversations").select("conv_id", "turn", line.alias("line")), "conv_id", "turn", "line").select("conv_id", "turn", "who")


def _brand_stories(spark, d):
    """A brand is a book, a part a paragraph that one of its words, or two, says."""
    w = F.split(F.initcap("p_name"), " ")
    name = F.when(F.col("p_partkey") % 3 == 0, w[0]).otherwise(F.concat(w[0], F.lit(" "), w[1]))
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("“Well, no,” said "), name, F.lit("."))).otherwise(F.concat(name, F.lit(" answered, “Not yet.”")))
    return table(spark, d, "part").select(F.col("p_brand").alias("book"), "p_partkey", said.alias("said"))


def t15_cast(spark, d):
    """Who speaks in each book, under how many names, and how often: a first word alone joins the one person that has it."""
    cast = speakers.book_cast(_brand_stories(spark, d), "book", "said")
    return cast.groupBy("book", "who").agg(F.max("speeches").cast("int").alias("speeches"), F.count("*").alias("names"))


def t16_speakers_of_books(spark, d):
    """How often each of a book's people speaks, by the book's own cast."""
    return speakers.speakers(_brand_stories(spark, d), "book", "p_partkey", "said").groupBy("book", "who").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


QUERIES = {f.__name__: f for f in (t15_cast, t16_speakers_of_books, t16_speakers, a15_batches, t22_list_alignment, f19_dialogue, m10_communities)}

_TELLER = """p AS (SELECT p_brand AS book, p_partkey, w[1] AS a, CASE WHEN p_partkey % 3 = 0 THEN w[1] ELSE w[1] || ' ' || w[2] END AS name FROM (SELECT *, [upper(x[1]) || lower(x[2:]) FOR x IN string_split(p_name, ' ')] AS w FROM part)),
    n AS (SELECT book, name, count(*) AS c FROM p GROUP BY 1, 2),
    o AS (SELECT s.book, s.name, any_value(f.name) AS whole, count(*) AS k FROM n s JOIN n f ON f.book = s.book AND f.name LIKE '% %' AND (f.name LIKE s.name || ' %' OR f.name LIKE '% ' || s.name) WHERE s.name NOT LIKE '% %' GROUP BY 1, 2),
    j AS (SELECT n.book, n.name, n.c, CASE WHEN k = 1 THEN whole ELSE n.name END AS who FROM n LEFT JOIN o ON o.book = n.book AND o.name = n.name)"""
ORACLE_SQL: dict[str, str] = {
    "t15_cast": f"WITH {_TELLER} SELECT book, who, CAST(sum(c) AS INTEGER) AS speeches, count(*) AS names FROM j GROUP BY 1, 2",
    "t16_speakers_of_books": f"WITH {_TELLER} SELECT p.book, who, count(*) AS n, min(p_partkey) AS first FROM p JOIN j ON j.book = p.book AND j.name = p.name GROUP BY 1, 2",
    "t16_speakers": """SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'Tom' WHEN turn % 3 = 0 OR n >= 2 THEN 'Anna' END AS who FROM (SELECT *, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS n FROM conversations)""",
}
