"""Questions to an index that is kept. It is made by a stream, in two feeds of which the second changes texts, once for a folder of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.kept_index import KeptIndex, to_feed
from ..operators.links import shared_dir
from ..sources.tables import table
from . import text as _text
from .finding import ORACLE_SQL as _FINDING

_KEPT: dict[tuple[str, str], KeptIndex] = {}


def _index(spark, d) -> KeptIndex:
    key = (spark.sparkContext.applicationId, d)
    if key not in _KEPT:
        at = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
        index = KeptIndex(spark, f"{at}/index")
        docs = table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("ch"), F.lit(1).cast("long").alias("version"), "text")
        # a first edition, of which one in seven isn't what the table says, and one in eleven isn't there yet
        first = docs.filter("ch % 11 <> 3").withColumn("text", F.when(F.col("ch") % 7 == 0, F.reverse("text")).otherwise(F.col("text")))
        for edition in (first, docs.withColumn("version", F.lit(2).cast("long"))):
            to_feed(edition, f"{at}/feed", 5000)
            index.feed(f"{at}/feed", f"{at}/checkpoint")
        _KEPT[key] = index
    return _KEPT[key]


def t2_kept_ranked(spark, d):
    return _index(spark, d).ranked(["anth", "ingth"], 10).select(F.col("ch").alias("doc_id"), "score")


def t2_kept_any(spark, d):
    return _index(spark, d).ranked(["réeux", "keit"], 10, every=False).select(F.col("ch").alias("doc_id"), "score")


def t2_kept_phrase(spark, d):
    return _index(spark, d).hits('"of the" anth').select(F.col("ch").alias("doc_id"), F.col("h0").alias("phrases"), F.col("h1").alias("begins"))


def t3_kept_hits(spark, d):
    return _index(spark, d).hits_by_book("anth").select(F.col("book").alias("source"), F.col("chapters").alias("docs"), "hits")


def u13_kept_chapters(spark, d):
    """What the index holds of each book: chapters, words, and chapters of the second feed, whose texts were new."""
    return _index(spark, d).chapters().groupBy(F.col("book").alias("source")).agg(F.count("*").alias("docs"), F.sum("size").alias("words"), F.count_if(F.col("version") == 2).alias("renewed"))


QUERIES = {f.__name__: f for f in (t2_kept_ranked, t2_kept_any, t2_kept_phrase, t3_kept_hits, u13_kept_chapters)}

ORACLE_SQL = {
    "t2_kept_ranked": _text.ORACLE_SQL["t2_ranked"],
    "t2_kept_any": _text.ORACLE_SQL["t2_ranked_any"],
    "t2_kept_phrase": _FINDING["t2_phrase"],
    "t3_kept_hits": _text.ORACLE_SQL["t3_hits_by_source"],
    "u13_kept_chapters": r"""SELECT source, count(*) AS docs, CAST(sum(len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''))) AS BIGINT) AS words,
        count(*) FILTER (doc_id % 11 = 3 OR (doc_id % 7 = 0 AND text <> reverse(text))) AS renewed FROM documents GROUP BY 1""",
}
