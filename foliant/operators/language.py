"""Language by shared stop words: rare words tell more."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_words

# Some of the commonest words of each language.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be this by from or which".split(),
    "de": "der die und das den von zu mit sich des auf ist ein eine dem nicht auch als einer im".split(),
    "fr": "le la les de des et en un une du que qui est dans pour par sur au avec pas".split(),
    "es": "el la los de que y en un una del las por con para es se como su al lo".split(),
}
LEAST_WEIGHT, LEAD = 4.0, 1.5


def lexicon(spark) -> DataFrame:
    """word, lang, weight: one divided by the number of languages that have the word."""
    of: dict[str, list[str]] = {}
    for lang, words in STOP_WORDS.items():
        for w in words:
            of.setdefault(w, []).append(lang)
    return spark.createDataFrame([(w, lang, 1.0 / len(langs)) for w, langs in sorted(of.items()) for lang in langs], "word string, lang string, weight double")


def by_stop_words(docs: DataFrame, id_col: str, text_col: str, least: float = LEAST_WEIGHT, lead: float = LEAD) -> DataFrame:
    """id, lang_found: null where no language has enough weight and lead."""
    words = docs.select(id_col, F.explode(plain_words(F.col(text_col))).alias("word"))
    weights = words.join(F.broadcast(lexicon(docs.sparkSession)), "word").groupBy(id_col, "lang").agg(F.round(F.sum("weight"), 6).alias("w"))
    ranked = weights.withColumn("r", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("w"), "lang")))
    top = ranked.groupBy(id_col).agg(F.max(F.when(F.col("r") == 1, F.col("lang"))).alias("lang"), F.max(F.when(F.col("r") == 1, F.col("w"))).alias("w1"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("w"))), F.lit(0.0)).alias("w2"))
    found = top.select(id_col, F.when((F.col("w1") >= least) & (F.col("w1") >= F.col("w2") * lead), F.col("lang")).alias("lang_found"))
    return docs.select(id_col).join(found, id_col, "left")


def marked_majority(rows: DataFrame, group: str, lang: str, size: str) -> DataFrame:
    """group, lang, size: the language with most characters; ties to the first in order."""
    sums = rows.groupBy(group, lang).agg(F.sum(size).alias("n"))
    best = sums.groupBy(group).agg(F.min(F.struct(-F.col("n"), F.col(lang))).alias("b"))
    return best.select(group, F.col(f"b.{lang}").alias(lang), (-F.col("b.col1")).alias("n"))
