"""JSON stores with fixed schemas. A broken record is set aside in `_broken`, never dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "library": "id STRING, title STRING, authors ARRAY<STRING>, source STRING, wordCount LONG, addedAt TIMESTAMP, openedAt TIMESTAMP, progress DOUBLE, language STRING, category STRING, chapterCount INT, tags ARRAY<STRING>, series STRING, seriesIndex DOUBLE, textPrint STRING",
    "days": "day DATE, listen LONG, read LONG, words LONG, chapters LONG, books MAP<STRING, LONG>",
    "marks": "id STRING, book STRING, kind STRING, text STRING, note STRING, created TIMESTAMP, edited TIMESTAMP, at STRUCT<section: INT, block: INT, sentence: INT>",
    "removed": "id STRING, at TIMESTAMP",
}


def read_store(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a store, a JSON object a line; missing keys are null, `_broken` holds a line that isn't one."""
    return spark.read.schema(SCHEMAS[kind] + ", _broken STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)


def library(spark: SparkSession, path: str) -> DataFrame:
    """Entries with what follows from them: finished, last_touched, an empty series as none."""
    rows = read_store(spark, path, "library")
    return rows.withColumns({"series": F.when(F.col("series") != "", F.col("series")), "finished": F.coalesce(F.col("progress") >= 0.995, F.lit(False)), "last_touched": F.coalesce("openedAt", "addedAt")})


def day_books(days: DataFrame) -> DataFrame:
    """day, book, ms: the time of each book on each day."""
    return days.filter("_broken IS NULL").select("day", F.explode("books").alias("book", "ms"))


def write_marks_as_markdown(marks: DataFrame, path: str) -> None:
    """A text file for each partition of books: the book's name, then its marks in the order of the book."""
    place = F.struct("at.section", "at.block", "at.sentence", "created", F.concat(F.lit("> "), F.coalesce("text", F.lit("")), F.coalesce(F.concat(F.lit("\n\n"), F.col("note")), F.lit(""))).alias("said"))
    by_book = marks.groupBy("book").agg(F.array_sort(F.collect_list(place)).alias("m"))  # a reader's marks in one book
    by_book.select(F.concat(F.lit("## "), F.col("book"), F.lit("\n\n"), F.array_join(F.transform("m", lambda x: x["said"]), "\n\n"), F.lit("\n")).alias("value")).write.text(path)
