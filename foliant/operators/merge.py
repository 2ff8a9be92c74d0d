"""Replicas made one: newest wins, removals stay, larger figures stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: list[str], changed: str, side: str) -> DataFrame:
    """A row a key: the one changed last, of equal ones the first side's."""
    order = Window.partitionBy(*keys).orderBy(F.desc(changed), F.col(side))
    return rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def merge_marks(a: DataFrame, b: DataFrame, removed: DataFrame, key: str, changed: str, at: str) -> DataFrame:
    """Marks of both sides by id, the newest change of each; gone if removed at that time or later."""
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    gone = removed.groupBy(key).agg(F.max(at).alias("_gone"))
    kept = newest(both, [key], changed, "_side").join(gone, key, "left")
    return kept.filter(F.col("_gone").isNull() | (F.col(changed) > F.col("_gone"))).drop("_gone", "_side")


def merge_places(a: DataFrame, b: DataFrame, book: str, at: str) -> DataFrame:
    """A place a book: the newer one, of equal times a's."""
    return newest(a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1))), [book], at, "_side").drop("_side")


def merge_removed(a: DataFrame, b: DataFrame, key: str, at: str) -> DataFrame:
    """The last time at which each was removed on either side."""
    return a.select(key, at).unionByName(b.select(key, at)).groupBy(key).agg(F.max(at).alias(at))


def merge_titles(a: DataFrame, b: DataFrame, book: str, title: str) -> DataFrame:
    """The second side's titles, where it has any that isn't empty."""
    both = a.select(book, F.col(title).alias("_a")).join(b.select(book, F.col(title).alias("_b")), book, "full_outer")
    return both.select(book, F.coalesce(F.when(F.col("_b") != "", F.col("_b")), "_a", "_b").alias(title))


def added_books(have: DataFrame, backup: DataFrame, id_col: str) -> DataFrame:
    """What a library has, and of a backup only the books that it lacks."""
    return have.unionByName(backup.join(have.select(id_col), id_col, "left_anti").select(*have.columns))


def sync_record(books: DataFrame, marks: DataFrame, removed: DataFrame, days: DataFrame, book: str) -> DataFrame:
    """book, record: a book's marks by id, removals by id and days in order, as JSON that equal things make equal.

    books(book, title), marks(book, id, changed), removed(book, id, at), days(book, day, ms). Empty parts and titles are left out.
    """
    of_marks = marks.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("id", "changed"))).alias("marks"))
    in_order = lambda rows, key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    of_removed = removed.groupBy(book).agg(in_order(removed, "id", "at").alias("removed"))
    of_days = days.groupBy(book).agg(in_order(days, "day", "ms").alias("days"))
    joined = books.join(of_marks, book, "left").join(of_removed, book, "left").join(of_days, book, "left")
    title = F.when(F.col("title") != "", F.col("title")).alias("title")
    none = F.array().cast(of_marks.schema["marks"].dataType)
    return joined.select(book, F.to_json(F.struct(title, F.coalesce("marks", none).alias("marks"), "removed", "days")).alias("record"))


def merge_days(a: DataFrame, b: DataFrame, keys: list[str], figures: list[str]) -> DataFrame:
    """Of each figure the larger; a commutative and idempotent merge."""
    return a.unionByName(b).groupBy(*keys).agg(*(F.max(f).alias(f) for f in figures))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new's rows, and those of old whose key new lacks."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def import_plan(have: DataFrame, got: DataFrame, key: str, value: str) -> DataFrame:
    """key, state: new, same or conflict for each that got has."""
    both = got.select(key, F.col(value).alias("_new")).join(have.select(key, F.col(value).alias("_old")), key, "left")
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("_new"), "same").otherwise("conflict")
    return both.select(key, state.alias("state"))


def list_verdict(old: DataFrame, new: DataFrame, book: str, address: str, complete: DataFrame | None = None) -> DataFrame:
    """book, verdict on a new chapter list: empty, incomplete, shrunk (by over 3 and over 2 %), moved (over half of the addresses gone) or fine; books without an old list are fine if their list isn't empty.

    complete(book, complete): whether a site told all of a list; where it says nothing it did.
    """
    before = old.groupBy(book).agg(F.count("*").alias("n"))
    after = new.groupBy(book).agg(F.count("*").alias("m"))
    gone = old.join(new.select(book, address).distinct(), [book, address], "left_anti").groupBy(book).agg(F.count("*").alias("gone"))
    x = before.join(after, book, "full_outer").join(gone, book, "left").fillna(0, ["n", "m", "gone"])
    x = x.join(complete.select(book, F.col("complete").alias("_complete")), book, "left") if complete is not None else x.withColumn("_complete", F.lit(True))
    verdict = (
        F.when(F.col("m") == 0, "empty")
        .when(~F.coalesce("_complete", F.lit(True)), "incomplete")
        .when(F.col("n") - F.col("m") > F.greatest(F.lit(3.0), F.col("n") * 0.02), "shrunk")
        .when(F.col("gone") * 2 > F.col("n"), "moved")
        .otherwise("fine")
    )
    return x.select(book, verdict.alias("verdict"))


def changed_chapters(have: DataFrame, got: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Rows of got whose digest have lacks: only these are indexed again."""
    return got.join(have.select(*keys, digest).distinct(), [*keys, digest], "left_anti")


def kept_last(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The newest `most` rows of each key."""
    by = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= most).drop("_r")


def joined_lists(first: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Both lists without empty keys; a key that both have, in any case and space, is the first list's."""
    folded = F.lower(F.trim(F.col(key)))
    every = first.withColumn("_side", F.lit(0)).unionByName(more.withColumn("_side", F.lit(1))).withColumn("_key", folded).filter("_key <> ''")
    return newest(every.withColumn("_same", F.lit(0)), ["_key"], "_same", "_side").drop("_side", "_key", "_same")
