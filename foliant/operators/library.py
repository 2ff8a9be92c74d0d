"""Shelves: filters, orders, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_for_search, let, tag_key
from .links import written
from .order import with_places

# What follows a family name, and the small words that belong to one.
SUFFIX = r"(?i)^(?:jr|sr|ii|iii|iv|phd|md)\.?$"
PARTICLES = "de da di du del della des la le van von der den ter ten af bin ibn al el st st. dos das do".split()


def family_and_given(name: Column) -> Column:
    """struct<family, given> of a name as people write it: "Family, Given", or given names and a family name with its particles; suffixes are dropped."""

    def of(t: Column) -> Column:
        at = F.instr(t, ",")
        after = F.trim(F.substring(t, at + 1, F.length(t)))
        comma, suffixed = at > 1, after.rlike(SUFFIX)
        plain = F.when(comma & suffixed, F.trim(F.substring(t, 1, at - 1))).otherwise(t)
        written = F.struct(F.trim(F.substring(t, 1, at - 1)).alias("family"), after.alias("given"))
        return F.when(comma & ~suffixed, written).otherwise(let(F.split(plain, r"\s+"), without_suffixes))

    def without_suffixes(words: Column) -> Column:
        n = F.greatest(F.array_max(F.transform(words, lambda w, i: F.when(~w.rlike(SUFFIX), i + 1).otherwise(0))), F.lit(1))
        return let(F.slice(words, 1, n), parted)

    def parted(kept: Column) -> Column:
        # the family name begins after the last word that is no particle, or is the last word if all before it are
        last = F.transform(kept, lambda w, i: F.when((i + 1 < F.size(kept)) & ~F.lower(w).isin(PARTICLES), i + 1).otherwise(0))
        start = F.array_max(last)
        return let(F.when(start == 0, F.size(kept) - 1).otherwise(start), lambda k: F.struct(F.array_join(F.slice(kept, k + 1, F.size(kept)), " ").alias("family"), F.array_join(F.slice(kept, 1, k), " ").alias("given")))

    return let(F.trim(name), of)


def author_key(authors: Column) -> Column:
    """What authors are sorted by: the first one's family name, then given names; empty for none."""
    named = F.filter(authors, lambda a: F.trim(a) != "")
    first = let(family_and_given(F.get(named, F.lit(0))), lambda n: fold_for_search(F.concat(n["family"], F.lit("\0"), n["given"])))
    return F.coalesce(F.when(F.size(named) > 0, first), F.lit(""))


def family_names(authors: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(authors, lambda a: F.trim(a) != ""), lambda a: fold_for_search(family_and_given(a)["family"])))


def read_state(progress: Column) -> Column:
    return F.when(progress >= 0.995, "finished").when(progress > 0, "reading").otherwise("unread")


def shelf_filter(books: DataFrame, chosen: dict[str, list[str]], tags: list[str] = ()) -> DataFrame:
    """Rows that match one of the chosen values in every column; a column with none chosen narrows nothing. Tags match by key, any of them."""
    out = books
    for column, values in chosen.items():
        if values:
            out = out.filter(F.col(column).isin(list(values)))
    if tags:
        out = out.filter(F.exists("tags", lambda t: tag_key(t).isin(list(tags))))
    return out


def values_here(books: DataFrame, column: str, chosen: DataFrame) -> DataFrame:
    """Of the chosen values those that some row carries."""
    return chosen.select(F.col(column)).intersect(books.select(column))


def shelf_orders(mode: str, added: str = "added", title: str = "title", authors: str = "authors", series: str = "series", index: str = "index", progress: str = "progress", id_: str = "id", recent: str = "ordinal") -> list[Column]:
    """The order of a shelf: recent (as the books came), added, title, author, series, progress. Ties go by series and place in it (none last), title, id."""
    key, name = F.coalesce(fold_for_search(F.col(series)), F.lit("")), fold_for_search(F.col(title))
    then = [key, F.col(index).asc_nulls_last(), name, F.col(id_)]
    writer = author_key(F.col(authors)) if mode == "author" else None
    return {
        "recent": lambda: [F.col(recent), F.col(id_)],
        "added": lambda: [F.desc(added), *then],
        "title": lambda: [name, *then],
        "author": lambda: [F.when(writer != "", writer).asc_nulls_last(), *then],
        "series": lambda: [F.col(series).isNull(), *then],
        "progress": lambda: [F.desc(progress), *then],
    }[mode]()


def ranked_shelf(books: DataFrame, order: list[Column]) -> DataFrame:
    """books with place, by an order of shelf_orders or any other with a unique end."""
    return with_places(books, order)


def shelf_in_order(books: DataFrame, mode: str, title: str = "title", authors: str = "authors", series: str = "series", index: str = "index", **columns: str) -> DataFrame:
    """books with place in the order of a mode; the keys that it goes by are made once for each book and written, as the
    ranges, the shuffle and the sort would each make them again."""
    plain = {"_name": fold_for_search(F.col(title)), "_series": F.coalesce(fold_for_search(F.col(series)), F.lit(""))}
    if mode == "author":
        plain["_writer"] = author_key(F.col(authors))
    keyed = written(books.withColumns(plain))
    then = [F.col("_series"), F.col(index).asc_nulls_last(), F.col("_name"), F.col(columns.get("id_", "id"))]
    own = {"title": [F.col("_name"), *then], "author": [F.when(F.col("_writer") != "", F.col("_writer")).asc_nulls_last(), *then] if mode == "author" else []}
    order = own.get(mode) or [*shelf_orders(mode, title=title, authors=authors, series=series, index=index, **columns)[:1], *(then if mode != "recent" else then[-1:])]
    return with_places(keyed, order).drop(*plain)


def tag_facet(tags: DataFrame, tag: str = "tag") -> DataFrame:
    """key, name, count: tags that differ only in case, accents and space are one; named as most spell it, ties in order."""
    spelled = tags.groupBy(tag_key(F.col(tag)).alias("key"), F.col(tag).alias("name")).agg(F.count("*").alias("n"))
    total = spelled.groupBy("key").agg(F.sum("n").alias("count"), F.min(F.struct(-F.col("n"), F.col("name"))).alias("best"))
    return total.select("key", F.col("best.name").alias("name"), "count")


def series_facet(books: DataFrame, series: str, ordinal: str) -> DataFrame:
    """key, name, count: named by the first spelling."""
    named = books.filter(F.col(series).isNotNull() & (F.col(series) != ""))
    return named.groupBy(fold_for_search(F.col(series)).alias("key")).agg(F.min_by(series, ordinal).alias("name"), F.count("*").alias("count"))


def distinct_tags(tags: DataFrame, owner: str, tag: str, ordinal: str) -> DataFrame:
    """owner, tag: each tag of an owner once, its first spelling kept."""
    first = Window.partitionBy(owner, tag_key(F.col(tag))).orderBy(ordinal)
    return tags.withColumn("r", F.row_number().over(first)).filter(F.col("r") == 1).select(owner, F.trim(F.col(tag)).alias("tag"))
