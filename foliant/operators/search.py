"""Search: substrings, ranked words, vectors."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_for_search, let, plain_words
from ..functions.vectors import cosine
from .links import written

K1, B = 1.2, 0.75


def hit_counts(docs: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """id, hits: how often the folded text holds the folded query, without overlap."""
    text, q = fold_for_search(F.col(text_col)), fold_for_search(F.lit(query))
    hits = (F.length(text) - F.length(F.replace(text, q, F.lit("")))) / F.length(q)
    return docs.select(id_col, hits.cast("int").alias("hits")).filter("hits > 0")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """token, id, tf, size: the index; tokens are folded runs of letters and digits."""
    words = docs.select(id_col, plain_words(fold_for_search(F.coalesce(F.col(text_col), F.lit("")))).alias("w"))
    return words.select(id_col, F.size("w").alias("size"), F.explode("w").alias("token")).groupBy("token", id_col, "size").agg(F.count("*").alias("tf"))


def _begins(prefix: str):
    return lambda w: w.startswith(prefix)


def ranked(docs: DataFrame, id_col: str, text_col: str, prefixes: list[str], k: int, every: bool = True, up_to: Column | None = None) -> DataFrame:
    """id, score: BM25 of the k best documents that hold a word with each prefix (or any, unless every).

    Without an index (for one, see kept_index) a question is a scan, which folds and splits each text once: what is
    left of a text, its size and the number of its words with each prefix, is written, and all sums are of these. up_to is a guard on
    rows. Ties go to the smaller id.
    """
    rows = docs.filter(up_to) if up_to is not None else docs
    n = range(len(prefixes))
    words = rows.select(id_col, indexed_words(F.col(text_col)).alias("w"))
    tf = written(words.select(id_col, F.size("w").alias("size"), *(F.size(F.filter("w", _begins(p))).alias(f"n{i}") for i, p in enumerate(prefixes))))
    total = tf.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"), *(F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}") for i in n))
    x = tf.crossJoin(F.broadcast(total))  # one row
    score = F.lit(0.0)
    for i in range(len(prefixes)):
        n, d = F.col(f"n{i}"), F.col(f"d{i}")
        idf = F.log(F.lit(1.0) + (F.col("docs") - d + 0.5) / (d + 0.5))
        score = score + idf * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    hit = [F.col(f"n{i}") > 0 for i in range(len(prefixes))]
    test = hit[0]
    for h in hit[1:]:
        test = test & h if every else test | h
    return x.filter(test).select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def nearest_to(vectors: DataFrame, id_col: str, vector_col: str, query: DataFrame, k: int) -> DataFrame:
    """id, score: the k rows nearest to the one vector of query, by cosine; ties to the smaller id."""
    q = query.select(F.col(vector_col).alias("_q")).limit(1)
    scored = vectors.crossJoin(F.broadcast(q)).select(id_col, F.round(cosine(F.col(vector_col), F.col("_q")), 6).alias("score"))
    return scored.filter("score IS NOT NULL").orderBy(F.desc("score"), id_col).limit(k)


#: First words of names that are sent to every task.
MOST_FIRST_WORDS = 100_000


def named_in(docs: DataFrame, id_col: str, text_col: str, names: DataFrame, name: str, entity: str, longest: int = 4) -> DataFrame:
    """id, entity: names found in a text as runs of one to `longest` words, nested ones too. names.name is folded.

    Only runs whose first word begins some name are made; where names are few, their first words go to every task
    (a bloom filter of Spark's own does it for more), and runs meet names by a join.
    """
    wanted = names.select(F.col(name).alias("run"), entity).distinct()
    words = docs.select(id_col, plain_words(fold_for_search(F.coalesce(F.col(text_col), F.lit("")))).alias("w"))
    firsts = wanted.select(F.split("run", " ")[0].alias("first")).distinct()
    # from each word on, the few that a name may have
    placed = words.select(id_col, F.explode(let(F.col("w"), lambda ws: F.transform(ws, lambda x, i: F.struct(x.alias("first"), F.slice(ws, i + 1, longest).alias("few"))))).alias("x")).select(id_col, "x.first", "x.few")
    near = F.broadcast(firsts) if firsts.limit(MOST_FIRST_WORDS + 1).count() <= MOST_FIRST_WORDS else firsts
    begun = placed.join(near, "first", "left_semi")
    runs = F.transform(F.sequence(F.lit(1), F.size("few")), lambda n: F.array_join(F.slice("few", F.lit(1), n), " "))
    found = begun.select(id_col, F.explode(runs).alias("run"))
    return found.join(wanted, "run").select(id_col, entity).distinct()


def name_cards(mentions: DataFrame, word: str, names: DataFrame, name: str, entity: str) -> DataFrame:
    """word, entity: of the names that hold a word (a whole one), the longest's entity; ties to the name first in order, then to the smaller entity."""
    parts = names.select(F.col(name).alias("_name"), F.col(entity).alias("_entity"), F.explode(F.array_distinct(F.split(name, " "))).alias(word))
    hits = mentions.select(word).distinct().join(parts, word)
    return hits.groupBy(word).agg(F.min_by("_entity", F.struct((-F.length("_name")).alias("n"), F.col("_name"), F.col("_entity"))).alias(entity))


def latest_by_score(rows: DataFrame, keys: list[str], score: str, id_col: str, k: int) -> DataFrame:
    """The k best rows of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), id_col)
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


# ---- questions as people type them


def parsed(question: str) -> list[list[str]]:
    """Parts of a question: quoted words are one phrase, all others are the begins of words, each alone. Only letters, digits and apostrophes count."""

    def words(s: str) -> list[str]:
        found = re.split(r"[^\w']|_", s.lower())
        return [w for w in found if w.strip("'")]

    phrases = [["=", *ws] for q in re.findall(r'"([^"]+)"', question) if (ws := words(q))]
    return phrases + [["^", w] for w in words(re.sub(r'"[^"]+"', " ", question))]


def indexed_words(c: Column) -> Column:
    """Folded runs of letters and digits, as the index has them."""
    return plain_words(fold_for_search(F.coalesce(c, F.lit(""))))


def _folded(word: str) -> Column:
    return F.array_join(plain_words(fold_for_search(F.lit(word))), " ")


def _hit_places(words: Column, part: list[str]) -> Column:
    """array<int>: places from 1 at which a text's words have the part: a phrase word for word, or a word that begins so. words is a lambda's variable, so it is not computed again for each word."""
    if part[0] == "^":
        begin = _folded(part[1])
        return F.filter(F.transform(words, lambda w, i: F.when(w.startswith(begin), i + 1)), lambda x: x.isNotNull())
    n = len([x for w in part[1:] for x in w.split("'") if x])
    whole = plain_words(fold_for_search(F.lit(" ".join(part[1:]))))
    return let(whole, lambda p: F.filter(F.transform(words, lambda w, i: F.when((w == p[0]) & (F.slice(words, i + 1, n) == p), i + 1)), lambda x: x.isNotNull()))


def part_hits(words: Column, part: list[str]) -> Column:
    """How often a text's words have the part."""
    return let(words, lambda ws: F.size(_hit_places(ws, part)))


def first_hit(words: Column, part: list[str]) -> Column:
    """Place from 1 of the first word of the first hit; null for none."""
    return F.array_min(_hit_places(words, part))


def matching(chunks: DataFrame, text_col: str, question: str, every: bool = True, guard: Column | None = None) -> DataFrame:
    """chunks with h0, h1 ... (hits of each part) and w (their words), those that have all parts, or any. A question without words finds nothing."""
    parts = parsed(question)
    rows = chunks.filter(guard) if guard is not None else chunks
    if not parts:
        return rows.limit(0).withColumn("w", F.lit(None).cast("array<string>"))
    # a text that lacks a part's letters lacks the part: that is seen before any text is split into words
    folded = fold_for_search(F.coalesce(F.col(text_col), F.lit("")))
    there = [functools.reduce(lambda a, b: a & b, (F.contains(F.lower(folded), _folded(w)) for w in p[1:] if w.isalnum()), F.lit(True)) for p in parts]
    rows = rows.filter(functools.reduce(lambda a, b: a & b if every else a | b, there)).withColumn("w", indexed_words(F.col(text_col)))
    rows = rows.withColumns({f"h{i}": part_hits(F.col("w"), p) for i, p in enumerate(parts)})
    test = [F.col(f"h{i}") > 0 for i in range(len(parts))]
    return rows.filter(functools.reduce(lambda a, b: a & b if every else a | b, test))


def snippet(words: Column, parts: list[list[str]], size: int = 14) -> Column:
    """`size` words from a little before the first hit, with dots where the text goes on."""

    def of(ws: Column) -> Column:
        first = F.least(*(first_hit(ws, p) for p in parts)) if len(parts) > 1 else first_hit(ws, parts[0])
        return let(F.greatest(F.lit(1), F.least(first - size // 3, F.size(ws) - size + 1)), lambda start: F.concat(F.when(start > 1, "…").otherwise(""), F.array_join(F.slice(ws, start, size), " "), F.when(start + size - 1 < F.size(ws), "…").otherwise("")))

    return let(words, of)


def find_where(chunks: DataFrame, text_col: str, question: str, order: list[str], chapter: str, most: int = 300, guard: Column | None = None, every: bool = True) -> DataFrame:
    """order columns, snippet of the first `most` places in the book's order, and chapters: how many chapters these are in."""
    parts = parsed(question)
    found = matching(chunks, text_col, question, every, guard)
    if not parts:
        return found.select(*order, F.lit("").alias("snippet"), F.lit(0).cast("long").alias("chapters"))
    hits = found.select(*order, snippet(F.col("w"), parts).alias("snippet")).orderBy(*order).limit(most)
    n = hits.agg(F.countDistinct(chapter).alias("chapters"))  # of at most `most` rows
    return hits.crossJoin(F.broadcast(n))


def hits_by_chapter(chunks: DataFrame, text_col: str, question: str, chapter: str, guard: Column | None = None) -> DataFrame:
    """chapter, n: chunks that have all parts of the question; words are tested before anything is counted."""
    return matching(chunks, text_col, question, True, guard).groupBy(chapter).agg(F.count("*").alias("n"))


def hit_spans(docs: DataFrame, id_col: str, text_col: str, query: str, whole_words: bool = False, most: int = 2000) -> DataFrame:
    """id, start, end (code points from 0) of the folded query in the folded text, without overlap; the first `most` by id and start."""
    text, q = fold_for_search(F.col(text_col)), fold_for_search(F.trim(F.lit(query)))
    parts = F.split(text, F.concat(F.lit("\\Q"), q, F.lit("\\E")), -1)
    sizes = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p))
    begun = F.aggregate(sizes, F.array().cast("array<int>"), lambda s, n: F.concat(s, F.array((F.when(F.size(s) > 0, F.element_at(s, -1) + F.length(q)).otherwise(F.lit(0)) + n).cast("int"))))
    found = docs.filter(F.contains(text, q) & (F.length(q) > 0)).select(id_col, text.alias("_t"), F.explode(begun).alias("start"), F.length(q).alias("_n"))
    if whole_words:
        letter = r"[\p{L}\p{N}]"
        found = found.filter(~F.substring("_t", F.col("start"), F.lit(1)).rlike(letter) | (F.col("start") == 0)).filter(~F.substring("_t", F.col("start") + F.col("_n") + 1, F.lit(1)).rlike(letter))
    return found.select(id_col, "start", (F.col("start") + F.col("_n")).alias("end")).orderBy(id_col, "start").limit(most)
