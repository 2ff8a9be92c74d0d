"""Who's who of a book as of a chapter: entities, their appearances, facts, events and threads.

Tables, all of one book or with its id among the keys: entities(id, kind, name, about, first_ch, merged_into),
aliases(entity, alias, ch), appearances(entity, ch), facts(entity, attr, value, from_ch, until_ch),
relations(a, rel, b, from_ch, until_ch), events(id, ch, what, importance), roles(event, entity).
Nothing past the line is told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chapter_label, norm_name

#: Rows of a list that people read.
MOST_LISTED, CARD_RELATIONS, CARD_EVENTS, CARD_NAMES = 2000, 12, 10, 8


def live(entities: DataFrame, line: int) -> DataFrame:
    """Entities that stand for themselves and are met by the line; without a first chapter they are known from the start."""
    return entities.filter(F.col("merged_into").isNull() & (F.coalesce("first_ch", F.lit(0)) <= line))


def described(entities: DataFrame, facts: DataFrame, line: int) -> DataFrame:
    """entities with `about` as of the line: the last description that began by then, else their first words."""
    told = facts.filter((F.col("attr") == "description") & (F.col("from_ch") <= line)).groupBy(F.col("entity").alias("id")).agg(F.max_by("value", F.struct("from_ch", "value")).alias("_told"))
    return entities.join(told, "id", "left").withColumn("about", F.coalesce("_told", "about")).drop("_told")


def seen(appearances: DataFrame, line: int) -> DataFrame:
    """id, seen, last_seen: chapters that an entity is in up to the line."""
    return appearances.filter(F.col("ch") <= line).groupBy(F.col("entity").alias("id")).agg(F.count("*").alias("seen"), F.max("ch").alias("last_seen"))


def named_like(entities: DataFrame, aliases: DataFrame, query: str) -> DataFrame:
    """Entities of which some name, folded, holds the folded query; % and _ in it are wild, as they are not escaped. An empty query narrows nothing."""
    hits = aliases.filter(F.like(norm_name(F.col("alias")), F.concat(F.lit("%"), norm_name(F.lit(query)), F.lit("%")))).select(F.col("entity").alias("id"))
    return entities.join(hits, "id", "left_semi") if query.strip() else entities


def ledger_orders(mode: str) -> list[Column]:
    """Orders of the list: importance, recent, first_met, name."""
    name = [F.col("name"), F.col("id")]
    return {
        "importance": [F.desc("seen"), *name],
        "recent": [F.desc_nulls_last("last_seen"), F.desc("seen"), *name],
        "first_met": [F.asc_nulls_first("first_ch"), *name],
        "name": [F.lower("name"), F.col("id")],
    }[mode]


def ledger(entities: DataFrame, appearances: DataFrame, facts: DataFrame, line: int, kind: str | None = None, mode: str = "importance", most: int = MOST_LISTED) -> DataFrame:
    """id, kind, name, about, first_ch, seen, last_seen of the entities as of the line, the first `most` by the order."""
    rows = described(live(entities, line), facts, line)
    rows = rows.filter(F.col("kind") == kind) if kind else rows
    rows = rows.join(seen(appearances, line), "id", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    return rows.select("id", "kind", "name", "about", "first_ch", "seen", "last_seen").orderBy(*ledger_orders(mode)).limit(most)


def kinds(entities: DataFrame, known: DataFrame, line: int) -> DataFrame:
    """kind, n, core, place: how many entities there are of each kind; core ones first, then by number. known(name, core)."""
    n = live(entities, line).groupBy("kind").agg(F.count("*").alias("n")).join(known.select(F.col("name").alias("kind"), "core"), "kind", "left")
    n = n.select("kind", "n", F.coalesce("core", F.lit(0)).alias("core"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("core"), F.desc("n"), "kind")))  # a row a kind


def main_entity(entities: DataFrame, appearances: DataFrame, line: int) -> DataFrame:
    """id of the most seen person, or of anything if there is none; ties to the smaller id."""
    rows = live(entities, line).join(seen(appearances, line), "id", "left")
    return rows.orderBy(F.desc(F.col("kind") == "person"), F.desc(F.coalesce("seen", F.lit(0))), "id").limit(1).select("id")


def graph_nodes(entities: DataFrame, appearances: DataFrame, line: int, now: int, most: int = 120, window: int = 50, forgotten_share: float = 0.25) -> DataFrame:
    """id, weight, recent, last_seen, forgotten: the entities to show as of `now`.

    A share of the places is for those that were in three chapters or more but in none of the last `window`, the
    most missed first; the others go to those that matter now. All are shown if there are no more than `most`.
    """
    upto = appearances.filter(F.col("ch") <= line)
    weight = upto.groupBy(F.col("entity").alias("id")).agg(
        F.count("*").alias("weight"), F.count_if((F.col("ch") > now - window) & (F.col("ch") <= now)).alias("recent"), F.max(F.when(F.col("ch") <= now, F.col("ch"))).alias("last_seen")
    )
    rows = live(entities, line).select("id").join(weight, "id")
    matters = F.col("recent") * 4 + F.sqrt("weight") * 3
    gone = (F.col("weight") >= 3) & (F.lit(now) - F.col("last_seen") > window)
    missed = F.sqrt("weight") * F.log(1 + F.lit(now) - F.col("last_seen"))
    rows = rows.withColumns({"gone": F.coalesce(gone, F.lit(False)), "matters": matters, "missed": missed})
    n = rows.count()
    slots = round(most * forgotten_share) if n > most else 0
    back = rows.filter("gone").orderBy(F.desc("missed"), "id").limit(slots).withColumn("forgotten", F.lit(True))
    rest = rows.join(back.select("id"), "id", "left_anti").orderBy(F.desc("matters"), "id").limit(most - back.count()).withColumn("forgotten", F.lit(False))
    return back.unionByName(rest).select("id", "weight", "recent", "last_seen", "forgotten")


def latest_top(events: DataFrame, order: list[Column], k: int, then: list[Column]) -> DataFrame:
    """The k first rows by one order, told in another."""
    return events.orderBy(*order).limit(k).orderBy(*then)


def card(id_: int, line: int, entities: DataFrame, aliases: DataFrame, appearances: DataFrame, facts: DataFrame, relations: DataFrame, events: DataFrame, roles: DataFrame) -> DataFrame:
    """section, place, text: an entity's card as of the line: who it is, how it stands, its relations, its key events in their order. No rows if it isn't met yet."""
    met = described(entities.filter(F.col("id") == id_), facts, line).filter(F.coalesce("first_ch", F.lit(0)) <= line)
    # a card's own names, facts, relations and events: a few rows, but for the events, of which ten are kept
    names = aliases.filter((F.col("entity") == id_) & (F.col("ch").isNull() | (F.col("ch") <= line))).agg(F.slice(F.array_sort(F.collect_set("alias")), 1, CARD_NAMES + 1).alias("names"))
    others = F.slice(F.array_remove("names", F.col("name")), 1, CARD_NAMES)
    called = F.when(F.size(others) > 0, F.concat(F.lit(", also called "), F.array_join(others, ", "))).otherwise("")
    about = F.when(F.coalesce("about", F.lit("")) == "", "").otherwise(F.concat("about", F.lit(". ")))
    head = met.crossJoin(F.broadcast(names)).select(F.lit(0).alias("section"), F.lit(0).alias("place"), F.concat("name", F.lit(" ("), "kind", F.lit(")"), called, F.lit(". "), about, F.lit("First met in "), chapter_label(F.coalesce("first_ch", F.lit(0))), F.lit(".")).alias("text"))

    def section(n: int, rows: DataFrame, order: list[Column], text: Column) -> DataFrame:
        numbered = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))
        return numbered.select(F.lit(n).alias("section"), "place", text.alias("text"))

    holds = (F.col("from_ch") <= line) & (F.col("until_ch").isNull() | (F.col("until_ch") > line))
    stands = facts.filter((F.col("entity") == id_) & holds & (F.col("attr") != "description"))
    who = entities.select(F.col("id").alias("n"), F.col("name").alias("name"))
    ties = relations.filter(((F.col("a") == id_) | (F.col("b") == id_)) & holds).orderBy("from_ch", "a", "b", "rel").limit(CARD_RELATIONS)
    ties = ties.join(who.select(F.col("n").alias("a"), F.col("name").alias("an")), "a").join(who.select(F.col("n").alias("b"), F.col("name").alias("bn")), "b")
    took_part = events.filter(F.col("ch") <= line).join(roles.filter(F.col("entity") == id_).select(F.col("event").alias("id")).distinct(), "id", "left_semi")
    key = latest_top(took_part, [F.desc("importance"), F.desc("ch"), F.col("id")], CARD_EVENTS, [F.col("ch")])
    parts = [
        section(1, stands, [F.col("from_ch"), F.col("attr"), F.col("value")], F.concat("attr", F.lit(": "), "value", F.lit(" (from "), chapter_label(F.col("from_ch")), F.lit(")"))),
        section(2, ties, [F.col("from_ch"), F.col("a"), F.col("b"), F.col("rel")], F.concat("an", F.lit(" "), "rel", F.lit(" "), "bn")),
        section(3, key, [F.col("ch"), F.col("id")], F.concat(chapter_label(F.col("ch")), F.lit(": "), "what")),
    ]
    out = head
    for p in parts:
        out = out.unionByName(p.join(F.broadcast(met.select("id")), F.lit(True), "left_semi"))
    return out


def threads_at(threads: DataFrame, steps: DataFrame, line: int) -> DataFrame:
    """id, title, raised, resolved, steps, moved: threads raised by the line (not before the book); ends and steps past it aren't told. threads(id, title, raised_ch, resolved_ch), steps(thread, ch)."""
    told = steps.filter(F.col("ch") <= line).groupBy(F.col("thread").alias("id")).agg(F.count("*").alias("steps"), F.max("ch").alias("last"))
    rows = threads.filter((F.col("raised_ch") <= line) & (F.col("raised_ch") >= 0)).join(told, "id", "left")
    resolved = F.when(F.col("resolved_ch") <= line, F.col("resolved_ch"))
    return rows.select("id", "title", F.col("raised_ch").alias("raised"), resolved.alias("resolved"), F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce("last", "raised_ch").alias("moved"))


def thread_order() -> list[Column]:
    """Open threads first, the latest moved first, then by id."""
    return [F.col("resolved").isNotNull().cast("int"), F.desc("moved"), F.col("id")]


def takeovers(appearances: DataFrame, gap: int = 50, early: int = 10, after: int = 10) -> DataFrame:
    """entity, ch: where another's story seems to begin: after the largest gap (the first of equal ones), if it is `gap` chapters or more, among the first `early` appearances, with `after` more from there on."""
    by = Window.partitionBy("entity").orderBy("ch")
    steps = appearances.select("entity", "ch").distinct().withColumns({"step": F.col("ch") - F.lag("ch").over(by), "at": F.row_number().over(by) - 1, "n": F.count("*").over(Window.partitionBy("entity"))})
    best = steps.filter("step IS NOT NULL").groupBy("entity").agg(F.max_by(F.struct("ch", "at", "step", "n"), F.struct("step", (-F.col("at")).alias("m"))).alias("b"))
    return best.filter((F.col("b.step") >= gap) & (F.col("b.at") <= early) & (F.col("b.n") - F.col("b.at") >= after)).select("entity", F.col("b.ch").alias("ch"))


def first_gap(chapters: DataFrame, book: str, ch: str) -> DataFrame:
    """book, ch: the first chapter from 0 on that a book lacks: the number of chapters if none is missing in between. One pass of partial sums would not tell; the window is over a book's chapters."""
    by = Window.partitionBy(book).orderBy(ch)
    numbered = chapters.select(book, ch).distinct().withColumn("_i", F.row_number().over(by) - 1)
    return numbered.groupBy(book).agg(F.coalesce(F.min(F.when(F.col(ch) != F.col("_i"), F.col("_i"))), F.count("*")).cast("int").alias("ch"))


def pending(rows: DataFrame, done: DataFrame, key: str, importance: str, least: int = 2, most: int = 200) -> DataFrame:
    """key: what still lacks its result, the most important first, up to `most`."""
    return rows.filter(F.col(importance) >= least).join(done.select(key), key, "left_anti").orderBy(F.desc(importance), key).limit(most).select(key)
