"""The operators' edge cases on small tables."""

import datetime as dt
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.functions import text as fn
from foliant.functions.days import day_key
from foliant.functions.hashes import fnv1a, murmur_final, times32
from foliant.operators import library, links, merge, prints, stats, temporal, units


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, fn.collapse_space(F.lit("﻿ a \t b\n"))) == "a b"
    assert one(spark, fn.count_words(F.lit("two words 日本語 ไทยไทย"))) == 2 + (3 * 5 + 4) // 9 + (6 + 2) // 5
    assert one(spark, fn.fold_for_search(F.lit("ÉÀç Ñ"))) == "eac n"
    assert one(spark, fn.norm_name(F.lit("The Mountain-King's"))) == "mountain king s"
    assert one(spark, fn.title_key(F.lit("The River & Sea (Third Edition): A Tale"))) == "river and sea"
    assert one(spark, fn.language_key(F.lit("en-GB"))) == "en"
    assert one(spark, fn.language_key(F.lit(""))) is None
    assert one(spark, fn.chapter_number(F.lit("Chapter 1,234: end"))) == 1234
    assert one(spark, fn.link_kind(F.lit("went toward the person"))) == "conflict"
    assert one(spark, fn.word_likeness(F.array(F.lit("a")), F.array().cast("array<string>"))) is None


def test_hashes_equal_plain_arithmetic(spark):
    def fnv(word):
        h = 0x811C9DC5
        for c in word:
            h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
        return h

    def final(h):
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    for w in ("", "a", "straße", "éèê", "x" * 50):
        assert one(spark, fnv1a(F.lit(w))) == fnv(w)
        assert one(spark, murmur_final(fnv1a(F.lit(w)))) == final(fnv(w))
    assert one(spark, times32(F.lit(0xFFFFFFFF).cast("long"), 0xFFFFFFFF)) == 0xFFFFFFFF * 0xFFFFFFFF & 0xFFFFFFFF


def test_days_begin_at_four(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 59),), (dt.datetime(2024, 1, 2, 4, 0),)], "ts timestamp_ntz")
    assert [r[0] for r in rows.select(day_key(F.col("ts"))).collect()] == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]


def test_streaks(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [("a", day(n), 30.0) for n in (1, 2, 3, 8, 9)] + [("a", day(10), 5.0), ("b", day(1), 30.0), ("c", day(10), 1.0)]
    got = {r["w"]: (r["current"], r["best"]) for r in stats.streaks(spark.createDataFrame(rows, "w string, day date, total double"), "w", 20.0, "2024-01-10").collect()}
    assert got == {"a": (2, 3), "b": (0, 1)}


def test_tag_facet_ties_and_order(spark):
    tags = spark.createDataFrame([(t,) for t in ["Sci-Fi", "sci-fi", "SCI-FI", "sci-fi", " Épic", "epic"]], "tag string")
    got = {r["key"]: (r["name"], r["count"]) for r in library.tag_facet(tags).collect()}
    assert got == {"sci-fi": ("sci-fi", 4), "epic": (" Épic", 2)}


def test_facts_in_time(spark):
    rows = [("e", "red", 1, 1), ("e", "red", 3, 2), ("e", "blue", 5, 3), ("e", "red", 9, 4)]
    random.Random(3).shuffle(rows)
    facts = temporal.fact_intervals(spark.createDataFrame(rows, "k string, v string, t int, o int"), ["k"], "v", "t", "o")
    assert sorted((r["since"], r["until"], r["v"]) for r in facts.collect()) == [(1, 5, "red"), (5, 9, "blue"), (9, None, "red")]
    at = lambda t: [r["v"] for r in facts.filter(temporal.valid_at(F.lit(t))).collect()]
    assert (at(0), at(4), at(5), at(99)) == ([], ["red"], ["blue"], ["red"])


def test_merge_marks(spark):
    kind = "id string, changed int, text string"
    a = spark.createDataFrame([("x", 5, "a"), ("y", 5, "a"), ("z", 5, "a")], kind)
    b = spark.createDataFrame([("x", 5, "b"), ("y", 6, "b"), ("w", 1, "b")], kind)
    gone = spark.createDataFrame([("z", 5), ("w", 0)], "id string, at int")
    got = {(r["id"], r["text"]) for r in merge.merge_marks(a, b, gone, "id", "changed", "at").collect()}
    assert got == {("x", "a"), ("y", "b"), ("w", "b")}


def test_merge_days_is_commutative(spark):
    a = spark.createDataFrame([("d", 1, 9)], "day string, x int, y int")
    b = spark.createDataFrame([("d", 4, 2), ("e", 1, 1)], "day string, x int, y int")
    rows = lambda p, q: sorted(map(tuple, merge.merge_days(p, q, ["day"], ["x", "y"]).collect()))
    assert rows(a, b) == rows(b, a) == [("d", 4, 9), ("e", 1, 1)]


def test_components_and_live_ids(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in links.components(chain).collect()}
    assert got == dict.fromkeys(range(21), 0) | {100: 100, 101: 100}
    merges = spark.createDataFrame([(3, 2), (2, 1), (1, 0)], "id long, into long")
    assert {r["id"]: r["live"] for r in links.live_ids(merges).collect()} == {3: 0, 2: 0, 1: 0}


def test_prints_of_copies(spark):
    r = random.Random(5)
    words = [f"w{r.randrange(10_000)}" for _ in range(400)]
    rows = [(1, " ".join(words)), (2, "; ".join(words).upper()), (3, " ".join(words[:150])), (4, " ".join(f"v{i}" for i in range(300))), (5, None)]
    p = prints.text_prints(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert {x["id"] for x in p.collect()} == {1, 2, 4}
    assert [(x["id"], x["group"]) for x in prints.duplicate_groups(p, "id").orderBy("id").collect()] == [(1, 1), (2, 1)]


def test_sentences():
    text = 'Dr. Smith paid 3.50 to J. Doe. "Really?" she asked. 日本。です。 Well… maybe not… Yes!\nNext line'
    got = [text[a:b] for a, b in units.sentence_bounds(text)]
    assert got == ["Dr. Smith paid 3.50 to J. Doe.", '"Really?" she asked.', "日本。", "です。", "Well… maybe not…", "Yes!", "Next line"]
    long = "word, " * 100
    assert all(b - a <= units.LONGEST for a, b in units.sentence_bounds(long))
    assert units.sentence_bounds("") == []


def test_chunks_end_before_a_unit():
    assert units.chunk_bounds([10] * 6) == [0, 0, 0, 0, 0, 1]
    assert units.chunk_bounds([500, 10, 419, 1, 5]) == [0, 1, 1, 2, 2]


def test_units_cover_the_text(spark):
    rows = [(1, "One. Two three.\nFour!"), (2, None), (3, ""), (None, "x")]
    got = units.units(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["id"] or 0), r["blk"], r["sen"], r["text"]) for r in got) == [(0, 0, 0, "x"), (1, 0, 0, "One."), (1, 0, 1, "Two three."), (1, 1, 0, "Four!")]


def test_chunks_end_with_their_section(spark):
    assert units.chunk_bounds([5, 5, 5], sections=[0, 0, 1]) == [0, 0, 1]
    text = "Some words here. And more.\nChapter 2\nOther  words follow. The end."
    got = units.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk").collect()
    assert [(r["sec"], r["body"]) for r in got] == [(0, "Some words here. And more."), (1, "Chapter 2 Other words follow. The end.")]
    assert [text[r["start"] : r["end"]] for r in got] == ["Some words here. And more.", "Chapter 2\nOther  words follow. The end."]


@pytest.mark.parametrize(
    "name, number",
    [("Vol. 2 Chapter 4", 4.0), ("The 100 Doors", None), ("Ch. 12.5: Dusk", 12.5), ("12 - Dawn", 12.0), ("第12章", 12.0), ("Episode 3", 3.0), ("c12", 12.0), ("Prologue", None), ("Chapter 1,234: end", 1234.0), ("12th day", None)],
)
def test_chapter_numbers(spark, name, number):
    assert one(spark, fn.chapter_number(F.lit(name))) == number


def test_accents_fold(spark):
    assert one(spark, fn.fold_for_search(F.lit("Łódź “Øre”"))) == 'lodz "ore"'
    assert one(spark, fn.tidy_name(F.lit("LordOfTheDead"))) == "Lord of the Dead"
    assert one(spark, fn.tidy_name(F.lit("Mountain_King"))) == "Mountain King"
    assert one(spark, fn.tidy_name(F.lit("McDonald"))) == "McDonald" and one(spark, fn.tidy_name(F.lit("DeShawn"))) == "DeShawn"


def test_sentences_are_handed_on_in_bounded_batches(monkeypatch):
    """A worker holds the rows of some characters, not of all texts that Spark sends at once."""
    monkeypatch.setattr(units, "HANDED", 100)
    texts = ["One two. Three four. Five six. Seven eight."] * 50 + [None, ""]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(52), pa.int64()), "text": pa.array(texts)})
    for of, schema, each in ((units._unit_rows, units._UNIT, 4), (units._chunk_rows, units._CHUNK, 1)):
        got = list(units._cut([batch, batch], of, schema))
        assert max(len(b) for b in got) == 3 * each and sum(len(b) for b in got) == 100 * each
        assert all(b.schema == schema for b in got)


def test_tasks_of_pairs_grow_with_the_roles(spark, monkeypatch):
    """The number of tasks is given, so that Spark doesn't put small shuffles of many pairs together."""
    monkeypatch.setattr(links, "ROLES_A_TASK", 10)
    rows = [(e, x) for e in range(60) for x in {e % 5, (e * 7 + 1) % 5, e % 3 + 5}] * 2
    shared = links.co_participants(spark.createDataFrame(rows, "event long, who long"), "event", "who", 1)
    assert shared.rdd.getNumPartitions() >= len(rows) // 10
    want = Counter((a, b) for e in range(60) for a in {x for f, x in rows if f == e} for b in {x for f, x in rows if f == e} if a < b)
    assert {(r["a"], r["b"]): r["events"] for r in shared.collect()} == want
