"""Series in titles: alone, and across a library of five thousand."""

import random
import time

import pytest

from foliant.operators import series

WORDS = "Amber Birch Cinder Dawn Ember Frost Garnet Harbor Iron Jade Kestrel Lantern Marsh North Ocean Pine Quartz Raven Stone Thorn".split()


@pytest.mark.parametrize(
    "title, want",
    [("The Long Night 3", ("The Long Night", 3.0)), ("Emberfall, Book Two", ("Emberfall", 2.0)), ("Iron Vol. 41", ("Iron", 41.0)), ("Waking (The Lantern #1.5)", ("The Lantern", 1.5)), ("Raven [Stone Cycle 2]", ("Stone Cycle", 2.0)), ("Saga Part IV", ("Saga", 4.0)), ("Saga Part IIII", None), ("Heat 451", None), ("Rocket 13", None), ("Runner Again 2049", None), ("", None), (None, None), ("7", None), ("# 3", None)],
)
def test_a_title_alone(title, want):
    assert series.alone(title) == want


def test_roman_numerals():
    assert [series.roman(x) for x in ("i", "iv", "xl", "cccxcix", "vv", "ic", "cd", "")] == [1, 4, 40, 399, None, None, None, None]


def test_runs_of_words():
    said = lambda t: {r[0]: r[1] for r in series.runs(t)}
    assert said("A Game of Stones A Song of Frost 1")["a song of frost"] == 1.0
    assert "of the king" not in said("Rise of the King 2") and "rise of the king" in said("Rise of the King 2")
    assert said("The First Thorn 1 The Blade") == {"the first thorn": 1.0, "first thorn": 1.0} or "the first thorn" in said("The First Thorn 1 The Blade")
    assert said("No number here") == {} == said("Only 3")


def test_across_five_thousand_titles(spark):
    r = random.Random(3)
    titles, want = [], {}
    for s in range(600):
        name = f"{WORDS[s % 20]} {WORDS[s // 20 % 20]} {WORDS[(s * 7) % 20]}{s}"
        for n in range(1, 6):
            want[len(titles)] = (name, float(n))
            titles.append(r.choice([f"{name} {n}", f"{name}, Book {n}", f"Tale{s}x{n} ({name} #{n})", f"{name} {n} The Tale"]))
    for i in range(2000):
        titles.append(f"{r.choice(WORDS)} and the {r.choice(WORDS)} of No {i % 7 + 100}{'' if i % 2 else 'x'}")
    rows = spark.createDataFrame(list(enumerate(titles)), "id long, title string").repartition(4)
    began = time.time()
    got = {x["id"]: (x["series"], x["place"]) for x in series.across(rows, "id", "title").collect()}
    assert time.time() - began < 60
    right = sum(got[i] == w for i, w in want.items())
    assert right >= 0.97 * len(want), (right, [(titles[i], got[i], w) for i, w in want.items() if got[i] != w][:5])


def test_known_series_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "The Copper Road 2"), (2, "Nothing"), (3, None)], "id long, title string")
    known = spark.createDataFrame([("The copper road",), ("The copper road",), ("THE COPPER ROAD",)], "name string")
    got = {x["id"]: (x["series"], x["place"]) for x in series.across(rows, "id", "title", known).collect()}
    assert got == {1: ("The copper road", 2.0), 2: (None, None), 3: (None, None)}
    assert series.across(rows.limit(0), "id", "title").count() == 0
