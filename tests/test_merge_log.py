"""The log of merges against a replay of all decisions for each row and step."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators.merge_log import owned, owner_intervals, tidy_decisions

KIND = "book string, step long, op string, a long, b long, ch int"


def way(force, x, ch):
    """Where a row of x at a chapter belongs, by the decisions in force; None for a circle."""
    seen = []
    while True:
        if x in seen:
            return None
        seen.append(x)
        hands = [(c, s, b) for s, (op, a, b, c) in force.items() if op == "hand" and a == x and c <= ch]
        merges = [b for op, a, b, _ in force.values() if op == "merge" and a == x]
        if not hands and not merges:
            return x
        x = max(hands)[2] if hands else merges[0]


def replay(log, upto, ids, chapters):
    """(id, chapter) -> owner after the decisions up to a step, each tried on all rows."""
    force = {}
    for _, step, op, a, b, ch in sorted(log, key=lambda r: (r[1], r[2], r[3], r[4] or 0)):
        if step > upto:
            break
        trial = dict(force)
        if op == "undo":
            if a not in force:
                continue
            del trial[a]
        else:
            if a == b or step in force or (op == "merge" and any(o == "merge" and x == a for o, x, _, _ in force.values())):
                continue
            trial[step] = (op, a, b, -1 if ch is None else ch)
        if all(way(trial, x, c) is not None for x in ids for c in chapters):
            force = trial
    return {(x, c): way(force, x, c) for x in ids for c in chapters}


def made(seed, book, n=40):
    r = random.Random(seed)
    log = []
    for step in range(1, n + 1):
        op = r.choice(["merge", "merge", "hand", "hand", "undo"])
        log.append((book, step, op, r.randrange(1, 8) if op != "undo" else r.randrange(1, step + 1), r.randrange(1, 8) if op != "undo" else None, r.choice([None, 2, 5, 9]) if op == "hand" else None))
    return log


@pytest.fixture(scope="module")
def logs():
    return {f"b{seed}": made(seed, f"b{seed}") for seed in range(12)}


def test_owners_as_of_every_step(spark, logs):
    ids, chapters = range(1, 8), range(0, 12)
    df = spark.createDataFrame([(*r, "clash") for log in logs.values() for r in log] + [(None, 1, "merge", 1, 2, None, ""), ("b0", None, "merge", 1, 2, None, ""), ("b0", 3, "merge", None, 2, None, ""), ("b0", 3, "other", 1, 2, None, "")], KIND + ", owner string").repartition(4)
    intervals = owner_intervals(df)
    rows = spark.createDataFrame([(b, x, c, s) for b in logs for x in ids for c in chapters for s in range(0, 42, 3)], "book string, id long, at int, step long").withColumn("who", F.col("id"))
    got = {}
    for r in owned(rows, ["who"], "at", intervals, F.col("step")).collect():
        got.setdefault((r["book"], r["step"]), {})[r["id"], r["at"]] = r["who"]
    for book, log in logs.items():
        for step in range(0, 42, 3):
            assert got[book, step] == replay(log, step, ids, chapters), (book, step)
    assert len(got) == 12 * 14


def test_chains_circles_and_undoing(spark):
    log = [("b", 1, "merge", 1, 2, None), ("b", 2, "merge", 2, 3, None), ("b", 3, "merge", 3, 1, None), ("b", 4, "undo", 1, None, None), ("b", 5, "merge", 3, 1, None), ("b", 6, "undo", 99, None, None), ("b", 7, "hand", 4, 2, 5)]
    got = sorted((r["id"], r["owner"], r["ch_from"], r["since"], r["until"]) for r in owner_intervals(spark.createDataFrame(log, KIND)).collect())
    assert got == sorted([(1, 2, None, 1, 2), (1, 3, None, 2, 4), (2, 3, None, 2, 5), (2, 1, None, 5, None), (3, 1, None, 5, None), (4, 1, 5, 7, None)], key=lambda x: x)
    rows = spark.createDataFrame([("b", 4, None, 4), ("b", 4, 2, 6), ("c", 1, 1, 1)], "book string, a long, b long, ch int")
    now = owned(rows, ["a", "b"], "ch", owner_intervals(spark.createDataFrame(log, KIND)), F.lit(7))
    assert sorted(map(tuple, now.collect()), key=str) == sorted([("b", 4, None, 4), ("b", 1, 1, 6), ("c", 1, 1, 1)], key=str)
    assert owner_intervals(spark.createDataFrame([], KIND)).count() == 0


def test_a_model_s_tidying(spark):
    reply = {"same": [{"keep": 1, "merge": ["e2", 3, 1, 77]}, {"keep": 99, "merge": [1]}, "x"], "taken": [{"id": 4, "by": "1", "from_ch": 6}, {"id": 4, "by": 4, "from_ch": 2}, {"id": 5, "by": 1}], "names": [{"id": 1, "name": " Anna "}, {"id": 1}], "wrong": [{"id": 2, "names": ["Tom", 5, ""]}]}
    rows = [("b", 3, [1, 2, 3, 4, 5], "Sure: " + json.dumps(reply)), ("c", 1, [1], "nothing"), ("d", 1, None, json.dumps(reply)), ("e", 1, [1, 2], '{"same": 3, "names": {"id": 1}}')]
    log, names = tidy_decisions(spark.createDataFrame(rows, "book string, step long, shown array<long>, reply string"))
    assert sorted(map(tuple, log.select("book", "op", "a", "b", "ch").collect()), key=str) == sorted([("b", "merge", 2, 1, None), ("b", "merge", 3, 1, None), ("b", "hand", 4, 1, 5)], key=str)
    assert sorted((r["id"], r["name"], r["kept"]) for r in names.collect()) == [(1, "Anna", True), (2, "Tom", False)]
    assert {(r["id"], r["owner"], r["ch_from"]) for r in owner_intervals(log).collect()} == {(2, 1, None), (3, 1, None), (4, 1, 5)}
