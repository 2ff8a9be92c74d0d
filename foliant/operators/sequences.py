"""Folds over ordered lists, a group at a time: batches under a budget, two chapter lists aligned."""

from __future__ import annotations

import bisect
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chapter_number, plain_words

WITHIN = 50
LEAST_LIKENESS = 0.5
#: Chapters that may share a number or a name before it says nothing.
MOST_ALIKE = 20
# Words that say nothing of a chapter in particular.
SAYS_NOTHING = "chapter chap ch c episode ep volume vol v part pt the a an of".split()


def batch_numbers(costs: list[int], budget: int) -> list[int]:
    """The batch of each item: a batch ends before an item that would exceed the budget; a costlier item is alone."""
    out, batch, spent = [], 0, 0
    for cost in costs:
        if spent and spent + cost > budget:
            batch, spent = batch + 1, 0
        out.append(batch)
        spent += cost
    return out


def batches(items: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """group, order, batch. A group is a book: its chapters fit a task."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return rows[[group, order]].assign(batch=batch_numbers(rows[cost].tolist(), budget))

    kinds = dict(items.dtypes)
    return items.select(group, order, cost).groupBy(group).applyInPandas(fold, f"{group} {kinds[group]}, {order} {kinds[order]}, batch long")


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest list of pairs that rises in both parts."""
    ordered = sorted(pairs, key=lambda p: (p[0], -p[1]))
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(ordered)
    for i, (_, b) in enumerate(ordered):
        at = bisect.bisect_left(tails, b)
        before[i] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[at], ends[at] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(ordered[i])
        i = before[i]
    return out[::-1]


def _candidates(old: list, new: list, most: int = MOST_ALIKE) -> set[tuple[int, int]]:
    """Pairs of places with one key; a key that very many chapters have says nothing, so it makes none."""
    at: dict = {}
    for j, k in enumerate(new):
        if k:
            at.setdefault(k, []).append(j)
    return {(i, j) for i, k in enumerate(old) if k and len(at.get(k, ())) <= most for j in at.get(k, ())}


def _telling(words: list[frozenset[str]]) -> list[frozenset[str]]:
    """The words without those that over half of a list shares."""
    if len(words) < 4:
        return words
    seen = Counter(w for ws in words for w in ws)
    common = {w for w, n in seen.items() if 2 * n > len(words)}
    return [ws - common for ws in words]


def aligned_lists(old: list[tuple], new: list[tuple]) -> dict[int, int]:
    """old place -> new place of chapters (number or None, plain name, words).

    Equal numbers and equal names in the longest rising order; between these, chapters by the words of their titles,
    within WITHIN places; then gaps of equal size between two held pairs, but not at the ends of the lists.
    """
    pairs = _candidates([c[0] for c in old], [c[0] for c in new]) | _candidates([c[1] for c in old], [c[1] for c in new])
    held = dict(rising(list(pairs)))
    a, b = _telling([frozenset(c[2]) for c in old]), _telling([frozenset(c[2]) for c in new])
    found = dict(held)
    marks = [(-1, -1), *sorted(held.items()), (len(old), len(new))]
    for (i0, j0), (i1, j1) in zip(marks[:-1], marks[1:], strict=True):
        inner, floor = [(i0, j0)], j0 + 1
        for i in range(i0 + 1, i1):
            like = [(len(a[i] & b[j]) / len(a[i] | b[j]), -j) for j in range(floor, min(j1, floor + WITHIN)) if a[i] and b[j]]
            if like and max(like)[0] > LEAST_LIKENESS:
                found[i] = -max(like)[1]
                inner.append((i, found[i]))
                floor = found[i] + 1
        inner.append((i1, j1))
        for (p, q), (r, s) in zip(inner[:-1], inner[1:], strict=True):
            if r - p == s - q and p >= 0 and r < len(old):
                found.update(zip(range(p + 1, r), range(q + 1, s), strict=True))
    return found


def list_alignment(old: DataFrame, new: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """group, old_place, new_place of the chapters that two lists share; places by order. A group is a novel's list of names, not its text."""
    kind = dict(old.dtypes)[group]
    words = F.filter(plain_words(F.coalesce(F.col(name), F.lit(""))), lambda w: w != "")
    plain = F.array_join(F.transform(words, lambda w: F.regexp_replace(w, "^0+(?=[0-9]+$)", "")), " ")
    telling = F.filter(words, lambda w: ~w.isin(SAYS_NOTHING) & ~w.rlike("^[0-9]+$"))
    keys = [F.col(group), F.col(order), chapter_number(F.coalesce(F.col(name), F.lit(""))).alias("_number"), plain.alias("_plain"), telling.alias("_words")]

    def rows(x: pd.DataFrame) -> list[tuple]:
        x = x.sort_values(order)
        return [(None if pd.isna(n) else f"#{n}", p, w) for n, p, w in zip(x["_number"], x["_plain"], x["_words"], strict=True)]

    def fold(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = aligned_lists(rows(a), rows(b))
        return pd.DataFrame([(key[0], i, j) for i, j in sorted(found.items())], columns=[group, "old_place", "new_place"])

    return old.select(keys).groupBy(group).cogroup(new.select(keys).groupBy(group)).applyInPandas(fold, f"{group} {kind}, old_place long, new_place long")
