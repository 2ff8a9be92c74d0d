"""Folds in plain Python: batches, alignments, communities, dialogue."""

import random

from foliant.operators.communities import louvain
from foliant.operators.dialogue import quotations, split_dialogue
from foliant.operators.sequences import aligned_lists, batch_numbers, rising


def test_batches():
    assert batch_numbers([3, 3, 3, 9, 1], 6) == [0, 0, 1, 2, 3]
    assert batch_numbers([10, 1], 5) == [0, 1]
    assert batch_numbers([], 5) == []


def test_rising_is_longest():
    r = random.Random(1)
    for _ in range(50):
        pairs = list({(r.randrange(8), r.randrange(8)) for _ in range(8)})
        best = 0
        for mask in range(1 << len(pairs)):
            some = sorted(p for i, p in enumerate(pairs) if mask >> i & 1)
            if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(some[:-1], some[1:], strict=True)):
                best = max(best, len(some))
        got = rising(pairs)
        assert len(got) == best and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got[:-1], got[1:], strict=True))


def chapters(*names):
    """As list_alignment reads names, without its word lists."""
    return [((f"#{n.split()[1]}" if n.lower().startswith("chapter ") and n.split()[1].isdigit() else None), n.lower(), [w for w in n.lower().split() if w not in ("chapter", "the", "a", "an") and not w.isdigit()]) for n in names]


def test_alignment():
    old = chapters("One", "Two", "The long road home", "Four", "Five")
    new = chapters("Preface", "One", "Two", "A long road home", "Vier", "Five", "Six")
    assert aligned_lists(old, new) == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5}
    assert aligned_lists([], chapters("a")) == {} and aligned_lists(chapters("a"), []) == {}
    # as many at either end of the lists is no sign, between two held ones it is
    assert aligned_lists(chapters("X", "Chapter 1", "Y", "Chapter 2", "Z"), chapters("P", "Chapter 1", "Q", "Chapter 2", "R")) == {1: 1, 2: 2, 3: 3}
    # a number out of order is not taken, and a name that many have is none
    assert aligned_lists(chapters("Chapter 1", "Chapter 9", "Chapter 2"), chapters("Chapter 1", "Chapter 2", "Chapter 9")) in ({0: 0, 2: 1}, {0: 0, 1: 2})
    many = chapters(*["Interlude"] * 30)
    assert aligned_lists(many, many) == {} and len(aligned_lists(many[:20], many[:20])) == 20


def test_two_cliques_are_two_communities():
    edges = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(4, 10, 1.0)]
    found = louvain(edges)
    assert {found[i] for i in range(5)} == {0} and {found[i] for i in range(10, 15)} == {1}
    assert louvain(edges[::-1]) == found
    assert louvain([]) == {}


def test_dialogue():
    text = 'He said "yes" and “no'
    found, waits = split_dialogue(text)
    assert [(text[a:b], s) for a, b, s in found] == [("He said ", False), ('"yes"', True), (" and ", False), ("“no", True)]
    assert waits == "”"
    found, waits = split_dialogue("still” out", waits)
    assert found == [(0, 6, True), (6, 10, False)] and waits == ""
    found, waits = split_dialogue("so it was” she said")
    assert found == [(0, 10, True), (10, 19, False)] and waits == ""


def test_quotations():
    text = 'and so” he said, “yes” and "no" or “on and on'
    assert [(text[a:b], c) for a, b, c in quotations(text)] == [("and so”", True), ("“yes”", True), ('"no"', True), ("“on and on", False)]
    assert quotations("plain ' text") == [] and quotations("a “") == []
