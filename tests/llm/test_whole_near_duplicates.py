"""Near-duplicates at the threshold itself, and buckets in several classes against all pairs."""

import random

import pytest

from foliant.llm import order_minhash


def words_of(r, n):
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


@pytest.mark.parametrize("least", [8, 16, 80, 400])
@pytest.mark.parametrize("place", ["prefix", "middle", "suffix"])
def test_a_pair_at_the_threshold_is_near(least, place):
    """All k-mers of one text are in the other, which has a quarter more."""
    r = random.Random(least)
    a = [r.getrandbits(64) for _ in range(least)]
    more = [r.getrandbits(64) for _ in range(least // 4)]
    at = {"prefix": 0, "middle": least // 2, "suffix": least}[place]
    b = a[:at] + more + a[at:]
    x, y = (order_minhash.np.array(v, "u8") for v in (a, b))
    assert order_minhash.alignment_similarity(x, y) == order_minhash.alignment_similarity(y, x) == 0.8


def test_a_text_after_twenty_more_words():
    r = random.Random(5)
    text = words_of(r, 84)
    a, b = order_minhash.labelled([" ".join(text), " ".join(words_of(r, 20) + text)])
    assert (len(a), len(b)) == (80, 100)
    assert order_minhash.alignment_similarity(a, b) == 0.8


def classes_of_all_pairs(texts, entries, threshold=0.8):
    """Least place of each text's class, from the alignment of all pairs that share an entry."""
    kmers = order_minhash.labelled(texts)
    keys = [set(x.tolist()) for x in order_minhash.sketches(kmers, entries)]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if not keys[i].isdisjoint(keys[j]) and order_minhash.alignment_similarity(kmers[i], kmers[j], threshold) >= threshold:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(texts))]


def edited(r, words, n):
    out = list(words)
    for at in r.sample(range(len(out)), n):
        out[at] = f"x{r.randrange(10**9)}"
    return out


def got_and_wanted(spark, groups, entries=order_minhash.ENTRIES):
    rows, want = [], {}
    for texts in groups:
        first = len(rows)
        rows += [(first + i, text) for i, text in enumerate(texts)]
        want |= {first + i: first + c for i, c in enumerate(classes_of_all_pairs(texts, entries))}
    out = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), entries=entries).collect()
    return {r["doc_id"]: r["class_id"] for r in out}, want


def test_stragglers_near_each_other_beside_a_large_class(spark):
    """Close copies, and a few that are far from these but two and two near each other; so few entries that many pairs meet in large buckets only."""
    r = random.Random(12)
    groups = []
    for _ in range(4):
        base = words_of(r, 120)
        texts = [edited(r, base, 1) for _ in range(200)]
        for _ in range(12):
            far = edited(r, base, r.randint(5, 8))
            texts += [edited(r, far, 1), edited(r, far, 1)]
        groups.append([" ".join(t) for t in texts])
    got, want = got_and_wanted(spark, groups, 2)
    assert got == want


def test_copies_about_the_threshold_without_their_original(spark):
    """Pairs at 0.78 to 0.85, in groups of 17 to 150."""
    r = random.Random(13)
    groups = []
    for size in (17, 30, 60, 100, 150):
        base = words_of(r, 250)
        groups.append([" ".join(edited(r, base, r.choice([2, 3, 3, 4]) + r.choice([0, 0, 4]))) for _ in range(size)])
    got, want = got_and_wanted(spark, groups)
    assert got == want and len(set(want.values())) > 5


@pytest.mark.parametrize("n", [6, 40, 300, 3000])
def test_bounds_never_rule_out_a_near_pair(n):
    """links_within of two texts links them if and only if the alignment does."""
    r = random.Random(n)
    near = 0
    for _ in range(60):
        a = words_of(r, n)
        b = edited(r, a, r.randint(0, max(1, n // 40)))[: n - r.randint(0, n // 8)]
        kmers = [x >> order_minhash.np.uint64(32) for x in order_minhash.labelled([" ".join(a), " ".join(b)])]
        rows = [(7, 3, bytes([i]), bytes([i]), True, [7], x.astype("<u4").tobytes(), len(x), order_minhash.bitmap(x).tobytes()) for i, x in enumerate(kmers)]
        like = order_minhash.alignment_similarity(*(x.astype("u4") for x in kmers))
        assert len(order_minhash.links_within(rows)) == (like >= 0.8)
        near += like >= 0.8
    assert near > 10


@pytest.mark.parametrize("block", [order_minhash.BLOCK, 40])
def test_a_bucket_of_thousands_in_many_classes(spark, block):
    """1,500 pairs at 0.849 in which all texts have one passage of 124 words: all meet in some buckets."""
    r = random.Random(15)
    passage = words_of(r, 124)
    rows = []
    for i in range(1500 if block > 40 else 150):
        own = words_of(r, 47)
        other = list(own)
        for at in (5, 20):
            other[at] = f"x{r.randrange(10**9)}"
        rows += [(2 * i, " ".join(own[:24] + passage + own[24:])), (2 * i + 1, " ".join(other[:24] + passage + other[24:]))]
    kmers = order_minhash.labelled([t for _, t in rows[:2]])
    assert order_minhash.alignment_similarity(*kmers) > 0.8
    out = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block=block).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == {i: i // 2 * 2 for i, _ in rows}


def test_no_link_of_a_corpus_is_lost(spark):
    """3,000 documents: copies with few edits of 300 originals and documents of their own, against all pairs, whether they share an entry or not."""
    r = random.Random(16)
    texts = []
    for _ in range(300):
        base = words_of(r, r.randint(20, 220))
        texts += [" ".join(edited(r, base, r.randint(0, max(1, len(base) // 50)))) for _ in range(r.choice([1, 2, 5, 12]))]
    texts += [" ".join(words_of(r, r.randint(3, 60))) for _ in range(3000 - len(texts))]
    kmers = order_minhash.labelled(texts)
    meet = {}
    for i, x in enumerate(kmers):
        for y in x.tolist():
            meet.setdefault(y, []).append(i)
    pairs = {(a, b) for xs in meet.values() for a in xs for b in xs if a < b}
    near = [(a, b) for a, b in pairs if order_minhash.alignment_similarity(kmers[a], kmers[b]) >= 0.8]
    assert len(near) > 1000
    rows = list(enumerate(texts))
    out = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(out[a] == out[b] for a, b in near) == len(near)


def test_long_texts_repeated_rows_and_clashing_columns(spark):
    r = random.Random(17)
    long = words_of(r, 40_000)
    near = edited(r, long, 50)
    rows = [(1, " ".join(long), 0, "k"), (2, " ".join(near), 0, "k"), (2, " ".join(near), 0, "k"), (2, "quite another text of some words", 1, None), (None, None, 2, "k"), (5, "", 3, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int, node string")
    out = sorted(((x["doc_id"] or 0, x["class_id"]) for x in order_minhash.near_duplicates(docs).collect()))
    assert out == [(0, 5), (1, 1), (2, 1), (2, 1), (2, 2), (5, 5)]
