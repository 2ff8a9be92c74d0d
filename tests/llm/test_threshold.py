"""Threshold search against scores of all documents."""

import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa

from foliant.llm import entry, threshold

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(d, terms(t)) for d, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, q in asked.items():
        scored = []
        for d, t in held:
            m = 50 + (50 * len(t) * n_docs) // n_terms
            tf = {x: t.count(x) for x in q if x in t}
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * c) // (1000 * c + 20 * m)) for x, c in tf.items())
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def tables(spark, seed, docs=300, items=12):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["Élan", "naïve", "A-b", "x_y", "UPPER", "中文", "ⅷ", "co la", "é"]
    pick = lambda n: " ".join(r.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n))
    made = [(i, pick(r.choice([1, 5, 40, 200]))) for i in range(docs)]
    made += [(5, made[5][1]), (7, "w1 w2 other"), (None, made[9][1]), (None, "w3"), (900, None), (901, ""), (902, " .,;"), (903, pick(30_000)), *((1000 + i, made[0][1]) for i in range(70))]
    asked = [(i, pick(r.choice([1, 3, 30]))) for i in range(items)] + [(3, "w5 w6"), (50, None), (51, ""), (None, "w1"), (52, "nowhere"), (53, pick(5000))]
    return made, asked


def frames(spark, docs, items):
    return spark.createDataFrame([(*x, "t", 1) for x in docs], "doc_id long, text string, terms string, n int").repartition(3), spark.createDataFrame([(*x, "r") for x in items], "item_id long, text string, rank string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_scores_of_all_documents(spark):
    docs, items = tables(spark, 3)
    d, i = frames(spark, docs, items)
    assert rows(threshold.search(d, i, k=50)) == brute(docs, items, 50)
    # many shards, blocks and few rows; also where there are fewer documents than k
    assert rows(threshold.search(d, i, k=3, shard_entries=900, block_terms=40)) == brute(docs, items, 3)
    assert rows(threshold.search(d, i, k=1000, shard_entries=2500)) == brute(docs, items, 1000)


def test_a_shard_stops_early_and_loses_no_tie():
    r = random.Random(5)
    n = 20_000
    texts = ["common " * r.randint(1, 3) + ("rare " * r.randint(1, 9) if r.random() < 0.02 else "") + "filler " * r.randint(0, 50) for _ in range(n)]
    sizes, row, code, count, names = threshold.term_counts(pa.array(texts))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), names.take(pa.array(code)))
    shard = threshold.Shard(pa.array(list(range(n))), sizes.astype(np.int64), lists, count, n, int(sizes.sum()))
    met = []
    whole = shard.scores
    shard.scores = lambda some, weight: met.append(len(some)) or whole(some, weight)
    weights = {"common": 3, "rare": 4000}
    got, scores = shard.best(weights, 20, first_turn=8)
    every = np.zeros(len(shard.code_of), np.int64)
    for t, w in weights.items():
        every[shard.code_of[t]] = w
    want = whole(np.arange(n), every)
    order = np.lexsort((np.arange(n), -want))[:20]
    assert got.tolist() == order.tolist() and scores.tolist() == want[order].tolist()
    assert sum(met) < n // 10


def test_empty_tables(spark):
    docs, items = tables(spark, 4, docs=12, items=2)
    d, i = frames(spark, docs, items)
    assert threshold.search(d.limit(0), i).count() == 0
    assert threshold.search(d, i.limit(0)).count() == 0
    assert threshold.search(d.filter("doc_id = 900"), i).count() == 0


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(entry.ORACLE_SQL["op11_threshold_search"]).fetchall()
    got = [tuple(r) for r in entry.op11_threshold_search(spark, folder).collect()]
    assert len(got) > 1000 and sorted(got) == sorted(want)
