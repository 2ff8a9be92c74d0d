"""The kept index against searches of the texts as they are."""

import glob
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.operators import kept_index, search
from foliant.operators.kept_index import KeptIndex, to_feed

KIND = "book string, ch long, version long, text string"
QUESTIONS = ("anth", '"of the" an', "the often", '"the the"', "caf réun", "a", "don't", '"don\'t an"', "", "zz")
WORDS = "anthem anther antler an the then of often river Réunion café cafe stone don't 中文 x".split()


def prose(r, n):
    return " ".join(r.choices(WORDS, k=n))


def batches(r):
    """Chapters by batch: new ones, changed ones, the same again, removed ones, older versions, repeats."""
    state, out = {}, []
    for n in range(4):
        rows = []
        for _ in range(40):
            book, ch = r.choice("ab"), r.randrange(40)
            version = n if r.random() < 0.8 else n - 2
            text = None if r.random() < 0.1 else "" if r.random() < 0.1 else prose(r, r.choice([1, 5, 60]))
            rows.append((book, ch, version, text))
        rows += [(b, c, n, t) for (b, c), (_, t) in list(state.items())[:10]]
        newest = {}
        for b, c, v, t in rows:
            newest[b, c] = max(newest.get((b, c), (-9, "")), (v, t), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
        for k, (v, t) in newest.items():
            if (k not in state and t is not None) or (k in state and v >= state[k][0] and t != state[k][1]):
                state[k] = (v, t)
        out.append((rows + [(None, 1, n, "anthem"), ("a", None, n, "anthem")], {k: t for k, (_, t) in state.items() if t is not None}))
    return out


def texts(spark, state):
    return spark.createDataFrame([(b, c, t, f"{b}-{c}") for (b, c), t in state.items()], "book string, ch long, text string, id string")


def compare(spark, index, state, whole=False):
    t = texts(spark, state)
    for question in QUESTIONS if whole else QUESTIONS[:2]:
        for every in (True, False) if whole else (True,):
            found = search.matching(t, "text", question, every)
            hs = [c for c in found.columns if c[0] == "h"] or ["h0"]
            want = sorted(tuple(r) for r in (found.select("book", "ch", *hs).collect() if search.parsed(question) else []))
            assert sorted(tuple(r) for r in index.hits(question, every).select("book", "ch", *hs).collect()) == want, question
    for prefixes, every in ((["anth", "the"], True), (["caf", "st"], False), (["x"], True)):
        want = search.ranked(t, "ch", "text", prefixes, 1000, every)
        got = index.ranked(prefixes, 1000, every)
        assert sorted((r["ch"], r["score"]) for r in got.collect()) == sorted((r["ch"], r["score"]) for r in want.collect())
    guarded = index.ranked(["an"], 5, guard=F.col("ch") <= 20)
    want = search.ranked(t, "ch", "text", ["an"], 5, up_to=F.col("ch") <= 20)
    assert [r["score"] for r in guarded.collect()] == [r["score"] for r in want.collect()]
    assert {(r["book"], r["ch"]) for r in index.chapters().collect()} == set(state)


def test_batches_of_changes(spark, tmp_path):
    index = KeptIndex(spark, f"{tmp_path}/index")
    assert index.hits("anth").count() == 0 and index.ranked(["a"], 3).count() == 0
    made = batches(random.Random(8))
    for rows, state in made:
        df = spark.createDataFrame(rows, KIND).withColumn("token", F.lit("clash"))
        assert index.put(df) > 0
        assert index.put(df) == 0  # nothing is new
    compare(spark, index, state, True)
    index.compact()
    assert len(glob.glob(f"{tmp_path}/index/chapters/batch=*")) == 1
    compare(spark, index, state)
    index.put(spark.createDataFrame([("a", 1, 99, "anthem of the river"), ("b", 2, 99, None)], KIND))
    state = {k: t for k, t in state.items() if k != ("b", 2)} | {("a", 1): "anthem of the river"}
    compare(spark, index, state)


def test_a_batch_that_failed_before_its_chapters_is_run_again(spark, tmp_path):
    index = KeptIndex(spark, f"{tmp_path}/index")
    index.put(spark.createDataFrame([("a", 1, 1, "anthem the")], KIND), 0)
    # postings of a batch that broke off
    index.put(spark.createDataFrame([("a", 1, 2, "river river"), ("a", 2, 2, "stone")], KIND), 1)
    index._delete(f"{index.path}/chapters/batch=1")
    compare(spark, index, {("a", 1): "anthem the"})
    index.put(spark.createDataFrame([("a", 1, 2, "river stone"), ("a", 2, 2, "stone")], KIND), 1)
    compare(spark, index, {("a", 1): "river stone", ("a", 2): "stone"})


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    index, feed, at = KeptIndex(spark, f"{tmp_path}/index"), f"{tmp_path}/feed", f"{tmp_path}/checkpoint"
    r = random.Random(9)
    state = {("a", c): prose(r, 20) for c in range(250)}
    to_feed(spark.createDataFrame([(b, c, 1, t) for (b, c), t in state.items()], KIND), feed)
    assert len(glob.glob(f"{feed}/*.parquet")) == 3  # a hundred chapters each
    index.feed(feed, at, files=2)
    made = sorted(glob.glob(f"{tmp_path}/index/chapters/batch=*"))
    assert len(made) == 2
    index.feed(feed, at, files=2)
    to_feed(spark.createDataFrame([(b, c, 2, t) for (b, c), t in list(state.items())[:120]], KIND), feed)  # the same texts
    index.feed(feed, at, files=2)
    assert sorted(glob.glob(f"{tmp_path}/index/chapters/batch=*")) == made
    state[("a", 7)] = "café of the anthem"
    to_feed(spark.createDataFrame([("a", 7, 3, state["a", 7])], KIND), feed)
    index.feed(feed, at, files=2)
    compare(spark, index, state)


def test_questions_read_only_their_folders(spark, tmp_path):
    index = KeptIndex(spark, f"{tmp_path}/index")
    index.put(spark.createDataFrame([("a", c, 1, "anthem river stone often the") for c in range(5)], KIND))
    files = index._with_word(F.col("token").startswith("anth"), "anth").inputFiles()
    plan = index._with_word(F.col("token").startswith("anth"), "anth")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "first" in plan.split("PartitionFilters")[1] and "second" in plan.split("PartitionFilters")[1]
    assert files


@pytest.mark.parametrize("question", ["anth"])
def test_hits_by_book(spark, tmp_path, question):
    index = KeptIndex(spark, f"{tmp_path}/index")
    index.put(spark.createDataFrame([("a", 1, 1, "anthem anther"), ("a", 2, 1, "antler"), ("b", 1, 1, "anthem")], KIND))
    assert sorted(tuple(r) for r in index.hits_by_book(question).collect()) == [("a", 1, 2), ("b", 1, 1)]


def test_tasks_that_sort_postings_grow_with_the_words(spark, tmp_path, monkeypatch):
    """More words are more tasks, in which no more is sorted; before, small shuffles were put together and a posting was a row."""
    monkeypatch.setattr(kept_index, "SORTED", 100)
    index = KeptIndex(spark, f"{tmp_path}/index")
    r = random.Random(3)
    state = {("a", c): prose(r, 60) for c in range(60)}
    index.put(spark.createDataFrame([(b, c, 1, t) for (b, c), t in state.items()], KIND).coalesce(1))
    written_by = {f.rsplit("/part-", 1)[1].split("-")[0] for f in glob.glob(f"{tmp_path}/index/postings/batch=*/*/*/*.parquet")}
    assert len(written_by) > 4
    assert index._postings().count() < 60  # a row a word, not one a word of a chapter
    compare(spark, index, state)


@pytest.mark.parametrize("at_once", [1, 7, 50, 10_000])
def test_blocks_of_any_size(at_once, monkeypatch):
    """What a worker takes at once changes the rows, not the postings."""
    r = random.Random(at_once)
    chapters = [(r.choice("ab"), c, r.choices(WORDS, k=r.choice([0, 1, 5, 20]))) for c in range(40)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("book", "ch", "words"), x, strict=True)) for x in chapters[i : i + 9]], pa.schema({"book": pa.string(), "ch": pa.int64(), "words": pa.list_(pa.string())})) for i in range(0, 40, 9)]
    monkeypatch.setattr(kept_index, "AT_ONCE", at_once)
    got = []
    for block in kept_index.blocks(batches):
        for x in block.to_pylist():
            assert len(x["books"]) == len(x["chs"]) == len(x["tfs"]) == len(x["begins"])
            got += [(b, c, x["token"], x["places"][at : at + n]) for b, c, n, at in zip(x["books"], x["chs"], x["tfs"], x["begins"], strict=True)]
    assert sorted(got) == sorted((b, c, w, [i + 1 for i, v in enumerate(ws) if v == w]) for b, c, ws in chapters for w in set(ws))
