"""Edge cases: empty tables, repeated rows, clashing columns and very long texts, stage by stage and operator by operator."""

import hashlib
import random

import public_tokenizers
import pytest

import corpus_pipeline
from foliant.llm import ann, bpe, entry, html_main, media
from foliant.llm.common import written

KIND = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = KIND + ", row string, class_id int, queue string, start string, kept string, lang_pred int"
WORDS = "the river and garden were quiet in morning while stone letters lay open on table under water".split()


def prose(r, n):
    return " ".join(r.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    long = prose(r, 120_000)
    made = [(i, prose(r, 60), "en", f"s{i % 3}", 1) for i in range(12)]
    made += [(12, None, None, None, None), (13, "", "en", "s1", 0), (14, long, "en", "s1", 1), (15, long + " more", None, "s1", 1)]
    made += [(1, prose(r, 80), "en", "s2", 1), (2, made[2][1], "en", "s2", 1), (None, prose(r, 70), "en", "s1", 1)]
    return made


def test_each_stage_keeps_rows_columns_and_order(spark, rows):
    docs = written(spark.createDataFrame([(*x, "r", 1, "q", "s", "k", 2) for x in rows], CLASHING).repartition(3), "edges")
    kept = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, ""), f"edges-{name}")
        assert kept.columns == docs.columns, name
        assert {(x["row"], x["class_id"], x["queue"], x["start"], x["kept"], x["lang_pred"]) for x in kept.collect()} == {("r", 1, "q", "s", "k", 2)}
        sizes.append(kept.count())
    # the null and the empty text go; then the repeated row and the near copy of the long text
    assert sizes == [len(rows) - 2, len(rows) - 4, len(rows) - 4, len(rows) - 4]
    ids = sorted(-1 if x["doc_id"] is None else x["doc_id"] for x in kept.collect())
    assert ids == sorted([-1, *range(12), 1, 14])  # both texts of id 1 are there
    packed = corpus_pipeline.pack_sequences(spark, kept, "").toPandas()
    assert packed.groupby("sequence_id").length.sum().iloc[:-1].eq(1024).all()


def test_each_stage_of_an_empty_table(spark):
    docs = spark.createDataFrame([], KIND)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_bpe_of_nothing_and_of_clashing_columns(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.createDataFrame([(1, "two words", "k", "n")], "doc_id long, text string, ids string, decoded string")
    coded = bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()
    assert bytes(coded[0]["decoded"]) == b"two words" and coded[0]["n_tokens"] == 2
    assert bpe.round_trip(docs.limit(0), path, pattern).count() == 0


def test_media_of_many_megabytes(spark):
    text = "é and stone " * 700_000
    docs = spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string")
    manifest = written(media.store(docs), "edges-media")
    assert manifest.count() == 2
    got = media.references(docs).join(media.features(manifest), "digest").collect()
    raw = text.encode()
    payload = raw + b"\0" * (-len(raw) % 64)
    assert {(r["n_bytes"], r["payload_sha256"]) for r in got} == {(len(raw), hashlib.sha256(payload).hexdigest()), (0, hashlib.sha256(b"\0" * 64).hexdigest())}


def test_a_very_long_page(spark):
    para = "A paragraph with commas, and words enough to count, as text of the article. " * 20
    page = "<body><nav>" + "<a href=x>menu</a> " * 5000 + "</nav><article>" + f"<p>{para}" * 3000 + "</article>"
    docs = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x")], "page_id long, url string, html string, text string")
    got = html_main.extract(docs).collect()
    assert got[0] == got[1] and got[0]["text"].count("\n") == 2999 and got[0]["n_chars"] == 3000 * len(para.strip()) + 2999


def test_vectors_of_nothing_repeated_ids_and_clashing_columns(spark):
    kind = "vec_id long, embedding array<float>, rank int, score string"
    rows = ann.usable(spark.createDataFrame([(0, [1.0, 0.0], 1, "x"), (1, [1.0, 0.1], 1, "x"), (1, [1.0, 0.1], 1, "x"), (50, [0.0, 1.0], 1, "x")], kind))
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(rows.filter("vec_id % 50 = 0"), rows, 5).collect())
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, 50), (50, 1, 1), (50, 2, 1), (50, 3, 0)]
    # one id with two vectors: two questions, and each finds the other
    twice = ann.usable(spark.createDataFrame([(50, [1.0, 0.0], 1, "x"), (50, [1.0, 0.2], 1, "x"), (7, [0.0, 1.0], 1, "x")], kind))
    got = sorted((r["rank"], r["vec_id"], round(r["score"], 4)) for r in ann.nearest(twice.filter("vec_id % 50 = 0"), twice, 5).collect())
    assert got == [(1, 50, 0.9806), (1, 50, 0.9806), (2, 7, 0.0), (2, 7, 0.1961)]
    none = ann.usable(spark.createDataFrame([], kind))
    assert ann.nearest(none, none, 5).count() == 0


def test_documents_without_an_id_are_not_held_out(spark):
    docs = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert docs.filter(entry.held_out().isNull()).count() == 0


def test_of_rows_of_one_id_and_text_a_definite_one_stays(spark):
    text = prose(random.Random(3), 50)
    for rows in ([(1, text, "en", "b", 1), (1, text, "en", "a", 1), (1, text, None, "c", 1)], [(1, text, None, "c", 1), (1, text, "en", "a", 1), (1, text, "en", "b", 1)]):
        docs = written(spark.createDataFrame(rows, KIND).repartition(3), "definite")
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
        assert [(r["lang"], r["source"]) for r in kept] == [("en", "a")]
