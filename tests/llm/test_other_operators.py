"""Media columns, language identification, main text, nearest vectors, the pipeline."""

import hashlib
import math
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import ann, entry, html_main, langid, media
from foliant.llm.common import written

FOLDER = "/root/testdata/sf0.001"


def test_media_payloads_come_back(spark, tmp_path):
    rows = [(1, "short", "x"), (2, None, "x"), (3, "", None), (4, "é" * 5000, "x"), (5, "short", "x"), (None, "a" * 64, "x"), (1, "short", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    manifest = written(media.store(docs, shard_bytes=4096), "test-media")
    assert manifest.count() == 4  # equal texts are stored once
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.references(docs).join(media.features(manifest), "digest").collect()}
    for doc, text, _ in rows:
        raw = (text or "").encode()
        payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        r = got[(doc, len(raw))]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    heads = {r["digest"]: (r["width"], r["height"]) for r in media.metadata(manifest).collect()}
    assert set(w for w, _ in heads.values()) == {64}
    assert media.decode_png(media.encode_png(b"x" * 128)) == b"x" * 128
    assert media.references(docs).join(manifest, "digest").count() == len(rows)


def test_media_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert written(media.store(empty), "test-media").count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab"]
    p = langid.np.array([[0.1], [0.2], [0.3], [0.05], [0.15], [0.1], [0.1], [0.0]])
    lattice = langid.Lattice(pieces)

    def total(text):
        if not text:
            return 1.0
        return sum((p[pieces.index(text[:n])][0]) * total(text[n:]) for n in range(1, len(text) + 1) if text[:n] in pieces)

    for word in ("a", "ab", "abab", "baab"):
        assert abs(lattice.log_probabilities([word], p)[0][0] - math.log(total("▁" + word))) < 1e-9


def test_language_held_out_accuracy(spark):
    out = entry.op5_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = out.filter("held_out").join(truth, "doc_id").filter("lang IS NOT NULL").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok")).agg(F.avg("ok"), F.count("*")).first()
    assert held[1] > 150 and held[0] >= 0.9


def test_language_edges(spark):
    data = spark.createDataFrame([("the river and the house", "en"), ("der fluss und das haus", "de"), (None, "en"), ("x", None)] * 5, "text string, lang string")
    model = langid.fit(data, public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(1, "the house and the river", "z"), (2, "das haus und der fluss", "z"), (3, None, "z"), (4, "", "z"), (5, "123 ... !", None), (6, "x" * 100_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert got[1] == "en" and got[2] == "de" and got[3] == got[4] == got[5] == "und" and got[6] in ("en", "de")
    nothing = langid.fit(data.limit(0), public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_main_text(spark):
    para = "A paragraph of the article, with commas, and enough words to count as text, surely. " * 3
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
      <div class="cookie-notice"><p>We use cookies, and this notice is long, really long, to look like text.</p></div>
      <article><h1>Head &amp; line</h1><p>{para}<p>Second   <b>bold</b>&nbsp;part, {para}</p><script>var p = "<p>no</p>"</script></article>
      <div class="comments"><p>{para}</p></div><footer><p>Copyright, all rights, reserved, 2024, somebody.</p></footer>"""
    text = html_main.main_text(page)
    assert text == "\n".join(["Head & line", para.strip(), ("Second bold part, " + para).strip()])
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p>un<closed", "x"), (1, "u", page, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    got = [(r["page_id"], r["n_chars"]) for r in html_main.extract(pages).orderBy("page_id").collect()]
    assert got[:2] == [(1, len(text))] * 2 and got[2:4] == [(2, 0), (3, 0)]
    assert html_main.extract(pages.limit(0)).count() == 0


def test_nearest_equals_brute_force(spark):
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(16)]) for i in range(300)] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, []), (304, [1.0] * 8), (305, [2.0] * 8), (None, [1.0] * 16)]
    rows += [(400, rows[3][1]), (401, [2 * x for x in rows[3][1]])]  # ties
    vectors = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for x in ann.nearest(vectors.filter("vec_id % 50 = 0 OR vec_id = 304"), vectors, k=5, tile_rows=64, tile_queries=4).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    good = {i: v for i, v in rows if i is not None and v and any(v) and all(math.isfinite(c) for c in v)}
    for q in (i for i in good if i % 50 == 0 or i == 304):
        scores = sorted((-ann.exact_cosine(*map(langid.np.array, (good[q], v))), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        assert [v for _, v in sorted(got[q])] == [i for _, i in scores[:5]]


def test_pipeline_equals_its_parts(spark):
    """Small documents through all stages, against plain Python for each."""
    from tests_llm_brute import brute_pipeline

    r = random.Random(12)
    en = "the river and the house of stone that was by the water with a garden".split()
    de = "der fluss und das haus aus stein war an dem wasser mit einem garten".split()
    rows = []
    for i in range(60):
        words = [f"{r.choice(en if i % 2 else de)}{r.choice(['', 's', 'n', 'er'])}" for _ in range(r.randint(30, 120))]
        rows.append((i, " ".join(words), "en" if i % 2 else "de", f"src{i % 3}", 0))
    rows[10] = (10, rows[9][1], "en", "src1", 0)
    rows[20] = (20, rows[21][1][:200] + " " + rows[20][1], "de", "src2", 0)
    rows[30] = (30, rows[30][1] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "de", "src0", 0)
    rows += [(60, "123 456", "en", "src0", 0), (61, None, None, "src0", None), (62, "", "en", "src0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, FOLDER), f"test-{name}")
    got = {x["doc_id"]: x["text"] for x in docs.collect()}
    assert got == brute_pipeline(rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert pieces.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("whole")).filter("NOT whole").count() == 0
    assert pieces.select("doc_id").distinct().count() == len(got)


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    told = con.execute(entry.ORACLE_SQL[name])
    names = [c[0] for c in told.description]
    plain = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    df = entry.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    got, want = sorted(plain(r) for r in df.select(*names).collect()), sorted(plain(r) for r in told.fetchall())
    assert got == want
