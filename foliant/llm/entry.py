"""The queries of this package with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, html_main, langid, media, merge_queue, order_minhash, packing, repeats, secrets, threshold, toxicity
from .common import table, written


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.nearest(rows.filter(F.col("vec_id") % 50 == 0), rows, k=5).drop("query_row")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = written(media.store(docs), "media-manifest")
    read = media.metadata(manifest).select("digest", "shard", "offset", "width", "height", "bit_depth").join(media.features(manifest), "digest")
    return media.references(docs).join(read, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth", F.col("digest").alias("address")
    )


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def held_out(doc_id: str = "doc_id"):
    """Documents that language identification never learns from; not those without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    out = langid.predict(docs.select("doc_id", "text"), model, keep_text=False)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = public_tokenizers.path("piece_bpe_32k.model")
    model = secrets.fit(spark, secrets.labelled_findings(), vocab)
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), model, vocab, path_col="source")
    return found.filter("is_secret").select("doc_id", "start", "end", "rule", "value_sha256", "score")


def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: Of the labels: toxic, and toxic in a document of low quality; severity is learned.
CATEGORIES = ["toxic", "unusable"]


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, toxic, unusable: a row a labelled document."""
    labels = table(spark, sf_dir, "labels").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    by_doc = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality"))
    return by_doc.select("doc_id", "toxic", (F.col("toxic") * (F.col("quality") == 0).cast("int")).alias("unusable"))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the fit reads no more labels than this, so they can be sent to every task
    some = toxicity_labels(spark, sf_dir).orderBy(F.xxhash64("doc_id"), "doc_id").limit(toxicity.FIT_DOCS)
    chain = toxicity.fit(docs.join(F.broadcast(some), "doc_id"), CATEGORIES, severity_of="toxic")
    said = toxicity.predict(docs, chain, keep_text=False)
    return said.select("doc_id", *(f"p_{c}" for c in chain.categories), *(f"is_{c}" for c in chain.categories))


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=None)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_merge_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_queue.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_mixture_packing": op2_mixture_packing,
    "op3_toxicity_chain": op3_toxicity_chain,
    "op4_media_columns": op4_media_columns,
    "op5_language_id": op5_language_id,
    "op6_main_text": op6_main_text,
    "op7_repeated_strings": op7_repeated_strings,
    "op8_order_minhash": op8_order_minhash,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_nearest_vectors": op10_nearest_vectors,
    "op11_threshold_search": op11_threshold_search,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_merge_queue": op13_merge_queue,
}

ORACLE_SQL: dict[str, str] = {
    "op10_nearest_vectors": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
              AND len([x FOR x IN embedding IF x <> 0]) > 0
        ), n AS (SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS length FROM v),
        pairs AS (
            SELECT q.r AS query_row, q.vec_id AS query_id, r.vec_id AS vec_id, list_dot_product(q.e, r.e) / (q.length * r.length) AS score
            FROM n q JOIN n r ON q.r <> r.r AND len(q.e) = len(r.e) WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM pairs
        )
        SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 5""",
    "op11_threshold_search": r"""
        WITH words AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
            FROM documents WHERE text IS NOT NULL
        ), asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
        ), totals AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM words WHERE len(t) > 0),
        tf AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM words),
        counts AS (SELECT r, doc_id, n, term, count(*) AS tf FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
        weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, totals),
        parts AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)) AS part FROM counts, totals),
        scores AS (SELECT item_id, r, doc_id, CAST(sum(w * part) AS BIGINT) AS score FROM asked JOIN weights USING (term) JOIN parts USING (term) GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS "rank", doc_id, score
        FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
}
