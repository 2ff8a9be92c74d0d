"""A corpus pipeline: language identification, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor has kept; all but the
last return the columns of documents, in order, and carry further ones along whatever their names.
Very long texts are read whole; an empty table stays one. A stage's result is written as Parquet
and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import langid, order_minhash, packing, repeats, secrets
from foliant.llm.common import table, written

#: Posterior of the best language under which a document is rejected.
LEAST_SCORE = 0.5
#: Stretches whose ids a packing task keeps; its workers still hold what the stages before left in them.
KEPT_STRETCHES = 200_000


def _pieces() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a posterior of LEAST_SCORE; a null lang becomes the one found.

    Rejected are texts that are null, empty or without a letter, and those torn between languages; with no lang to
    learn from all are. Repeated rows are judged alike; ties go to the language first in the alphabet.
    """
    model = langid.fit(docs, _pieces())
    found = langid.predict(_bundled(docs), model)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return _unbundled(kept, docs, {"text": F.col("text"), "lang": F.coalesce("row.lang", "lang_pred")})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row, with the smallest id; all rows without an id stay.

    Of rows of a class that have the same smallest id one stays, of equal texts the first by its other columns; rows that share an id but are of
    different classes stay each for its own class. A null text is an empty one, and near to no other.
    """
    classes = order_minhash.classes(docs)
    key = {"__id": F.col("doc_id").cast("long"), "__node": order_minhash.text_node()}
    ids = docs.filter(F.col("doc_id").isNotNull()).select(*(c.alias(n) for n, c in key.items()))
    first = ids.join(classes.withColumnRenamed("node", "__node"), "__node").filter(F.col("__id") == F.col("class_id")).groupBy("label").agg(F.min("__node").alias("__node"), F.min("__id").alias("__id"))
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.struct(*docs.columns).alias("__row"), *(c.alias(n) for n, c in key.items()))
    kept = rows.join(first.select("__id", "__node"), ["__id", "__node"], "left_semi")
    # rows of one id and text may differ in other columns; the one whose others are first as JSON stays, wherever it lies
    others = F.to_json(F.struct(*(F.col("__row")[c].alias(c) for c in docs.columns if c != "text")))
    one = kept.groupBy("__id", "__node").agg(F.min_by("__row", others).alias("__row"))
    return one.select("__row.*").unionByName(docs.filter(F.col("doc_id").isNull()))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 100 bytes that are also earlier; every document stays.

    A null text becomes empty; a null id is later than all others; of equal strings in one document the first stays.
    """
    cut = repeats.remove(_bundled(docs), keep="text")
    return _counted(_unbundled(cut, docs, {"text": F.col("kept")}))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark; every document stays, null and empty texts as they are."""
    model = secrets.fit(spark, secrets.labelled_findings(), _pieces())
    findings = secrets.scan(docs, model, _pieces(), path_col="source")
    return _counted(secrets.redact(docs, findings)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; a null or empty text is the end id alone, a null source a queue of its own."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), kept=KEPT_STRETCHES)


def _bundled(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, so that no name can meet a stage's own."""
    return docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("row"))


def _unbundled(rows: DataFrame, docs: DataFrame, new: dict) -> DataFrame:
    """The columns of docs again, some of them new."""
    return rows.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
