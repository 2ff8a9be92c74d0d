"""The chain on documents that it hasn't seen, and its edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import entry, toxicity

FOLDER = "/root/testdata/sf0.1"


def test_held_out_precision_and_recall(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labelled = docs.join(entry.toxicity_labels(spark, FOLDER), "doc_id")
    held = F.pmod(F.xxhash64("text"), F.lit(4)) == 0  # equal texts fall on one side
    chain = toxicity.fit(labelled.filter(~held), entry.CATEGORIES, severity_of="toxic")
    assert chain.categories == ["toxic", "unusable", "severe"]
    got = toxicity.judged(labelled.filter(held), chain, "toxic")
    assert got["precision"] >= 0.95 and got["recall"] >= 0.85, got
    # about one label in eight here is of a text with no telling word; where there is one of the strongest, it is found
    first = "|".join(chain.words[:8])
    worded = labelled.filter(held & F.lower("text").rlike(f"(?<![a-z])(?:{first})(?![a-z])") & (F.col("toxic") == 1))
    assert toxicity.judged(worded, chain, "toxic")["recall"] >= 0.97
    assert toxicity.judged(labelled.filter(held), chain, "unusable")["precision"] >= 0.7


def test_severity_is_having_more_of_what_tells():
    counts = np.array([[1, 0, 0, 5], [1, 1, 0, 4], [1, 1, 1, 5], [0, 0, 0, 5], [0, 0, 0, 6]])
    assert toxicity.severe_labels(counts, np.array([1, 1, 1, 0, 0])).tolist() == [0, 0, 1, 0, 0]
    assert toxicity.severe_labels(counts, np.zeros(5, int)).tolist() == [0] * 5


def test_repeated_rows_long_texts_ties_and_empty_tables(spark):
    r = random.Random(2)
    plain = "river stone letter morning quiet garden number open".split()
    made = [(i, " ".join(r.choices(plain, k=12)) + (" vile awful" if i % 2 else ""), i % 2) for i in range(80)]
    data = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    chain = toxicity.fit(data, ["toxic"], severity_of="toxic")
    asked = spark.createDataFrame([(1, "quiet " * 400_000 + "vile awful", "k"), (2, "vile awful", "k"), (2, "vile awful", "k"), (3, None, "k")], "doc_id long, text string, is_severe string")
    got = toxicity.predict(asked, chain, keep_text=False).orderBy("doc_id").collect()
    assert [x["is_toxic"] for x in got] == [True, True, True, False] and got[1] == got[2]
    assert toxicity.predict(asked.limit(0), chain).count() == 0
    alike = toxicity.fit(data.withColumn("toxic", F.lit(1)), ["toxic"])
    assert all(x["is_toxic"] for x in toxicity.predict(asked, alike).collect())
    with pytest.raises(ValueError):
        toxicity.fit(data, ["toxic"], severity_of="rude")
