"""Toxicity categories by a chain of linear classifiers.

Categories are predicted in a fixed order. Each has a logistic regression over words, chosen by
how much more often they occur in labelled documents of a category, and over the probabilities
of the categories before it, and a few shares that tell how a text is written. In training those probabilities are predicted out of fold, so that
a later model learns from what an earlier one says of texts that it hasn't seen.

Words are what white space separates, lower-cased, without marks at their ends; a word's value
is log2(1 + times). The fit reads at most `fit_docs` labelled documents, chosen by a hash of their
ids; prediction reads every whole text. Besides the labelled categories a chain may end with
`severe`: documents of one category that hold more of the words that tell of it than half of them
do. It is a weak label, learned from the labels, with no list of words behind it.

Defined results: a null text counts as empty and, like a text without known words, gets the
probabilities of having none; a very long text is read whole; words that tell as much are taken in
their order; repeated rows are judged each on their own, alike; further columns are carried along
unless they have the name of an output column; an empty table gives an empty table; with no
labelled document, or a category with labels of one kind, its probability is that kind's share (0
without labels).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_size, whole_text, written

FIT_DOCS = 10_000
WORDS = 256
#: How much more than chance over all words a word must tell: the log likelihood ratio less the log of their number.
LEAST_TOLD = 3.0
#: Shares of marks, capitals and digits among the characters, and of different words among the words.
SHAPES = 4
#: Name of the category by learned severity.
SEVERE = "severe"
FOLDS = 5
LEAST_DOCS = 5
RIDGE = 0.02
THRESHOLD = 0.5


def _bare(word: str) -> str:
    word = word.lower()
    at, end = 0, len(word)
    while at < end and not word[at].isalnum():
        at += 1
    while end > at and not word[end - 1].isalnum():
        end -= 1
    return word[at:end]


def word_counts(texts: list[str], words: dict[str, int]) -> np.ndarray:
    """(texts, words): how often each of the words occurs in each text."""
    split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    coded = pc.dictionary_encode(split.values)
    number = np.fromiter((words.get(_bare(w), -1) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    out = np.zeros((len(texts), len(words)), np.float64)
    if len(coded.dictionary):
        of = number[coded.indices.to_numpy()]
        hit = np.flatnonzero(of >= 0)
        text = np.searchsorted(split.offsets.to_numpy(), hit, "right") - 1
        np.add.at(out, (text, of[hit]), 1)
    return out


def shapes(texts: list[str]) -> np.ndarray:
    """(texts, SHAPES): shares from 0 to 1."""
    t = pa.array(texts, pa.large_string())
    n = np.maximum(pc.utf8_length(t).to_numpy().astype(float), 1)
    found = [pc.count_substring_regex(t, p).to_numpy() / n for p in (r"[^\p{L}\p{N}\s]", r"\p{Lu}", r"\p{N}")]
    split = pc.utf8_split_whitespace(t)
    code = pc.dictionary_encode(split.values).indices.to_numpy().astype(np.int64)
    sizes = np.diff(split.offsets.to_numpy())
    pairs = np.unique(np.repeat(np.arange(len(texts)), sizes) * (int(code.max(initial=0)) + 1) + code)
    different = np.bincount(pairs // (int(code.max(initial=0)) + 1), minlength=len(texts))
    return np.stack([*found, different / np.maximum(sizes, 1)], axis=1)


def features(texts: list[str], words: dict[str, int]) -> np.ndarray:
    """(texts, words and SHAPES): log2(1 + times) of each word, and the shares, which weigh like a few words."""
    return np.hstack([np.log2(1 + word_counts(texts, words)), 4 * shapes(texts)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Weights, the constant last, by Newton's method with a quadratic penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = float(y.mean()) if len(y) else 0.0
    w = np.zeros(x.shape[1])
    if share in (0.0, 1.0):
        w[-1] = 30.0 * (2 * share - 1)
        return w
    w[-1] = np.log(share / (1 - share))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (w * w))

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        while (then := loss(w - step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w, now = w - step, then
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    categories: list[str]
    words: list[str]
    weights: list[np.ndarray]  # of category i: the words, the i categories before it, a constant

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(texts, categories): probabilities, from `features`."""
        first = x.shape[1]
        for w in self.weights:
            x = np.hstack([x, probability(x, w)[:, None]])
        return x[:, first:]


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, categories: list[str], words: list[str]) -> Chain:
    """labels: (texts, categories) of 0 and 1; folds: a number for each text."""
    weights = []
    for i in range(len(categories)):
        y = labels[:, i].astype(float)
        unseen = np.zeros(len(y))
        for f in np.unique(folds):
            out = folds == f
            unseen[out] = probability(x[out], logistic(x[~out], y[~out]))
        weights.append(logistic(x, y))
        x = np.hstack([x, unseen[:, None]])
    return Chain(categories, words, weights)


def telling_words(sample: DataFrame, categories: list[str], words: int = WORDS, least_docs: int = LEAST_DOCS) -> list[str]:
    """The words, at most `words`, that tell most of some category: likelihood ratio of being in its documents more often than in others."""
    total = sample.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in categories)).first()
    found = sample.select("words", *categories).select(F.explode("words").alias("word"), *categories)
    by_word = found.groupBy("word").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in categories)).filter(F.col("n") >= least_docs)

    def ratio(c: str):
        yes, all_ = float(total[c] or 0), float(total["n"])
        a, n = F.col(c).cast("double"), F.col("n").cast("double")
        terms = F.lit(0.0)
        for seen, of, share in ((a, yes, None), (n - a, all_ - yes, None)):
            expected = n * F.lit(of / all_ if all_ else 0.0)
            terms = terms + F.when((seen > 0) & (expected > 0), seen * F.log(seen / expected)).otherwise(F.lit(0.0))
        return F.when(a * F.lit(all_) > n * F.lit(yes), terms).otherwise(F.lit(0.0))

    best = by_word.select("word", F.greatest(*map(ratio, categories), F.lit(0.0)).alias("told")).filter(F.col("told") > LEAST_TOLD + math.log(max(1, by_word.count())))
    return [r["word"] for r in best.orderBy(F.desc("told"), "word").limit(words).collect()]


def severe_labels(counts: np.ndarray, base: np.ndarray) -> np.ndarray:
    """1 for documents of the base category with more different telling words than its median document; a word tells if a larger share of its documents has it than of others."""
    has = counts > 0
    if not base.any() or base.all():
        return np.zeros(len(base), int)
    tells = has[base > 0].mean(axis=0) > has[base == 0].mean(axis=0)
    n = has[:, tells].sum(axis=1)
    return ((base > 0) & (n > np.median(n[base > 0]))).astype(int)


def judged(labelled: DataFrame, chain: Chain, category: str, text_col: str = "text", threshold: float = THRESHOLD) -> dict[str, float]:
    """precision and recall of a category on labelled documents, which the chain should not have seen."""
    said = predict(labelled.select(text_col, F.col(category).alias("label")), chain, text_col, threshold, keep_text=False)
    yes, is_ = F.col(f"is_{category}"), F.col("label") == 1
    hit, n, m = said.agg(F.count_if(yes & is_), F.count_if(yes), F.count_if(is_)).first()
    return {"precision": hit / max(1, n), "recall": hit / max(1, m)}


def fit(labelled: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, words: int = WORDS, folds: int = FOLDS, severity_of: str | None = None) -> Chain:
    """A chain from documents with a 0/1 column for each category, in the order given, and severity of one of them last. Equal texts are read once."""

    def bag(batches):
        for batch in batches:
            for text in by_size(batch, "text"):
                bags = [sorted({b for w in x.split() if (b := _bare(w))}) for x in text.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(text.column(c) for c in ("fold", "text", *categories)), pa.array(bags, pa.list_(pa.string()))], names=["fold", "text", *categories, "words"])

    rows = labelled.filter(F.col(id_col).isNotNull()).select(F.pmod(F.xxhash64(whole_text(text_col)), F.lit(folds)).cast("int").alias("fold"), F.col(id_col).alias("id"), whole_text(text_col).alias("text"), *(F.col(c).cast("int").alias(c) for c in categories))
    rows = rows.orderBy(F.xxhash64("id"), "id").limit(fit_docs).dropDuplicates(["text"]).drop("id")
    sample = written(rows.mapInArrow(bag, T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in categories), T.StructField("words", T.ArrayType(T.StringType()))])), "toxicity-sample")
    chosen = telling_words(sample, categories, words)
    number = {w: i for i, w in enumerate(chosen)}

    def counted(batches):
        for batch in batches:
            for some in by_size(batch, "text"):
                got = features(some.column("text").to_pylist(), number)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("fold", *categories)), pa.array([x.tobytes() for x in got.astype("<f8")], pa.binary())], names=["fold", *categories, "x"])

    got = sample.select("fold", "text", *categories).mapInArrow(counted, ", ".join(["fold int", *(f"{c} int" for c in categories), "x binary"])).collect()  # at most fit_docs rows of `words` numbers
    every = categories + [SEVERE] * bool(severity_of)
    if not got:
        return Chain(every, [], [np.concatenate([np.zeros(SHAPES + i), [-30.0]]) for i in range(len(every))])
    order = sorted(range(len(got)), key=lambda i: (got[i]["fold"], bytes(got[i]["x"])))
    x = np.array([np.frombuffer(bytes(got[i]["x"]), "<f8") for i in order])
    labels = np.array([[got[i][c] or 0 for c in categories] for i in order])
    if severity_of:
        labels = np.hstack([labels, severe_labels(x[:, : len(chosen)], labels[:, categories.index(severity_of)])[:, None]])
    return fit_chain(x, labels, np.array([got[i]["fold"] for i in order]), every, chosen)


def predict(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """docs plus p_<category> double and is_<category> boolean for each category."""
    added = [f"p_{c}" for c in chain.categories] + [f"is_{c}" for c in chain.categories]
    source = docs.drop(*added)
    kept = [c for c in source.columns if keep_text or c != text_col]
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(c, T.DoubleType() if c.startswith("p_") else T.BooleanType()) for c in added])
    number = {w: i for i, w in enumerate(chain.words)}

    def run(batches):
        for batch in batches:
            filled = batch.set_column(batch.schema.get_field_index(text_col), text_col, pc.fill_null(batch.column(text_col), ""))
            at = 0
            for some in by_size(filled, text_col):
                p = chain.predict(features(some.column(text_col).to_pylist(), number))
                own = batch.slice(at, some.num_rows)
                at += some.num_rows
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in kept), *(pa.array(p[:, i]) for i in range(p.shape[1])), *(pa.array(p[:, i] >= threshold) for i in range(p.shape[1]))], names=[*kept, *added])

    return source.mapInArrow(run, schema)
