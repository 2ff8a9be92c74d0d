"""Language identification: sums against brute force, long words and other scripts, edge cases."""

import math
import random

import numpy as np
import public_tokenizers
import pytest

from foliant.llm import langid

PIECES = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba"]
P = np.array([0.1, 0.2, 0.25, 0.05, 0.1, 0.1, 0.1, 0.1, 0.0])


def segmentations(word):
    if not word:
        yield []
        return
    for n in range(1, len(word) + 1):
        if word[:n] in PIECES or n == 1:
            for rest in segmentations(word[n:]):
                yield [word[:n], *rest]


def chance(piece):
    return P[PIECES.index(piece)] if piece in PIECES else langid.UNKNOWN


def test_sums_and_expectations_equal_brute_force():
    r = random.Random(3)
    words = ["a", "b", "c", "ab", "aba", *("".join(r.choices("abc", k=r.randint(1, 12))) for _ in range(40))]
    times = np.array([float(r.randint(1, 9)) for _ in words])
    want, logs = np.zeros(len(PIECES)), []
    for word, n in zip(words, times, strict=True):
        ways = [(s, math.prod(map(chance, s))) for s in segmentations(langid.MARK + word)]
        whole = sum(w for _, w in ways)
        logs.append(math.log(whole))
        for s, w in ways:
            for piece in s:
                if piece in PIECES:
                    want[PIECES.index(piece)] += n * w / whole
    lattice = langid.Lattice(PIECES)
    assert np.allclose(lattice.log_probabilities(words, P[:, None])[:, 0], logs)
    assert np.allclose(lattice.expected(words, times, P), want)


@pytest.mark.parametrize("length", [41, 48, 200, 5000])
def test_long_words_keep_finite_numbers(length):
    lattice = langid.Lattice(PIECES)
    words = ["ც" * length, "ab" * (length // 2)]
    logs = lattice.log_probabilities(words, P[:, None])[:, 0]
    assert np.isfinite(logs).all() and abs(logs[0] - (length * math.log(langid.UNKNOWN) + math.log(0.1))) < 1e-6 * length
    counts = lattice.expected(words, np.ones(2), P)
    assert np.isfinite(counts).all() and counts[0] >= 1


TEXTS = {
    "ja": "これは分かち書きをしない長い日本語の文章であり単語の間に空白がないので一つの語がとても長くなるという例として使われるものである",
    "ka": "საქართველოსკონსტიტუციურისასამართლოსგადაწყვეტილებისაღსრულებისუზრუნველყოფა",
    "am": "የኢትዮጵያፌዴራላዊዲሞክራሲያዊሪፐብሊክሕገመንግሥትአንቀጽየሚመለከተውንጉዳይበተመለከተ",
}


def test_other_scripts_in_training_and_prediction(spark):
    vocab = public_tokenizers.path("piece_bpe_32k.model")
    latin = [("en", "the river and the garden were quiet in the morning"), ("de", "der fluss und der garten waren am morgen still")] * 5
    known = spark.createDataFrame([(*x,) for x in latin], "lang string, text string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS.values(), "the river", "der fluss", "12 ² !?", None, ""])], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(asked, langid.fit(known, vocab)).collect()}
    assert all(0.0 <= s <= 1.0 for _, s in got.values())
    assert got[3][0] == "en" and got[4][0] == "de" and got[5] == got[6] == got[7] == ("und", 0.0)
    more = known.union(spark.createDataFrame([(k, v * 3) for k, v in TEXTS.items()], "lang string, text string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(asked, langid.fit(more, vocab)).collect()}
    assert [got[i][0] for i in range(5)] == ["ja", "ka", "am", "en", "de"] and all(0.0 <= s <= 1.0 for _, s in got.values())


def test_edge_cases(spark):
    vocab = public_tokenizers.path("piece_bpe_32k.model")
    known = spark.createDataFrame([("x", "same words here"), ("y", "same words here")], "lang string, text string")
    model = langid.fit(known, vocab)
    asked = spark.createDataFrame([(1, "same words", "k"), (1, "same words", "k"), (2, "words " * 300_000, None)], "doc_id long, text string, score string")
    got = langid.predict(asked, model)
    assert set(got.columns) == {"doc_id", "text", "lang_pred", "score", "letter_fit"}
    assert [(r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in got.orderBy("doc_id").collect()] == [(1, "x", 0.5), (1, "x", 0.5), (2, "x", 0.5)]
    assert langid.predict(asked.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        langid.fit(known, vocab, most_langs=1)
