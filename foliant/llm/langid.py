"""Language identification by unigram pieces, marginalised over segmentations.

A language is a distribution over the pieces of a fixed public vocabulary. A word's probability
is the sum over all ways to cut it into pieces, found by the forward algorithm; the pieces'
probabilities come from expectation maximisation over the words of labelled texts. A text's
likelihood is the product over its words, and the scores are the languages' posteriors. Sums over
segmentations are scaled as they grow longer, so words of any length have finite logarithms.

Words are runs of letters. Defined results: a text that is null or has no letter is `und` with
score 0; case doesn't count; ties go to the language first in the alphabet; very long texts and
words are read whole; repeated rows are judged each on their own, alike; further columns are
carried along unless they have the name of an output column; with nothing to learn from every text
is `und`; an empty table gives an empty table. Scores are always from 0 to 1, never NaN.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, by_size, slices

#: What lies between words.
BETWEEN = r"[^\p{L}]+"
MARK = "▁"  # stands before a word's first piece in the vocabulary
#: Probability of a letter that no piece covers.
UNKNOWN = 1e-8
#: Letters after which sums are scaled; UNKNOWN to this power is far from the least double.
SCALE_EVERY = 8
#: Labelled documents a language, in expectation, that the fit reads.
FIT_DOCS = 2500
#: Languages that a model may have; it is pieces x languages numbers, on the driver and in each worker.
MOST_LANGS = 1000
EM_ROUNDS = 3
#: Words whose scores a Python worker keeps; over this it starts anew.
KEPT_WORDS = 300_000
#: Sums that are in arrays at once.
SUMS = 1 << 18


def words_of(texts: pa.Array | list[str | None]) -> pa.ListArray:
    """Each text's words, lower-cased, and empty strings where it begins or ends with none."""
    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), BETWEEN)


def vocabulary(path: str) -> list[str]:
    """The vocabulary's pieces that lower-case words can hold."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if p == p.lower() and (p == MARK or p.removeprefix(MARK).isalpha()))


@dataclass
class Edges:
    """All pieces in some words, each from a place to a later one, in the order of their distance from the word's begin.

    A word of n letters (its mark is one) has n + 1 places; words lie one after the other, with `room` places behind each.
    """

    first: np.ndarray  # place at which each word begins
    sizes: np.ndarray  # its letters
    room: int
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray  # the number of pieces, if it is a letter that is none
    single: np.ndarray  # whether it is one letter
    word: np.ndarray
    steps: np.ndarray  # edges that start before 0, 1, 2 ... letters

    @property
    def places(self) -> int:
        return int(self.first[-1] + self.sizes[-1] + 1 + self.room) if len(self.first) else 0

    def chances(self, p: np.ndarray) -> np.ndarray:
        """Probability of each edge's piece. p: by piece, and perhaps model, the last row 0."""
        q = p[self.piece]
        q[self.single] = np.maximum(q[self.single], UNKNOWN)
        return q

    def forward(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled sums of all ways to each place, the scales' logarithms, and each word's log probability. q: (edges, models)."""
        sums = np.zeros((self.places, q.shape[1]))
        scales, log = np.zeros_like(sums), np.zeros((len(self.first), q.shape[1]))
        sums[self.first] = 1
        ahead = np.arange(self.room + 1)
        for step in range(len(self.steps) - 1):
            if step and step % SCALE_EVERY == 0:
                on = np.flatnonzero(self.sizes >= step)
                now = sums[self.first[on] + step]
                log[on] += np.log(now)
                window = self.first[on, None] + step + ahead
                sums[window] /= now[:, None]
                scales[window] = log[on, None]
            a, b = self.steps[step : step + 2]
            sums[self.end[a:b]] += sums[self.start[a:b]] * q[a:b]  # edges of a step have different ends
            scales[self.end[a:b]] = scales[self.start[a:b]]
        last = self.first + self.sizes
        return sums, scales, np.log(sums[last]) + scales[last]

    def expected(self, q: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each edge is used, over all segmentations, by `times` copies of each word. q: (edges,)."""
        sums, scales, whole = (x[:, 0] for x in self.forward(q[:, None]))
        after, after_scales, log = np.zeros(self.places), np.zeros(self.places), np.zeros(len(self.first))
        after[self.first + self.sizes] = 1
        ahead = np.arange(self.room + 1)
        for step in range(len(self.steps) - 2, -1, -1):
            a, b = self.steps[step : step + 2]
            on = np.flatnonzero(self.sizes > step)
            at = self.first[on] + step
            after[at] = np.bincount(self.word[a:b], weights=q[a:b] * after[self.end[a:b]], minlength=len(self.first))[on]
            after_scales[at] = log[on]
            if step % SCALE_EVERY == 0:
                now = after[at]
                log[on] += np.log(now)
                window = at[:, None] + ahead
                after[window] /= now[:, None]
                after_scales[window] = log[on, None]
        used = np.log(sums[self.start]) + scales[self.start] + np.log(after[self.end]) + after_scales[self.end] - whole[self.word]
        return times[self.word] * q * np.exp(used)


class Lattice:
    """Finds all pieces in words by rolling hashes of their substrings."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.none, self.longest = len(pieces), max(map(len, pieces), default=1)
        found: dict[int, int] = {}  # of every begin of a piece: the piece, if it is one
        held: dict[int, str] = {}
        for i, piece in enumerate(pieces):
            h = 0
            for n, c in enumerate(piece, 1):
                h = (h * int(self.BASE) + ord(c) + 1) % 2**64
                if held.setdefault(h, piece[:n]) != piece[:n]:
                    raise ValueError("two pieces have the same hash")
                found.setdefault(h, self.none)
            found[h] = i
        self.keys = np.array(sorted(found), np.uint64)
        self.pieces = np.array([found[h] for h in self.keys.tolist()], np.int64)

    def edges(self, words: list[str]) -> Edges:
        codes = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begins = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        offset = np.arange(len(codes)) - begins[word]
        first = begins + np.arange(len(words)) * (1 + self.longest)
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        starts, lengths, pieces = [], [], []
        for n in range(1, self.longest + 1):
            there = offset[at] + n <= sizes[word[at]]
            at, h = at[there], h[there]
            h = h * self.BASE + codes[at + n - 1]
            k = np.searchsorted(self.keys, h)
            k[k == len(self.keys)] = 0
            begun = self.keys[k] == h if len(self.keys) else np.zeros(len(h), bool)
            piece = np.where(begun, self.pieces[k], self.none) if len(self.keys) else np.full(len(h), self.none)
            edge = piece != self.none if n > 1 else np.ones(len(h), bool)
            starts.append(at[edge])
            lengths.append(np.full(int(edge.sum()), n))
            pieces.append(piece[edge])
            at, h = at[begun], h[begun]
        start, length, piece = (np.concatenate(x) for x in (starts, lengths, pieces))
        order = np.argsort(offset[start], kind="stable")
        start, length, piece = start[order], length[order], piece[order]
        steps = np.searchsorted(offset[start], np.arange(int(sizes.max(initial=0)) + 1))
        place = first[word[start]] + offset[start]
        return Edges(first, sizes, self.longest, place, place + length, piece, length == 1, word[start], steps)

    def parts(self, words: list[str], models: int):
        """(from, to) of stretches of the words whose sums fit SUMS."""
        room = np.cumsum([len(w) + 2 + self.longest for w in words]) * models
        at = 0
        while at < len(words):
            end = max(at + 1, int(np.searchsorted(room, (room[at - 1] if at else 0) + SUMS, "right")))
            yield at, end
            at = end

    def log_probabilities(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Of each word in each language, all segmentations summed. p: (pieces + 1, languages), the last row 0."""
        out = np.empty((len(words), p.shape[1]))
        for a, b in self.parts(words, p.shape[1]):
            edges = self.edges(words[a:b])
            out[a:b] = edges.forward(edges.chances(p))[2]
        return out

    def expected(self, words: list[str], times: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How often each piece occurs in the words of one language, over all segmentations. p: (pieces + 1,), the last 0."""
        counts = np.zeros(self.none + 1)
        for a, b in self.parts(words, 1):
            edges = self.edges(words[a:b])
            counts += np.bincount(edges.piece, weights=edges.expected(edges.chances(p), times[a:b]), minlength=len(counts))
        return counts[:-1]


@dataclass
class Model:
    langs: list[str]
    pieces: list[str]
    p: np.ndarray  # (pieces + 1, languages)


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, n from rows(text, lang)."""

    def run(batches):
        for some in slices(batches, "text"):
            words = words_of(some.column("text"))
            lang = pc.take(some.column("lang"), pc.list_parent_indices(words))
            by = pa.table({"lang": lang, "word": pc.list_flatten(words)}).group_by(["lang", "word"]).aggregate([([], "count_all")])
            by = by.filter(pc.not_equal(by["word"], "")).select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"])
            yield from by.cast(pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])).to_batches()

    return rows.select("text", "lang").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expectation(words: DataFrame, langs: list[str], pieces: list[str], p: np.ndarray) -> np.ndarray:
    """(pieces, languages): how often words(lang, word, n) use each piece under p, over all segmentations."""
    n, number = len(pieces), {lang: k for k, lang in enumerate(langs)}
    sent = words.sparkSession.sparkContext.broadcast((pieces, p))  # pieces x languages: bounded by the vocabulary and MOST_LANGS

    def run(batches):
        lattice, total = Lattice(sent.value[0]), np.zeros((n, len(langs)))
        for some in slices(batches, "word"):
            of = np.array([number[x] for x in some.column("lang").to_pylist()])
            word, times = some.column("word").to_pylist(), some.column("n").to_numpy().astype(float)
            for k in np.unique(of).tolist():
                at = np.flatnonzero(of == k)
                total[:, k] += lattice.expected([word[i] for i in at.tolist()], times[at], sent.value[1][:, k])
        i, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(total[i, k])], names=["k", "piece", "n"])

    found = words.mapInArrow(run, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toArrow()  # at most pieces x languages rows
    out = np.zeros((n, len(langs)))
    out[found["piece"].to_numpy(), found["k"].to_numpy()] = found["n"].to_numpy()
    sent.unpersist()
    return out


def fit(labelled: DataFrame, vocab_path: str, text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, rounds: int = EM_ROUNDS, most_langs: int = MOST_LANGS) -> Model:
    """A model from labelled texts; of each language about fit_docs, chosen by a hash of the text. More languages than most_langs are an error."""
    pieces = vocabulary(vocab_path)
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_langs + 1).collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    langs = sorted(sizes)
    if not langs:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)))
    spark = labelled.sparkSession
    scratch = Scratch(spark, "language")
    share = spark.createDataFrame([(lang, min(1.0, fit_docs / n)) for lang, n in sizes.items()], "lang string, share double")
    chosen = rows.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    # as many files as there are cores, so that every round uses them all
    words = scratch.written(word_counts(chosen).repartition(2 * spark.sparkContext.defaultParallelism, "word", "lang"), "words")
    n = len(pieces)
    p = np.vstack([np.full((n, len(langs)), 1.0 / n), np.zeros(len(langs))])
    for _ in range(rounds):
        counts = expectation(words, langs, pieces, p) + 0.01
        p = np.vstack([counts / counts.sum(axis=0), np.zeros(len(langs))])
    scratch.clear()
    return Model(langs, pieces, p)


class Scorer:
    """Scores texts; the words' scores are kept, as most words come again."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.langs)))

    def _of(self, words: list[str]) -> np.ndarray:
        """Places of the words' rows in scores."""
        known = self.known
        fresh = [w for w in words if w not in known]
        if fresh:
            got = self.lattice.log_probabilities(fresh, self.model.p)
            at = len(known)
            if at + len(fresh) > len(self.scores):
                self.scores = np.vstack([self.scores, np.zeros((at + 2 * len(fresh), self.scores.shape[1]))])
            self.scores[at : at + len(fresh)] = got
            known.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def batch(self, texts: pa.Array | list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, posterior, and mean log likelihood a letter, of each text."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.scores = {}, self.scores[:0]
        lists = words_of(texts)
        n, langs = len(lists), self.model.langs
        flat = pc.dictionary_encode(pc.list_flatten(lists))
        different, code = flat.dictionary.to_pylist(), flat.indices.to_numpy()
        text = pc.list_parent_indices(lists).to_numpy()
        letters = np.array([len(w) for w in different], np.int64)
        real = letters[code] > 0 if len(code) else np.zeros(0, bool)
        text, code = text[real], code[real]
        has = np.bincount(text, minlength=n) > 0
        if not langs or not len(code):
            return ["und"] * n, np.zeros(n), np.zeros(n)
        named = np.zeros(len(different), np.int64)
        some = np.flatnonzero(letters)
        named[some] = self._of([different[i] for i in some.tolist()])
        total = np.zeros((n, len(langs)))
        for a in range(0, len(code), max(1, SUMS // len(langs))):
            of = text[a : a + max(1, SUMS // len(langs))]
            new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            total[of[new]] += np.add.reduceat(self.scores[named[code[a : a + len(of)]]], new, axis=0)
        best = total.argmax(axis=1)
        most = total[np.arange(n), best]
        score = np.where(has, 1 / np.exp(total - most[:, None]).sum(axis=1), 0.0)
        of_letters = np.bincount(text, weights=letters[code], minlength=n)
        return [langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], score, np.where(has, most / np.maximum(of_letters, 1), 0.0)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs plus lang_pred string, score double (posterior), letter_fit double (mean log likelihood a letter)."""
    added = ["lang_pred", "score", "letter_fit"]
    source = docs.drop(*added)
    kept = [c for c in source.columns if keep_text or c != text_col]
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("letter_fit", T.DoubleType())])
    sent = source.sparkSession.sparkContext.broadcast(model)  # pieces x languages, as in fit

    def run(batches):
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(sent.value)
            for some in by_size(batch, text_col):
                langs, score, letter_fit = scorer.batch(some.column(text_col))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(score), pa.array(letter_fit)], names=[*kept, *added])

    return source.mapInArrow(run, schema)
