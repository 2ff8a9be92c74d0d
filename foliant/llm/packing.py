"""Mixture-controlled packing of documents into training sequences.

Every source is a queue of tokens with a target share. Deficit round-robin serves them: with every
token that passes, each queue's credit grows by its share, and the queue whose deficit (credit less
what it was served) comes first to half a token is served, ties in the order of the queues' names.
So a queue's token i falls due at (i + 1/2) / share, and a window takes the next tokens by their due
times until it is exactly full; deficits, never above a token, are carried from window to window. As
due times follow from a token's number alone, partitions continue each other's deficits without a
message between them. A queue that has run out leaves its share to the others; queues without a
target come when all others have ended. Within a window each queue's tokens lie together. The
windows, end to end, are cut into sequences of `length` tokens; only the last one is not full.

Defined results: a null text counts as empty, a document without text is the end id alone; null
sources are a queue of their own; repeated rows are packed each on their own; a very long text is
encoded whole and may take many windows; further columns don't matter, whatever their names; an
empty table gives no pieces. A document lies in its queue at its place in the table as Spark reads it.
"""

from __future__ import annotations

import itertools
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, slices, whole_text, written

SEQUENCE = 1024
#: Sequences of a window. A queue is cut once a window at most, so few documents are cut for the mixture's sake.
WINDOW_SEQUENCES = 64
#: Targets by default: a source's tokens to this power, so that small sources come more often than their size says.
TEMPER = 0.7
#: Stretches of text whose ids a Python worker keeps, about 90 MB; over this it starts anew.
KEPT_STRETCHES = 500_000
#: Letters up to here are the same in every version of Unicode that a splitter may follow.
SETTLED = "\u024f"
#: A run of these behind a letter or digit is a match of every byte-level splitter.
MARKS = string.punctuation
#: Stands before stretches that begin a text, and so have no space before them; and before runs of marks at the end of one. No stretch holds a space.
BEGINS, ENDS = "\0begins ", "\0ends "
END_ID = 0
#: Codes of the end of a text and of nothing.
END, NOTHING = 0, 1
#: What a stretch says of its text: it can't be taken apart; the stretch is an end of line alone; it can't come after one.
ODD, BLANK, DULL = 1, 2, 4
#: Queue of rows without a source.
NO_SOURCE = "\0none"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class StretchEncoder:
    """Ids of whole texts by a byte-level tokenizer, with the ids of stretches that come again kept.

    A byte-level splitter never has a match across a space that follows a non-space, nor across an end of
    line that does, so a text is the sum of its stretches from one such place to the next, and a stretch of
    the splitter's matches, each of which goes to the tokenizer's model by itself. Marks at the end of a
    stretch are kept apart from it, so a word is learned once, whatever follows it. Texts with other runs of
    white space, or that hold the name of an added token, are encoded whole.
    """

    def __init__(self, path: str, kept: int = KEPT_STRETCHES):
        self.kept = kept
        self.tokenizer = tokenizer(path)
        self.model, self.split = self.tokenizer.model, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # how the splitter spells letters that are the same in every version of Unicode
        self.letters = {i: self.split(c)[0][0] for i in range(ord(SETTLED) + 1) if (c := chr(i)).isalpha()}
        self.space, self.line = self.split(" ")[0][0], self.split("\n")[0][0]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # stretches without the space before them and the marks behind; others have a sign before them
        self.matches: dict[str, list[int]] = {}
        self.says = np.zeros(2, np.uint8)
        self.lens, self.starts = np.array([1, 0], np.int64), np.zeros(2, np.int64)
        self.flat = np.full(1, END_ID, np.uint32)

    def _model_ids(self, match: str) -> list[int]:
        return [t.id for t in self.model.tokenize(match)]

    def _of_match(self, match: str) -> list[int]:
        ids = self.matches.get(match)
        if ids is None:
            ids = self.matches[match] = self._model_ids(match)
        return ids

    def _spelled(self, word: str) -> str | None:
        """The letters for a word's bytes, if it is of settled letters alone."""
        if not word.isalpha():
            return None
        if word.isascii():
            return word
        return word.translate(self.letters) if max(word) <= SETTLED else None

    def _ids(self, word: str) -> list[int]:
        """Ids of a space and the stretch behind it; most are a word, or a word and marks."""
        bare = word.rstrip(MARKS)
        spelled = self._spelled(bare)
        if spelled is None:
            return self._of_any(" " + word)
        ids = self._of_match(self.space + spelled)
        return ids if len(bare) == len(word) else ids + self._of_match(word[len(bare) :])

    def _of_head(self, head: str) -> list[int]:
        """Ids of a stretch with what comes before it: an end of line, which it then begins with, or a space."""
        line = head.startswith("\n")
        spelled = self._spelled(head[1:] if line else head)
        if spelled is None:
            return self._of_any(head if line or head.startswith("\r\n") else " " + head)
        return self._of_match(self.line) + self._model_ids(spelled) if line else self._model_ids(self.space + spelled)

    def _of_any(self, stretch: str) -> list[int]:
        return list(itertools.chain.from_iterable(self._of_match(letters) for letters, _ in self.split(stretch)))

    def _codes(self, keys: list[str], words: list[str], ids_of, says=None) -> np.ndarray:
        """Each key's code; the ids of words that are new are kept."""
        codes = np.fromiter(map(self.known.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(codes < 0)
        if not len(new):
            return codes
        places, at = {}, len(self.lens)
        for i in new.tolist():
            places.setdefault(keys[i], i)
        fresh = [words[i] for i in places.values()]
        self.known.update(zip(places, range(at, at + len(places)), strict=True))
        codes[new] = [self.known[keys[i]] for i in new.tolist()]
        ids = list(map(ids_of, fresh))
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lens.sum()))])
        self.says = np.concatenate([self.says, np.fromiter(map(says, fresh), np.uint8, len(fresh)) if says else np.zeros(len(fresh), np.uint8)])
        return codes

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each stretch without the marks at its end, and of these."""
        bare = pc.utf8_rtrim(words, MARKS)
        last = pc.dictionary_encode(pc.utf8_slice_codeunits(bare, -1, None))
        plain = np.array([c.isalpha() and c <= SETTLED or c.isdigit() and c.isascii() for c in last.dictionary.to_pylist()], bool)
        at = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy())])
        cut = np.where(plain[last.indices.to_numpy()], at[:-1] + pc.binary_length(bare).to_numpy(), at[1:])
        both = np.append(np.column_stack([at[:-1], cut]).ravel(), at[-1])
        parts = pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(both.astype(np.int64)), pa.concat_arrays([words]).buffers()[2] or pa.py_buffer(b""))
        heads, marks = (pc.dictionary_encode(parts.take(pa.array(np.arange(side, 2 * len(words), 2)))) for side in (0, 1))
        strings = heads.dictionary.to_numpy(zero_copy_only=False).tolist()
        of_heads = self._codes(strings, strings, self._of_head, said_of)
        strings = marks.dictionary.to_pylist()
        of_marks = self._codes([ENDS + m for m in strings], strings, lambda m: self._of_match(m) if m else [])
        return of_heads[heads.indices.to_numpy()], of_marks[marks.indices.to_numpy()]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text, the end id last."""
        if len(self.known) > self.kept:
            self._forget()
        if not texts:
            return []
        strings = pa.array(texts, pa.large_string())
        # a space before every end of line, so that it begins a stretch
        split = pc.split_pattern(pc.replace_substring(pc.replace_substring(strings, "\n", " \n"), "\r \n", " \r\n"), " ")
        offsets = split.offsets.to_numpy()
        rest = pc.dictionary_encode(split.values)
        words, code, first = rest.dictionary, rest.indices.to_numpy(), offsets[:-1]
        heads, marks = self._parts(words)
        codes = np.column_stack([heads[code], marks[code]])
        begins = words.take(pa.array(code[first])).to_pylist()
        codes[first, 0] = self._codes([BEGINS + w for w in begins], begins, self._of_any, lambda w: said_of(w) & ODD)
        codes[first, 1] = NOTHING
        says = self.says[codes[:, 0]]
        odd = says & ODD
        follows = np.append(says[1:], 0)
        follows[offsets[1:-1] - 1] = 0  # the next text's
        odd |= (says & BLANK > 0) & (follows & (BLANK | DULL) > 0)
        whole = np.add.reduceat(odd.astype(np.int64), first) > 0
        for name in self.added:
            whole |= pc.match_substring(strings, name).to_numpy(zero_copy_only=False)
        codes = np.insert(codes.ravel(), 2 * offsets[1:], END)
        lens = self.lens[codes]
        ends = np.cumsum(lens)
        flat = self.flat[np.repeat(self.starts[codes] - (ends - lens), lens) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[2 * offsets + np.arange(len(offsets))]
        out = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.append(self._whole(texts[i]), np.uint32(END_ID))
        return out


def said_of(stretch: str) -> int:
    if stretch == "\n":
        return BLANK
    odd = ODD if not stretch or stretch[-1].isspace() else 0
    return odd | (DULL if stretch[:1].isspace() and (stretch[0] != "\n" or stretch[1].isspace()) else 0)


@lru_cache(maxsize=1)
def stretch_encoder(path: str, kept: int) -> StretchEncoder:
    """Once for each Python worker, so that tasks find what earlier ones have learned."""
    return StretchEncoder(path, kept)


def tokenised(docs: DataFrame, path: str, text_col: str = "text", source_col: str = "source", kept: int = KEPT_STRETCHES) -> DataFrame:
    """A written table: part, doc_id, queue, tokens, at (tokens of that queue before it in its part), ids (little-endian bytes)."""
    queue = F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))
    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), whole_text(text_col).alias("text"))

    def run(batches):
        mine, before = stretch_encoder(path, kept), {}
        wide = "<u2" if mine.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            for some in by_size(batch, "text"):
                ids, at = mine.encode(some.column("text").to_pylist()), []
                for q, x in zip(some.column("queue").to_pylist(), ids, strict=True):
                    at.append(before.get(q, 0))
                    before[q] = at[-1] + len(x)
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in ("part", "doc_id", "queue")), pa.array([len(x) for x in ids], pa.int64()), pa.array(at, pa.int64()), pa.array([x.astype(wide).tobytes() for x in ids], pa.binary())],
                    names=["part", "doc_id", "queue", "tokens", "at", "ids"],
                )

    return written(rows.mapInArrow(run, "part int, doc_id long, queue string, tokens long, at long, ids binary"), "token-ids")


class Tier:
    """Queues that are served together: which tokens each of their windows takes. A number for each queue; nothing else grows."""

    def __init__(self, names: list[str], totals: np.ndarray, weights: np.ndarray, window: int):
        self.names, self.totals, self.weights, self.window = names, totals, weights / weights.sum(), window
        self.number = {q: i for i, q in enumerate(names)}
        self.tokens = int(totals.sum())
        # served evenly, without whole tokens, all queues' tokens before time v are a sum of straight lines that end when queues do
        order = np.argsort(totals / self.weights, kind="stable")
        self.ends = (totals / self.weights)[order]
        self.ended = np.concatenate([[0], np.cumsum(totals[order])]).astype(float)
        self.rates = np.maximum(1 - np.concatenate([[0.0], np.cumsum(self.weights[order])]), 0.0)
        self.rates[-1] = 0.0
        self.at_ends = self.ended[:-1] + self.rates[:-1] * self.ends
        self._kept: dict[int, np.ndarray] = {}

    def due(self, queue, token):
        return (token + 0.5) / self.weights[queue]

    def _about(self, tokens: float) -> float:
        """The time by which about so many tokens have passed."""
        k = int(np.searchsorted(self.at_ends, tokens))
        if k == len(self.ends) or self.rates[k] <= 0:
            return float(self.ends[-1])
        return (tokens - self.ended[k]) / self.rates[k]

    def _before(self, v: float) -> np.ndarray:
        """Tokens of each queue that are due before time v."""
        every = np.arange(len(self.names))
        n = np.clip(np.floor(v * self.weights + 0.5), 0, self.totals).astype(np.int64)
        n += (n < self.totals) & (self.due(every, n) < v)
        return n - ((n > 0) & (self.due(every, n - 1) >= v))

    def taken(self, window: int) -> np.ndarray:
        """Tokens of each queue before a window."""
        if window not in self._kept:
            if len(self._kept) > 512:
                self._kept.clear()
            self._kept[window] = self._taken(min(window * self.window, self.tokens))
        return self._kept[window]

    def _taken(self, tokens: int) -> np.ndarray:
        if tokens in (0, self.tokens):
            return self.totals * (tokens > 0)
        slack = len(self.names) / 2 + 1
        while True:  # between times that have fewer tokens before them, and enough
            least = self._before(self._about(max(0.0, tokens - slack)))
            most = self._before(self._about(tokens + slack)) if tokens + slack < self.tokens else self.totals
            if least.sum() <= tokens <= most.sum():
                break
            slack *= 2
        n = most - least
        queue = np.repeat(np.arange(len(self.names)), n)
        token = least[queue] + np.arange(len(queue)) - np.repeat(np.cumsum(n) - n, n)
        next_ = np.lexsort((queue, self.due(queue, token)))[: tokens - int(least.sum())]
        return least + np.bincount(queue[next_], minlength=len(self.names))

    def window_of(self, queue: int, token: int) -> int:
        """The window that takes this token of the queue."""
        v = self.due(queue, token)
        k = int(np.searchsorted(self.ends, v))
        w = int(min(self.ended[k] + self.rates[k] * v, self.tokens - 1)) // self.window
        while w > 0 and self.taken(w)[queue] > token:
            w -= 1
        while self.taken(w + 1)[queue] <= token:
            w += 1
        return w

    def runs(self, name: str, start: int, tokens: int) -> Iterator[tuple[int, int, int, int]]:
        """(first, length, place in the tier's stream, window) of a document's runs of tokens, a run a window."""
        queue, done = self.number[name], 0
        while done < tokens:
            w = self.window_of(queue, start + done)
            now, then = self.taken(w), self.taken(w + 1)
            size = min(tokens - done, int(then[queue]) - (start + done))
            yield done, size, int(now.sum() + (then - now)[:queue].sum()) + start + done - int(now[queue]), w
            done += size


class Schedule:
    """The tiers one after the other: the queues with a target, then those without, these by their sizes."""

    def __init__(self, totals: dict[str, int], window: int, targets: dict[str, float] | None = None, temper: float = TEMPER):
        live = sorted(q for q, n in totals.items() if n)
        aim = {q: (totals[q] / max(totals.values())) ** temper if targets is None else float(targets.get(q, 0)) for q in live}
        self.of, self.tiers = {}, []
        at = windows = 0
        for names, weight in (([q for q in live if aim[q] > 0], aim), ([q for q in live if not aim[q] > 0], totals)):
            if names:
                tier = Tier(names, np.array([totals[q] for q in names]), np.array([float(weight[q]) for q in names]), window)
                self.of |= dict.fromkeys(names, (tier, at, windows))
                self.tiers.append(tier)
                at, windows = at + tier.tokens, windows - (-tier.tokens // window)

    def runs(self, queue: str, start: int, tokens: int) -> Iterator[tuple[int, int, int, int]]:
        """(first, length, place in the whole stream, window) of a document's runs of tokens, a run a window."""
        tier, at, windows = self.of[queue]
        for first, size, place, w in tier.runs(queue, start, tokens):
            yield first, size, at + place, windows + w


def pack(docs: DataFrame, path: str, length: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES, targets: dict[str, float] | None = None, temper: float = TEMPER, text_col: str = "text", source_col: str = "source", kept: int = KEPT_STRETCHES) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, window_id.

    kept: stretches whose ids a worker keeps; fewer take less memory and more time. targets: token share of each source; None takes the sources' sizes in tokens to the power `temper`.
    """
    ids = tokenised(docs, path, text_col, source_col, kept)
    # a row a part and queue; the running sum goes over these alone, not over documents
    by_part = ids.groupBy("part", "queue").agg(F.sum("tokens").alias("sum"))
    before = by_part.withColumn("base", F.sum("sum").over(Window.partitionBy("queue").orderBy("part")) - F.col("sum"))
    bases = written(before.select("part", "queue", "base", "sum"), "queue-bases")
    totals = {r["queue"]: r["n"] for r in bases.groupBy("queue").agg(F.sum("sum").alias("n")).collect()}  # a number a source
    sent = docs.sparkSession.sparkContext.broadcast(Schedule(totals, length * window_sequences, targets, temper))
    placed = ids.join(bases.select("part", "queue", "base"), ["part", "queue"]).select("doc_id", "queue", "tokens", (F.col("base") + F.col("at")).alias("begin"), "ids")

    def run(batches):
        schedule = sent.value
        for some in slices(batches, "ids"):
            out = []
            for doc, queue, tokens, begin, raw in zip(*(c.to_pylist() for c in some.columns), strict=True):
                x = np.frombuffer(raw, f"<u{len(raw) // tokens}").astype("<u4")
                for first, size, place, window in schedule.runs(queue, begin, tokens):
                    while size:
                        take = min(size, length - place % length)
                        out.append((doc, first, take, zlib.crc32(x[first : first + take].tobytes()), tokens, place // length, place % length, queue, window))
                        first, size, place = first + take, size - take, place + take
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 7 else pa.int64()) for i, c in enumerate(cols)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "window_id"])

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string, window_id long")
