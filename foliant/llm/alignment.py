"""Alignment of two tokenizers' tokens by the bytes that they cover, with DuckDB inside Arrow partitions.

A text with a space before it is encoded by a byte-level tokenizer (A) and a sentencepiece model (B), which
adds that space itself. Where tokens of both end at one byte, the text is cut into groups, and the two tokens
are linked. In a slice of a partition the tokens become two interval tables on one line of bytes: an ASOF join
takes each A token to the last B token that ends no later, equal ends are links, window functions over the
links make groups, and tokens come into the groups that hold them, A tokens by a range join, B tokens by another ASOF join.

Neither tokenizer has a token across a space that follows a non-space, so a text is the sum of its stretches
between such spaces, and stretches that come again in a slice are aligned once. Texts with other white space
around spaces are one stretch. A slice gives its documents' rows and one row with the counts of its pairs; Spark
sums these over all slices and takes the sums back to the slices by a join.

Defined results: texts that are null or empty, and those whose tokens' bytes are not the text's (the
sentencepiece model writes U+2581 as a space), have no tokens and so only zeros and no groups; names of special
tokens in a text are plain text; rows that repeat, or have a null id, are aligned each on their own, and each
counts; ties for a B id's best count are all best; very long texts are aligned whole; further columns don't
matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_size, whole_text
from .merge_queue import merge_table, uneven
from .packing import NOTHING, StretchEncoder

#: Bytes of text that are aligned together.
SLICE_BYTES = 5 << 19
#: Stretches that a tokenizer gets in one call.
WORDS_AT_ONCE = 8192
#: Stretches without their last marks, and their ids by the byte-level tokenizer, that a worker keeps; over this it starts anew.
KEPT = 250_000
#: Stretches of more characters are not kept, nor whole texts.
LONG = 64
_ROWS = "slice long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, links binary, pairs array<long>, counts array<long>"
_LINKS = "SELECT a.upto, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.upto >= b.upto WHERE a.upto = b.upto"
_GROUPS = "SELECT upto, coalesce(lag(upto) OVER (ORDER BY upto), 0) AS since, sum(1) OVER (ORDER BY upto) AS g FROM links"
#: Each token's group, in the tokens' order; every token lies in one. A tokens by the range that holds theirs, B tokens by the first end that isn't before theirs.
_OF_A = "SELECT CAST(g AS INTEGER) AS g FROM a JOIN groups ON a.since >= groups.since AND a.upto <= groups.upto ORDER BY a.upto"
_OF_B = "SELECT CAST(g AS INTEGER) AS g FROM b ASOF JOIN groups ON b.upto <= groups.upto ORDER BY b.upto"
#: What DuckDB may hold in a Python worker; beyond, it uses the worker's own temporary folder and clears it itself.
DUCK_MEMORY = "256MB"


class Coder:
    """One tokenizer's ids of stretches, and the bytes of each id."""

    def __init__(self, each: list[bytes], encode):
        self.encode = encode
        self.lens = np.array([len(b) for b in each], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(each), np.uint8)

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, the word of each). The library's own objects are large, so some words go at a time."""
        ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = self.encode(words[at : at + WORDS_AT_ONCE])
            n = np.fromiter(map(len, some), np.int64, len(some))
            ids.append(np.fromiter(itertools.chain.from_iterable(some), np.int64, int(n.sum())))
            sizes.append(n)
        return np.concatenate(ids), np.repeat(np.arange(len(words)), np.concatenate(sizes))

    def exact(self, ids: np.ndarray, word: np.ndarray, raw: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Whether each word's tokens spell the word's bytes."""
        size = self.lens[ids]
        ok = np.bincount(word, size, len(lens)).astype(np.int64) == lens
        ids, size = ids[ok[word]], size[ok[word]]
        ends = np.cumsum(size)
        mine = self.flat[np.repeat(self.starts[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        theirs = raw[np.repeat(ok, lens)]
        ok[np.repeat(np.arange(len(lens)), lens)[np.repeat(ok, lens)][mine != theirs]] = False
        return ok


class Spaced(StretchEncoder):
    """Ids of stretches with a space before them; names of special tokens are plain text. Stretches that come again keep their ids."""

    def _of_head(self, head: str) -> list[int]:
        spelled = self._spelled(head)
        return self._of_any(" " + head) if spelled is None else self._model_ids(self.space + spelled)

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, the word of each)."""
        if len(self.known) + len(self.matches) > self.kept:
            self._forget()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        long = [i for i, w in enumerate(words) if len(w) > LONG or " " in w]  # of those kept, none holds a space
        short = words.copy()
        for i in long:
            short[i] = ""
        codes = np.column_stack(self._parts(pa.array(short, pa.large_string())))
        codes[long] = NOTHING
        lens = self.lens[codes].ravel()
        ends = np.cumsum(lens)
        ids = self.flat[np.repeat(self.starts[codes].ravel() - (ends - lens), lens) + np.arange(ends[-1])].astype(np.int64)
        word = np.repeat(np.repeat(np.arange(len(words)), 2), lens)
        if long:
            each = [self._ids(words[i]) for i in long]
            n = list(map(len, each))
            at = np.repeat(ends[1::2][long], n)
            ids, word = np.insert(ids, at, list(itertools.chain.from_iterable(each))), np.insert(word, at, np.repeat(long, n))
        return ids, word


class SpacedCoder(Coder):
    """A byte-level tokenizer's."""

    def __init__(self, each: list[bytes], path: str):
        super().__init__(each, None)
        self.tokens = Spaced(path, KEPT).tokens


@lru_cache(maxsize=2)
def coders(a_path: str, b_path: str) -> tuple[Coder, Coder]:
    """Both tokenizers, once for each Python worker."""
    import sentencepiece
    table = merge_table(a_path)
    of_a = [table.flat[s : s + n].tobytes() for s, n in zip(table.starts.tolist(), table.lens.tolist(), strict=True)]
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in range(b.get_piece_size()) for p in (b.id_to_piece(i),)]
    return (
        SpacedCoder(of_a, a_path),
        Coder(of_b, lambda words: b.encode(words, num_threads=1)),
    )


def _duck():
    """A database of one slice; closing it gives its memory back."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"SET memory_limit = '{DUCK_MEMORY}'")
    con.execute(f"SET temp_directory = '{tempfile.gettempdir()}/duck-{os.getpid()}'")
    return con


def stretches(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different stretches; the codes of all texts' stretches; where each text's begin, and the end)."""
    odd = {i: t for i, t in enumerate(texts) if uneven(t)}  # the empty text is one, too
    split = pc.split_pattern(pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.large_string()), " ")
    coded = pc.dictionary_encode(split.values)
    words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = split.offsets.to_numpy().astype(np.int64)
    for i, t in odd.items():  # in place of the one empty stretch
        codes[at[i]] = len(words)
        words.append(t)
    return words, codes, at


def spelled_at(strings: pa.Array) -> np.ndarray:
    """Where each string begins in all of them, and the end."""
    return np.concatenate([[0], np.cumsum(pc.binary_length(strings).to_numpy(zero_copy_only=False))]).astype(np.int64)


def align(texts: list[str], a: Coder, b: Coder) -> dict:
    """n_a, n_b, n_groups, groups and links (places in pairs) of each text; pairs (A id << 32 | B id) and their counts."""
    words, codes, at = stretches(texts)
    each = [b" " + w.encode() for w in words]
    lens = np.fromiter(map(len, each), np.int64, len(each))
    raw = np.frombuffer(b"".join(each), np.uint8)
    ids_a, word_a = a.tokens(words)
    ids_b, word_b = b.tokens(words)
    good = a.exact(ids_a, word_a, raw, lens) & b.exact(ids_b, word_b, raw, lens) & (lens > 1)
    ids_a, word_a, ids_b, word_b = ids_a[good[word_a]], word_a[good[word_a]], ids_b[good[word_b]], word_b[good[word_b]]
    ends = np.cumsum(np.where(good, lens, 0))  # the good words' ends on one line of bytes

    con = _duck()
    for name, coder, ids in (("a", a, ids_a), ("b", b, ids_b)):
        upto = np.cumsum(coder.lens[ids])
        con.register(name, pa.table({"since": upto - coder.lens[ids], "upto": upto, "id": ids.astype(np.int32)}))
    con.execute(f"CREATE TEMP TABLE links AS {_LINKS}")
    con.execute(f"CREATE TEMP TABLE groups AS {_GROUPS}")
    links = con.execute("SELECT upto, a, b FROM links ORDER BY upto").fetchnumpy()
    of_a, of_b = (con.execute(sql).fetchnumpy()["g"] for sql in (_OF_A, _OF_B))
    con.close()

    # every group's A tokens, then its B tokens, each with what comes after it, end to end; a word's groups are a stretch of this
    g, side, ids = (np.empty(len(of_a) + len(of_b), t) for t in (np.int32, bool, np.int32))
    for here, there, which, own, before in ((of_a, of_b, False, ids_a, "left"), (of_b, of_a, True, ids_b, "right")):
        at_ = np.arange(len(here)) + np.searchsorted(there, here, before)
        g[at_], side[at_], ids[at_] = here, which, own
    same = np.append(g[1:] == g[:-1], False) if len(g) else np.zeros(0, bool)
    mark = np.where(same, np.where(np.append(side[1:], False) == side, 0, 1), 2).astype(np.int8)
    spelled = pc.binary_join_element_wise(pa.chunked_array([pa.array(ids)]).cast(pa.large_string()), pa.array([",", "|", ";"], pa.large_string()).take(pa.array(mark)), pa.scalar("", pa.large_string()))
    spelled = pa.concat_arrays(spelled.chunks) if spelled.num_chunks else pa.array([], pa.large_string())
    text, text_at = spelled.buffers()[2], spelled_at(spelled)
    link_word = np.searchsorted(ends, links["upto"])
    n_links = np.bincount(link_word, minlength=len(words))
    n_a, n_b = np.bincount(word_a, minlength=len(words)), np.bincount(word_b, minlength=len(words))
    word_ends = text_at[np.cumsum(n_a + n_b)].tolist()
    joined = text.to_pybytes() if text is not None else b""
    groups = [joined[s:e] for s, e in zip([0, *word_ends[:-1]], word_ends, strict=True)]
    pairs, pair_of = np.unique(links["a"].astype(np.int64) << 32 | links["b"].astype(np.int64), return_inverse=True)

    # texts from their stretches; one with a stretch that isn't good has nothing
    whole = np.logical_and.reduceat(good[codes], at[:-1]) if len(texts) else np.zeros(0, bool)
    live = np.repeat(whole, np.diff(at))
    word_links_at = np.cumsum(n_links) - n_links
    used = np.where(live, n_links[codes], 0)
    used_ends = np.cumsum(used)
    of_texts = pair_of[np.repeat(word_links_at[codes] - (used_ends - used), used) + np.arange(used_ends[-1] if len(used) else 0)].astype(np.int32)
    add = lambda x: np.add.reduceat(np.where(live, x[codes], 0), at[:-1]) if len(texts) else np.zeros(0, np.int64)
    n_groups = add(n_links)
    bounds = np.concatenate([[0], np.cumsum(n_groups)])
    each_code = codes.tolist()
    return {
        "n_a": add(n_a), "n_b": add(n_b), "n_groups": n_groups, "pairs": pairs, "counts": np.bincount(of_texts, minlength=len(pairs)),
        "groups": [b"".join(map(groups.__getitem__, each_code[s:e]))[:-1] if ok else b"" for ok, s, e in zip(whole.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)],
        "links": [of_texts[s:e].tobytes() for s, e in itertools.pairwise(bounds.tolist())],
    }


def partial(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows of documents, without sums over the corpus, and a row a slice with its pairs' counts."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))

    def aligned(number: int, ids: list, texts: list[str]):
        found, n = align(texts, *coders(a_path, b_path)), len(texts)
        sha = [hashlib.sha256(g).hexdigest() if g else "" for g in found["groups"]]
        kept = pa.array([g.decode() for g in found["groups"]] if keep_groups else [None] * n, pa.string())
        none = pa.nulls(n, pa.list_(pa.int64()))
        long = lambda x: pa.array(x, pa.int64())
        names = [c.split()[0] for c in _ROWS.split(", ")]
        yield pa.RecordBatch.from_arrays([long([number] * n), long(ids), long(found["n_a"]), long(found["n_b"]), long(found["n_groups"]), pa.array(sha), kept, pa.array(found["links"], pa.binary()), none, none], names=names)
        rest = [pa.nulls(1, t) for t in [pa.int64()] * 4 + [pa.string()] * 2 + [pa.binary()]]
        yield pa.RecordBatch.from_arrays([long([number]), *rest, *(pa.array([found[c]], pa.list_(pa.int64())) for c in ("pairs", "counts"))], names=names)

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        ids, texts, size = [], [], 0
        for batch in batches:
            for some in by_size(batch, "text", slice_bytes):
                new = some.column("text").to_pylist()
                more = sum(map(len, new))
                if texts and size + more > slice_bytes:
                    yield from aligned(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids, texts, size = ids + some.column("doc_id").to_pylist(), texts + new, size + more
        if texts:
            yield from aligned(number, ids, texts)

    return source.mapInArrow(run, _ROWS)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document; with keep_groups its groups, too."""
    scratch = Scratch(docs.sparkSession, "alignment")
    rows = scratch.written(partial(docs, a_path, b_path, id_col, text_col, keep_groups, slice_bytes), "slices")
    of_slices = rows.filter(F.col("pairs").isNotNull()).select("slice", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("pairs") - 1).alias("place"), "pairs", "counts")).alias("x"))
    of_slices = of_slices.filter(F.col("x.pairs").isNotNull()).select("slice", F.col("x.place").alias("place"), F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    b_id = (F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))).alias("b")
    sums = scratch.written(of_slices.groupBy("pair").agg(F.sum("n").alias("n")).select("pair", b_id, "n"), "sums")
    most = sums.groupBy("b").agg(F.max("n").alias("most"))
    judged = sums.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = of_slices.select("slice", "place", "pair").join(judged, "pair").select(F.col("slice").alias("of_slice"), "place", "n", "best")

    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * keep_groups

    def summed(held: pa.Table, of_pairs: pa.Table) -> pa.Table:
        place = of_pairs.column("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place], best[place] = of_pairs.column("n").to_numpy(), of_pairs.column("best").to_numpy(zero_copy_only=False)
        links = [np.frombuffer(x, np.int32) for x in held.column("links").to_pylist()]
        new = {"n_links": [len(x) for x in links], "n_best": [int(best[x].sum()) for x in links], "count_sum": [int(n[x].sum()) for x in links]}
        return pa.table([pa.array(new[c], pa.int64()) if c in new else held.column(c) for c in columns], names=columns)

    kinds = ", ".join(f"{c} string" if c.startswith("groups") else f"{c} long" for c in columns)
    documents = rows.filter(F.col("pairs").isNull()).select("slice", *(c for c in columns if c not in ("n_links", "n_best", "count_sum")), "links")
    return documents.groupBy("slice").cogroup(back.groupBy("of_slice")).applyInArrow(summed, kinds)
