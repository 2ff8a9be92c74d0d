"""Ranked lexical search by Fagin's threshold algorithm.

Documents lie in shards. A shard holds a forward index (each document's terms and their parts of a
score) and, for every term, a list of its documents with the largest part first. A question reads the
lists of its terms in turns, some entries of each a turn; every document met for the first time is
scored whole from the forward index; and it stops when the threshold, the sum of what the lists'
last entries could still add up to, is strictly below the k-th score. What was not met is then below
the k-th score itself, so ties are never lost. The shards' best are merged.

A term's part in a document is (10^9 tf) div (1000 tf + 20 m), m = 50 + (50 n N) div L, for tf
occurrences among n terms, N documents with a term, and L terms in all; its weight is
floor(1000 ln((2N + 2) / (2 df + 1))). A score sums weight times part over the question's terms.

The corpus is read once. Terms that no question can hold are left out of the index by a bitmap of
fixed size; what it lets through by chance is harmless.

Defined results: a null or empty text has no terms, and such a document neither counts nor is found;
a question without terms has no rows; terms count once a question; rows with the same item_id are one
question; every row of documents is a document of its own, also with an id that comes again; null ids
come last among equal scores, a null item_id asks nothing; further columns don't matter; very long
texts are read whole; empty tables give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, whole_text

#: Entries of a shard's forward index (a document's different terms that are asked for), and of a block of questions.
SHARD_ENTRIES, BLOCK_TERMS = 3_000_000, 500_000
#: Bits of the map of terms that questions hold.
MAP_BITS = 1 << 20
#: Entries of each list in the first turn; every turn reads twice as many.
FIRST_TURN = 64

_SEPARATORS = {*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
#: By byte: A-Z to lower case, what separates terms to a space, all else as it is.
_FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if b in _SEPARATORS else b for b in range(256))


def term_bit(term: str) -> int:
    return zlib.crc32(term.encode()) % MAP_BITS


def folded(texts: pa.Array) -> pa.Array:
    """The texts with lower-cased A-Z, and spaces for what separates terms; all in bytes, as the rest of UTF-8 belongs to terms."""
    _, at, data = texts.buffers()
    ends = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(data)[ends[0] : ends[-1]].tobytes() if data is not None else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(raw.translate(_FOLDED)))


def term_counts(texts: pa.Array, wanted=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(terms of each text with repeats; row, code, count of each wanted different term of a row; the terms by code)."""
    words = pc.ascii_split_whitespace(folded(texts))
    coded = pc.dictionary_encode(words.values)
    codes, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    lens = np.diff(words.offsets.to_numpy())
    row = np.repeat(np.arange(len(texts)), lens)
    real = pc.greater(pc.binary_length(terms), 0).to_numpy(zero_copy_only=False)
    sizes = np.bincount(row[real[codes]], minlength=len(texts))
    if wanted is not None:
        real = real & np.fromiter(map(wanted, terms.to_pylist()), bool, len(terms))
    keep = real[codes]
    key, count = np.unique(row[keep] * max(1, len(terms)) + codes[keep], return_counts=True)
    return sizes, key // max(1, len(terms)), key % max(1, len(terms)), count, terms


def _lists(row: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term: the different terms of each question."""
    source = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), whole_text(text_col).alias("text"))

    def run(batches):
        for batch in slices(batches, "text"):
            _, row, code, _, terms = term_counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(row)), terms.take(pa.array(code))], names=["item_id", "term"])

    return source.mapInArrow(run, "item_id long, term string").distinct()


def forward_index(docs: DataFrame, bits: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """place, doc_id, n, terms, tfs of every document with a term; only terms whose bit is set are in the arrays."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    packed = np.packbits(bits).tobytes()  # MAP_BITS / 8 bytes

    def run(batches):
        here = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool).tolist()
        part, done = TaskContext.get().partitionId() << 33, 0
        for batch in slices(batches, "text", 4 << 20):
            sizes, row, code, count, terms = term_counts(batch.column("text"), lambda t: here[term_bit(t)])
            n = batch.num_rows
            cols = [pa.array(part + done + np.arange(n)), batch.column("doc_id"), pa.array(sizes.astype(np.int64)), _lists(row, n, terms.take(pa.array(code))), _lists(row, n, pa.array(count.astype(np.int32)))]
            done += n
            yield pa.RecordBatch.from_arrays(cols, names=["place", "doc_id", "n", "terms", "tfs"]).filter(pa.array(sizes > 0))

    return source.mapInArrow(run, "place long, doc_id long, n long, terms array<string>, tfs array<int>")


class Shard:
    """Forward index and impact-sorted lists of some documents."""

    def __init__(self, ids: pa.Array, n: np.ndarray, terms: pa.ListArray, tfs: np.ndarray, documents: int, all_terms: int):
        coded = pc.dictionary_encode(terms.flatten())
        self.codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        self.code_of = {t: i for i, t in enumerate(names)}
        self.lens = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        row = np.repeat(np.arange(len(n)), self.lens)
        tf, m = tfs.astype(np.int64), 50 + (50 * n * documents) // max(1, all_terms)
        self.parts = (1_000_000_000 * tf) // (1000 * tf + 20 * m[row])
        # a part is a million at most: one number sorts by term, then by part, the largest first
        order = np.argsort((self.codes.astype(np.int64) << 20) + (1_000_000 - self.parts), kind="stable")
        self.list_rows, self.list_parts = row[order], self.parts[order]
        self.list_starts = np.searchsorted(self.codes[order], np.arange(len(names) + 1))
        # places of documents among equal scores: by id, null ids last
        self.by_id = np.empty(len(n), np.int64)
        self.by_id[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(n))

    def scores(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole scores of documents, from the forward index."""
        lens = self.lens[rows]
        some = lens > 0
        ends = np.cumsum(lens[some])
        if not len(ends):
            return np.zeros(len(rows), np.int64)
        at = np.repeat(self.starts[rows][some] - (ends - lens[some]), lens[some]) + np.arange(ends[-1])
        out = np.zeros(len(rows), np.int64)
        out[some] = np.add.reduceat(weight[self.codes[at]] * self.parts[at], ends - lens[some])
        return out

    def best(self, weights: dict[str, int], k: int, first_turn: int = FIRST_TURN) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best documents with a score above 0, best first."""
        known = [(self.code_of[t], w) for t, w in weights.items() if w > 0 and t in self.code_of]
        weight = np.zeros(len(self.code_of), np.int64)
        lists = []
        for code, w in known:
            weight[code] = w
            a, b = self.list_starts[code], self.list_starts[code + 1]
            lists.append((self.list_rows[a:b], self.list_parts[a:b], w))
        met = np.zeros(len(self.lens), bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, turn = 0, first_turn
        while lists:
            fresh = np.unique(np.concatenate([r[depth : depth + turn] for r, _, _ in lists]))
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            depth, turn = depth + turn, turn * 2
            rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, self.scores(fresh, weight)])
            if len(rows) > k:  # those that can't be among the k best go before the rest is sorted
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                rows, scores = rows[scores >= least], scores[scores >= least]
            order = np.lexsort((self.by_id[rows], -scores))[:k]
            rows, scores = rows[order], scores[order]
            lists = [x for x in lists if len(x[0]) > depth]  # an ended list adds nothing to what was not met
            threshold = sum(int(parts[depth - 1]) * w for _, parts, w in lists)
            if len(rows) == k and threshold < scores[-1]:
                break
        return rows[scores > 0], scores[scores > 0]


def search(docs: DataFrame, items: DataFrame, k: int = 50, shard_entries: int = SHARD_ENTRIES, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank from 1, doc_id, score of the k best documents of each question.

    docs: doc_id, text; items: item_id, text. Blocks of questions meet shards of documents in a grid, so that
    neither side's size is a task's; with questions of one block, as for most tables, documents are shuffled once.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "threshold")
    asked = scratch.written(item_terms(items), "asked")
    bits = np.zeros(MAP_BITS, bool)
    bits[[r["bit"] for r in asked.select((F.crc32(F.col("term").cast("binary")) % MAP_BITS).cast("int").alias("bit")).distinct().collect()]] = True  # MAP_BITS rows at most
    index = scratch.written(forward_index(docs, bits), "forward")
    size = index.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("entries")).first()
    documents, all_terms = size["documents"], size["terms"]

    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = scratch.written(asked.join(df, "term").select("item_id", "term", weight.alias("w")).filter("w > 0"), "weighed")
    shards = max(1, -(-size["entries"] // shard_entries))
    blocks = max(1, -(-weighed.count() // block_terms))

    dealt = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    rows = index.withColumn("shard", dealt("place", shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    of_items = weighed.groupBy("item_id").agg(F.collect_list("term").alias("asked"), F.collect_list("w").alias("weights"))
    of_items = of_items.withColumn("block", dealt("item_id", blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(shards * blocks, 20_000))

    def answers(questions: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if questions.num_rows and held.num_rows:
            held = held.combine_chunks()
            ids = held.column("doc_id").combine_chunks()
            terms = held.column("terms").combine_chunks()
            shard = Shard(ids, held.column("n").to_numpy(), terms, held.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False), documents, all_terms)
            for item, names, weights in zip(*(questions.column(c).to_pylist() for c in ("item_id", "asked", "weights")), strict=True):
                found.append((item, *shard.best(dict(zip(names, weights, strict=True)), k)))
        rows_ = np.concatenate([np.zeros(0, np.int64), *(r for _, r, _ in found)])
        items_ = np.repeat([i for i, _, _ in found], [len(r) for _, r, _ in found]) if found else np.zeros(0)
        doc = ids.take(pa.array(rows_)) if found else pa.array([], pa.int64())
        scores = np.concatenate([np.zeros(0, np.int64), *(s for _, _, s in found)])
        return pa.table([pa.array(items_.astype(np.int64)), doc, pa.array(scores)], names=["item_id", "doc_id", "score"])

    cell = F.concat_ws("-", "shard", "block").alias("cell")
    left = of_items.select(cell, "item_id", "asked", "weights").repartition(parts, "cell").groupBy("cell")
    right = rows.select(cell, "doc_id", "n", "terms", "tfs").repartition(parts, "cell").groupBy("cell")
    found = left.cogroup(right).applyInArrow(answers, "item_id long, doc_id long, score long")
    # k rows a question from each shard; each task keeps k of them before the shuffle
    best = scratch.written(found, "found")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    for what in ("asked", "forward", "weighed"):
        scratch.drop(what)
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
