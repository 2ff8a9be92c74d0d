"""Prints of texts (bottom-k sketches of word runs), and duplicates by them.

A print is the smallest hashes of a text's runs of words: FNV-1a of each word's UTF-16 units, folded again
over the run, and mixed. Texts come in Arrow batches; each different word of a batch is hashed once, and
the runs of all its texts together, in arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import components, written

RUN, SIZE, LEAST_WORDS = 5, 16, 200
SAME_TEXT, OTHER_TEXT = 0.375, 0.12
#: A hash that more texts share is a common phrase, not a sign of a copy.
MOST_IN_BLOCK = 40
#: Bytes of text in arrays at a time.
STRETCH = 4 << 20

_START, _PRIME, _LOW = np.uint64(0x811C9DC5), np.uint64(0x01000193), np.uint64(0xFFFFFFFF)


def word_hashes(words: list[str]) -> np.ndarray:
    """FNV-1a of each word, a step for the n-th unit of all words at once."""
    units = [np.frombuffer(w.encode("utf-16-le", "surrogatepass"), np.uint16) for w in words]
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    flat = np.concatenate(units) if units else np.zeros(0, np.uint16)
    first = np.cumsum(sizes) - sizes
    h = np.full(len(words), _START)
    on = np.arange(len(words))
    for n in range(int(sizes.max(initial=0))):
        on = on[sizes[on] > n]
        h[on] = ((h[on] ^ flat[first[on] + n]) * _PRIME) & _LOW
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = ((h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & _LOW
    h = ((h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & _LOW
    return h ^ (h >> np.uint64(16))


def prints_of(texts: pa.Array, run: int, size: int, least_words: int) -> list[np.ndarray | None]:
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+")
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    text = pc.list_parent_indices(lists).to_numpy()
    real = np.array([w != "" for w in words], bool)[code] if len(code) else np.zeros(0, bool)
    text, h = text[real], word_hashes(words)[code[real]] if len(code) else np.zeros(0, np.uint64)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    n = max(0, len(h) - run + 1)
    folded = np.full(n, _START)
    for i in range(run):
        folded = ((folded ^ h[i : i + n]) * _PRIME) & _LOW
    folded = mixed(folded)
    out: list[np.ndarray | None] = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = folded[a : max(a, b - run + 1)]
        if b - a < max(least_words, run):
            out.append(None)
            continue
        few = np.unique(np.partition(own, 4 * size)[: 4 * size]) if len(own) > 4 * size else np.unique(own)
        # repeats may leave too few different ones among the smallest
        out.append((few if len(few) >= size or len(own) <= 4 * size else np.unique(own))[:size])
    return out


def text_prints(docs: DataFrame, id_col: str, text_col: str, run: int = RUN, size: int = SIZE, least_words: int = LEAST_WORDS) -> DataFrame:
    """id, print array<long>: the smallest hashes of a text's runs of words, in order; no row for a short text."""

    def make(batches):
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STRETCH)))
                some = batch.slice(at, end - at)
                at = end
                found = prints_of(some.column(1), run, size, least_words)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([x if x is None else x.astype(np.int64) for x in found], pa.list_(pa.int64()))], names=[id_col, "print"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(make, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, print array<long>").filter(F.col("print").isNotNull())


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Of the smallest hashes of both together, the share that both have."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    return F.size(F.array_intersect(F.array_intersect(least, a), b)) / F.size(least)


def print_pairs(prints: DataFrame, id_col: str, most_in_block: int = MOST_IN_BLOCK) -> DataFrame:
    """a, b, likeness (a < b) of texts that share a hash which no more than most_in_block texts have; the cap is part of the operator."""
    prints = written(prints)  # read three times, and dear to make
    blocks = prints.select(id_col, F.explode("print").alias("h"))
    usual = blocks.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n").between(2, most_in_block)).select("h")
    kept = blocks.join(usual, "h")
    pairs = kept.select("h", F.col(id_col).alias("a")).join(kept.select("h", F.col(id_col).alias("b")), "h").filter("a < b").select("a", "b").distinct()
    x = prints.select(F.col(id_col).alias("a"), F.col("print").alias("pa"))
    y = prints.select(F.col(id_col).alias("b"), F.col("print").alias("pb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", likeness(F.col("pa"), F.col("pb")).alias("likeness"))


def candidate_pairs(prints: DataFrame, titles: DataFrame, id_col: str, key_col: str, most_in_block: int = MOST_IN_BLOCK) -> DataFrame:
    """a, b (a < b) of texts that may be the same book: they share a title's key or a hash of their prints, in a block of 2 to most_in_block; the cap is part of the operator."""
    by_hash = prints.select(id_col, F.explode("print").alias("h")).select(id_col, F.concat(F.lit("h"), F.col("h").cast("string")).alias("k"))
    by_title = titles.filter(F.col(key_col) != "").select(id_col, F.concat(F.lit("t"), F.col(key_col)).alias("k"))
    blocks = written(by_hash.union(by_title))
    usual = blocks.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n").between(2, most_in_block)).select("k")
    kept = blocks.join(usual, "k")
    return kept.select("k", F.col(id_col).alias("a")).join(kept.select("k", F.col(id_col).alias("b")), "k").filter("a < b").select("a", "b").distinct()


def why_same(likeness_: Column, same_title: Column, same_author: Column) -> Column:
    """Null where two books are not the same; likeness may be null."""
    return F.when(likeness_ >= SAME_TEXT, "text").when(likeness_ < OTHER_TEXT, F.lit(None).cast("string")).when(same_title & same_author, "title")


def duplicate_groups(prints: DataFrame, id_col: str) -> DataFrame:
    """id, group: texts that are the same directly or through others; group is the smallest id."""
    links = print_pairs(prints, id_col).filter(F.col("likeness") >= SAME_TEXT).select("a", "b")
    return components(links).select(F.col("node").alias(id_col), F.col("label").alias("group"))
