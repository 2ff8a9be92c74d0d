"""Removal of repeated strings of bytes by suffix order, from merged Burrows-Wheeler transforms.

Every start of a `length`-byte string is owned by an anchor: the least of the hashes of the short
strings within it. Equal strings have equal anchors, so an anchor's strings can be judged apart
from all others. Starts that follow each other with the same anchor make a block.

1. Blocks whose anchor occurs once hold nothing repeated. Of equal blocks, all but the first
   are repeated whole; one is kept to stand for them.
2. What is left are anchors with several different blocks, where passages begin, end or differ
   (or whose block repeats itself). Their blocks are cut into pieces of a few neighbouring starts at
   fixed distances from the anchor, and pieces are grouped by the bytes that all strings of a piece
   have, as equal strings have these too; a piece alone in its group is done with.
3. A group's pieces are dealt into shards; each shard has its rotations sorted once and becomes a
   Burrows-Wheeler transform. The shards are merged by refining their interleave: a pass sorts the
   interleave stably by the symbols (two bytes) before each suffix, so that after t passes it is
   right for 2 t bytes. Where neighbours part at a pass is their common prefix; intervals whose
   common prefix reaches `length` are the repeated strings, and all but the first of an interval
   are repeated. No suffix is compared or sorted again in a merge.
   The strings of an anchor with very many different blocks are dealt one by one, by their own
   hashes, each but once from a task, so no group grows with the input.

Defined results: a null text counts as empty; texts under `length` bytes lose nothing; a null
doc_id is later than all others; rows that share a doc_id are one document when asking what is
earlier; repeated rows keep their own rows; further columns are carried along by `remove`; an
empty table gives no rows. Equality of blocks is that of two 64-bit hashes together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, by_size, whole_text, written

LENGTH = 100
#: Bytes of the short strings whose hashes are anchors. Longer: fewer chance repeats, but more blocks.
ANCHOR = 24
#: Starts of a block at most; runs of one anchor over this (text that repeats itself) are cut.
MOST_STARTS = 128
#: Different blocks of an anchor up to which their strings may go to one task together.
GROUP_BLOCKS = 16_384
#: Neighbouring starts whose strings go to a task in one piece, dealt by the bytes that all of them have.
PIECE_STARTS = 16
#: Bytes of blocks that are merged at once, in so many shards.
MERGE_BYTES, SHARDS = 1 << 15, 2
#: Bytes of text in arrays at a time.
STRETCH = 1 << 20
LAST = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared ... n of them, modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        x = np.full(max(n, STRETCH + 4096), base, np.uint64)
        x[0] = 1
        _POWERS[base] = np.multiply.accumulate(x)
    return _POWERS[base][:n]


def _ragged(lens: np.ndarray) -> np.ndarray:
    """0 .. lens[0]-1, 0 .. lens[1]-1, ..."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens, lens)


def _least_of(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours."""
    m = 1
    while 2 * m <= w:
        h = np.minimum(h[:-m], h[m:])
        m *= 2
    return np.minimum(h[: len(h) - (w - m)], h[w - m :]) if w > m else h


def _stretch_blocks(data: np.ndarray, lens: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, start in it, starts, anchor hash, block hash, anchor_at, inner) of the blocks of texts that lie end to end in data.

    anchor_at: the anchor's place from the block's start. inner: the anchor's hash occurs in the block more than once, so the block may repeat strings of its own.
    """
    begins = np.cumsum(lens) - lens
    counts = np.maximum(lens - length + 1, 0)
    if not counts.sum():
        return (*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)), np.zeros(0, np.int64), np.zeros(0, bool))
    n = len(data)
    back = _powers(pow(_BASE, -1, 2**64), n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, n))])
    short, width = _mixed((sums[anchor:] - sums[:-anchor]) * back[: n - anchor + 1]), length - anchor + 1
    least = _least_of(short, width)
    owner = np.repeat(np.arange(len(lens)), counts)
    starts = np.repeat(begins, counts) + _ragged(counts)
    of = least[starts]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (owner[1:] != owner[:-1])]))
    runs = np.diff(np.append(new, len(of)))
    pieces = -(-runs // MOST_STARTS)
    at = np.repeat(new, pieces) + MOST_STARTS * _ragged(pieces)
    size = np.minimum(np.repeat(new + runs, pieces) - at, MOST_STARTS)
    first = starts[at]
    block = _mixed((sums[first + size + length - 1] - sums[first]) * back[first] + size.astype(np.uint64))
    # short strings that are the least of some `width` neighbours, and those of them that the next one equals
    rim = np.full(width - 1, ~np.uint64(0))
    least_of_some = np.flatnonzero(~_least_of(np.concatenate([rim, ~least, rim]), width) == short)
    equal = (short[least_of_some[1:]] == short[least_of_some[:-1]]) & (np.diff(least_of_some) <= width)
    inner = np.zeros(len(first), bool)
    for place in (least_of_some[:-1][equal], least_of_some[1:][equal] - width + 1):
        inner[np.maximum(np.searchsorted(first, place, "right") - 1, 0)] = True
    found = np.searchsorted(least_of_some, first + np.minimum(size, width) - 1)
    while (other := np.flatnonzero(short[least_of_some[found]] != of[at])).size:
        found[other] += 1
    return owner[at], first - begins[owner[at]], size, of[at], block, least_of_some[found] - first, inner


def blocks(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, start, starts, anchor, block, anchor_at, inner, again) of all blocks; again: the text has had this block before."""
    found, some, size = [], [], 0

    def flush():
        if some:
            lens = np.array([len(x) for _, x in some])
            t, *rest = _stretch_blocks(np.frombuffer(b"".join(x for _, x in some), np.uint8), lens, length, anchor)
            found.append((np.array([i for i, _ in some])[t] if len(t) else t, *rest))
            some.clear()

    for i, x in enumerate(texts):
        if len(x) > 2 * STRETCH:  # stretches that overlap, so that each start lies in one of them
            for at in range(0, len(x) - length + 1, STRETCH):
                part = np.frombuffer(x[at : at + STRETCH + length - 1], np.uint8)
                t, start, *rest = _stretch_blocks(part, np.array([len(part)]), length, anchor)
                found.append((t + i, start + at, *rest))
            continue
        some.append((i, x))
        size += len(x)
        if size >= STRETCH:
            flush()
            size = 0
    flush()
    if not found:
        found = [_stretch_blocks(np.zeros(0, np.uint8), np.zeros(0, np.int64), length, anchor)]
    text, start, size, of, block, anchor_at, inner = (np.concatenate(c) for c in zip(*found, strict=True))
    key = _mixed(of + _mixed(block + text.astype(np.uint64) * np.uint64(_BASE)))
    order = np.argsort(key, kind="stable")  # blocks of one text come in the order of their starts
    a, b = order[1:], order[:-1]
    again = np.zeros(len(text), bool)
    again[a] = (key[a] == key[b]) & (of[a] == of[b]) & (block[a] == block[b]) & (text[a] == text[b])
    return text, start, size, of, block, anchor_at, inner, again


def sorted_rotations(data: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places of data in the order of the 128 bytes from there on, each string (from 64 bytes on) read round and round."""
    string = np.repeat(np.arange(len(lens)), lens)
    offset = _ragged(lens)

    def further(k: int) -> np.ndarray:
        o = offset + k
        return begin[string] + np.where(o >= lens[string], o - lens[string], o)

    rank = data.astype(np.int64)
    for k in (1, 2, 4):
        rank = (rank << (8 * k)) | rank[further(k)] if k < 4 else (rank.astype(np.uint64) << np.uint64(32)) | rank[further(4)].astype(np.uint64)
    order = np.argsort(rank)
    k = 8
    while True:
        x = rank[order]
        dense = np.empty(len(data), np.int64)
        dense[order] = np.cumsum(np.concatenate([[0], x[1:] != x[:-1]]))
        if k >= 128 or len(x) and dense[order[-1]] == len(data) - 1:
            return order
        rank = dense * len(data) + dense[further(k)]
        order = np.argsort(rank)
        k *= 2


def merged_intervals(strings: list[bytes], length: int = LENGTH, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, interval, common prefix with the one before) of all rotations in merged order, by `length` bytes.

    Rotations of one interval have the same first `length` bytes. The common prefix is in bytes, rounded down
    to whole symbols of two. `length` is even; every string has that many bytes, and 64, at least.
    """
    if length % 2:
        raise ValueError("length must be even")
    lens = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    begin = np.cumsum(lens) - lens
    string, offset = np.repeat(np.arange(len(lens)), lens), _ragged(lens)
    two_back = np.where(offset >= 2, offset - 2, offset - 2 + lens[string]) + begin[string]
    one_back = np.where(offset >= 1, offset - 1, offset - 1 + lens[string]) + begin[string]
    symbol = data[two_back].astype(np.uint16) << 8 | data[one_back]
    order, sizes = [], []
    for s in range(min(shards, len(strings))):
        mine = np.flatnonzero(np.arange(len(lens)) % shards == s)
        own = np.repeat(begin[mine], lens[mine]) + _ragged(lens[mine])
        order.append(own[sorted_rotations(data[own], np.cumsum(lens[mine]) - lens[mine], lens[mine])])
        sizes.append(len(own))
    places = np.concatenate(order)
    transform = symbol[places]  # the shards' transforms, one after the other
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint8), sizes)
    interval = np.zeros(len(data), np.int32)
    common = np.full(len(data), length, np.int16)
    common[0] = 0
    by_shard = np.arange(len(data))
    for t in range(length // 2):
        symbols = np.empty(len(data), np.uint16)
        symbols[by_shard] = transform
        step = np.argsort(symbols, kind="stable")
        shard, before, symbols = shard[step], interval[step], symbols[step]
        parts = (symbols[1:] != symbols[:-1]) | (before[1:] != before[:-1])
        # they agree in 2 t bytes and part within the next two
        fresh = np.flatnonzero(parts & (common[1:] == length))
        common[fresh + 1] = 2 * t
        interval[0] = 0
        np.cumsum(parts, out=interval[1:])
        by_shard = np.concatenate([np.flatnonzero(shard == s) for s in range(len(sizes))])
        if not len(fresh) and t:
            break  # nothing parts any more, so nothing will
    at = np.empty(len(data), np.int64)
    at[by_shard] = places
    return string[at], offset[at], interval, common


def repeated_starts(strings: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every `length`-byte string that is also at an earlier (doc, start) of these."""
    string, offset, interval, _ = merged_intervals(strings, length)
    lens = np.array([len(s) for s in strings])
    whole = offset <= lens[string] - length
    string, offset, interval = string[whole], offset[whole], interval[whole]
    several = np.bincount(interval)[interval] > 1 if len(interval) else np.zeros(0, bool)
    string, offset, interval = string[several], offset[several], interval[several]
    doc, place = docs[string], starts[string] + offset
    order = np.lexsort((place, doc, interval))
    string, offset, interval, doc, place = (x[order] for x in (string, offset, interval, doc, place))
    first = np.concatenate([[True], interval[1:] != interval[:-1]]) if len(interval) else np.zeros(0, bool)
    leader = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0)) if len(first) else np.zeros(0, np.int64)
    later = (doc != doc[leader]) | (place != place[leader])
    return string[later], offset[later]


def _rows(docs: DataFrame, id_col: str, text_col: str):
    text = whole_text(text_col)
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("print"), text.alias("text")


def block_table(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """anchor, block, doc, print, start, starts, anchor_at, inner, again of all blocks."""

    def run(batches):
        for batch in batches:
            for some in by_size(batch, "text", STRETCH):
                text, start, starts, of, block, anchor_at, inner, again = blocks([x.encode() for x in some.column("text").to_pylist()], length, anchor)
                doc, print_ = (some.column(c).to_numpy()[text] for c in ("doc", "print"))
                cols = (of.view(np.int64), block.view(np.int64), doc, print_, start.astype(np.int32), starts.astype(np.int16), anchor_at.astype(np.int16), inner, again)
                yield from pa.Table.from_arrays([pa.array(c) for c in cols], names=["anchor", "block", "doc", "print", "start", "starts", "anchor_at", "inner", "again"]).to_batches(max_chunksize=50_000)

    return docs.select(*_rows(docs, id_col, text_col)).mapInArrow(run, "anchor long, block long, doc long, print long, start int, starts short, anchor_at short, inner boolean, again boolean")


def _merge(rows: DataFrame, length: int) -> DataFrame:
    """doc, print, start, starts of repeated runs of starts, from rows(key, doc, print, start, bytes, inner) in which equal strings share a key.

    inner: the bytes may repeat strings of their own, so they matter also when alone.
    """

    def judged(rows: list[tuple]):
        strings = [r[4] for r in rows]
        doc, print_, start = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        string, offset = repeated_starts(strings, doc, start, length)
        order = np.lexsort((offset, string))
        string, offset = string[order], offset[order]
        new = np.flatnonzero(np.concatenate([[True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)])) if len(string) else np.zeros(0, np.int64)
        runs = np.diff(np.append(new, len(string)))
        s = string[new]
        return pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(print_[s]), pa.array((start[s] + offset[new]).astype(np.int32)), pa.array(runs.astype(np.int16))], names=["doc", "print", "start", "starts"])

    def different(group: list[tuple], repeated: list[tuple]) -> list[tuple]:
        """The group's different pieces, the first of each, if they have to be merged; of equal ones the later go to repeated."""
        first: dict[bytes, tuple] = {}
        for row in group:
            held = first.setdefault(row[4], row)
            if held is not row and held[1:4:2] != row[1:4:2]:
                row, later = (row, held) if row[1:4:2] < held[1:4:2] else (held, row)
                first[row[4]] = row
                repeated.append((later[1], later[2], later[3], len(later[4]) - length + 1))
        return list(first.values()) if len(first) > 1 or group[0][5] else []

    def table_of(runs: list[tuple]):
        cols = list(zip(*runs, strict=True)) if runs else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int16()), strict=True)], names=["doc", "print", "start", "starts"])

    def run(batches):
        ready: list[tuple] = []  # pieces of whole groups
        group: list[tuple] = []
        repeated: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[0] != group[0][0]:
                    if len(group) > 1 or group[0][5]:
                        some = different(group, repeated)
                        ready += some
                        size += sum(len(r[4]) for r in some)
                    group = []
                    if size >= MERGE_BYTES:
                        yield judged(ready)
                        ready, size = [], 0
                group.append(row)
            yield table_of(repeated)
            repeated.clear()
        if group and (len(group) > 1 or group[0][5]):
            ready += different(group, repeated)
            yield table_of(repeated)
        if ready:
            yield judged(ready)

    return rows.select("key", "doc", "print", "start", "bytes", "inner").mapInArrow(run, "doc long, print long, start int, starts short")


def pieces_of(raw: bytes, place: dict, group_blocks: int, length: int):
    """(key, start, bytes) of a block's pieces; equal strings of blocks of one anchor get equal keys."""
    start, end, anchor = place["start"], place["start"] + place["starts"], place["anchor"]
    if place["blocks"] > group_blocks:
        for at in range(start, end):
            yield _key(anchor, 0, raw[at : at + length]), at, raw[at : at + length]
    elif place["inner"]:  # the anchor isn't one place, so pieces can't be laid out from it
        yield anchor, start, raw[start : end + length - 1]
    else:
        q, core = start + place["anchor_at"], length - PIECE_STARTS + 1
        for j in range((q - end + 1) // PIECE_STARTS, (q - start) // PIECE_STARTS + 1):
            last = q - PIECE_STARTS * j  # strings that start at last and up to PIECE_STARTS - 1 before
            first = max(start, last - PIECE_STARTS + 1)
            yield _key(anchor, j + 1, raw[last : last + core]), first, raw[first : min(last, end - 1) + length]


def _key(anchor: int, kind: int, shared: bytes) -> int:
    return xxhash.xxh3_64_intdigest(shared, seed=(anchor + kind) % 2**64) - (1 << 63)


def repeated_runs(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group_blocks: int = GROUP_BLOCKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, print, start, starts: runs of starts whose strings are also earlier, a written table. print is the text's hash."""
    scratch = Scratch(docs.sparkSession, "repeats")
    every = scratch.written(block_table(docs, length, anchor, id_col, text_col), "blocks")
    several = every.groupBy("anchor").agg(F.count("*").alias("n"), F.max("inner").alias("inner")).filter((F.col("n") > 1) | F.col("inner")).select("anchor")
    shared = scratch.written(every.join(several, "anchor"), "shared")
    scratch.drop("blocks")
    own = shared.filter("again").select("doc", "print", "start", "starts")
    once = shared.filter("not again").drop("again", "inner")
    different = scratch.written(shared.filter("not again").groupBy("anchor", "block").agg(F.min("doc").alias("least"), F.max("inner").alias("inner")), "different-blocks")
    copies = once.join(different.drop("inner"), ["anchor", "block"]).filter(F.col("doc") > F.col("least")).select("doc", "print", "start", "starts")
    # anchors with several different blocks, or one that may repeat itself: each block's first occurrence
    unlike = different.groupBy("anchor").agg(F.count("*").alias("blocks"), F.max("inner").alias("inner")).filter((F.col("blocks") > 1) | F.col("inner"))
    first = once.join(different.drop("inner").join(unlike, "anchor"), ["anchor", "block"]).filter(F.col("doc") == F.col("least"))
    wanted = first.groupBy("doc", "print").agg(F.collect_set(F.struct("anchor", "blocks", "inner", "start", "starts", "anchor_at")).alias("places"))  # a text's own blocks
    texts = docs.select(*_rows(docs, id_col, text_col)).join(wanted, ["doc", "print"])

    def table_of(rows: list[tuple]):
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "doc", "print", "start", "bytes", "inner", "later"]).to_batches(max_chunksize=20_000)

    def cut(batches):
        # of the strings dealt one by one, the earliest that the task has seen; the others are known to be repeated
        earliest: dict[int, tuple] = {}
        for batch in batches:
            for some in by_size(batch, "text", STRETCH):
                out = []
                for doc, print_, text, places in zip(*(some.column(c).to_pylist() for c in ("doc", "print", "text", "places")), strict=True):
                    raw = text.encode()
                    for p in places:
                        for key, at, piece in pieces_of(raw, p, group_blocks, length):
                            row = (key, doc, print_, at, piece, p["inner"] and p["blocks"] <= group_blocks, False)
                            if p["blocks"] > group_blocks:
                                held = earliest.get(key)
                                if held is not None and held[4] == piece:
                                    if held[1:4:2] == row[1:4:2]:
                                        continue
                                    row, later = (row, held) if row[1:4:2] < held[1:4:2] else (held, row)
                                    earliest[key] = row
                                    out.append((*later[:4], b"", False, True))
                                    continue
                                if held is None:
                                    earliest[key] = row
                                    continue
                            out.append(row)
                yield from table_of(out)
        yield from table_of(list(earliest.values()))

    pieces = texts.select("doc", "print", "text", "places").mapInArrow(cut, "key long, doc long, print long, start int, bytes binary, inner boolean, later boolean")
    pieces = scratch.written(pieces, "pieces")
    known = pieces.filter("later").select("doc", "print", "start", F.lit(1).cast("short").alias("starts"))
    seams = _merge(pieces.filter("not later").drop("later").repartition("key").sortWithinPartitions("key"), length)
    runs = written(own.union(copies).union(known).union(seams), "repeated-runs")
    scratch.clear()
    return runs


def spans_of(starts: np.ndarray, sizes: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes, [from, to), that the strings at these runs of starts cover."""
    out: list[list[int]] = []
    for a, n in sorted(zip(starts.tolist(), sizes.tolist(), strict=True)):
        end = a + n + length - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([a, end])
    return [(a, b) for a, b in out]


def remove(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group_blocks: int = GROUP_BLOCKS, id_col: str = "doc_id", text_col: str = "text", keep: str | None = "bytes") -> DataFrame:
    """docs without the text, plus n_bytes long, n_removed long, n_spans long, kept_sha256 string and kept.

    keep: kept is binary (bytes), a string without characters that a cut has left incomplete (text), or absent (None).
    """
    runs = repeated_runs(docs, length, anchor, group_blocks, id_col, text_col)
    spans = runs.groupBy("doc", "print").agg(F.collect_set(F.struct("start", "starts")).alias("runs"))  # a text's own runs
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * bool(keep)
    carried = [c for c in docs.columns if c not in (text_col, "kept", *added)]
    doc, print_, text = _rows(docs, id_col, text_col)
    rows = docs.select(F.struct(*(F.col(c) for c in carried)).alias("row"), doc, print_, text)
    schema = T.StructType([*(docs.schema[c] for c in carried), *(T.StructField(c, T.LongType()) for c in added[:3]), T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept", T.StringType() if keep == "text" else T.BinaryType())] * bool(keep))
    joined = rows.join(spans, ["doc", "print"], "left").select(*(F.col("row")[c].alias(f"c{i}") for i, c in enumerate(carried)), "text", "runs")

    def run(batches):
        import hashlib

        for batch in batches:
            for some in by_size(batch, "text", STRETCH):
                out = []
                for text, found in zip(some.column("text").to_pylist(), some.column("runs").to_pylist(), strict=True):
                    raw = text.encode()
                    cuts = spans_of(np.array([r["start"] for r in found or ()], np.int64), np.array([r["starts"] for r in found or ()], np.int64), length)
                    at, kept = 0, []
                    for a, b in cuts:
                        kept.append(raw[at:a])
                        at = b
                    kept.append(raw[at:])
                    rest = b"".join(kept)
                    out.append((len(raw), len(raw) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if keep == "text" else rest))
                cols = [pa.array(c, kind) for c, kind in zip(list(zip(*out, strict=True))[: len(added)], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if keep == "text" else pa.binary()), strict=False)]
                yield pa.RecordBatch.from_arrays([*(some.column(f"c{i}") for i in range(len(carried))), *cols], names=[*carried, *added])

    return joined.mapInArrow(run, schema)
