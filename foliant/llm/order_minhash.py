"""Near-duplicate documents by order MinHash, verified by banded alignment.

A document's k-mers are its runs of `k` words, each labelled with how often it has occurred
before, so that all labelled k-mers of a document differ. A sketch entry takes the `ell` labelled
k-mers that one hash function makes smallest, in the order of the text. Documents that share an
entry meet in a bucket. First every member is aligned with its bucket's leader, the member that
meets most others in all its buckets, as an original does among its copies; what is linked is one
class. A bucket that then is still in several classes has stragglers, the members outside its
largest class. Stragglers meet all members of other classes inside one task, in blocks of a few
hundred, so that no task has a whole large bucket and no pairs are ever rows: two exact bounds
(the counts of their k-mers, and bitmaps that differ in no more bits than the k-mers do) rule out
most, and the others are aligned at once, but for those that have become one class meanwhile or
meet in another bucket first. Only links leave the task. So every pair that shares an entry is of
one class, aligned, or ruled out.

The alignment pairs equal labelled k-mers inside a band around the diagonal whose width is all
that the threshold allows, and takes the longest chain that rises in both texts. Similarity is
the chain's length over the k-mers of both together; it is the Jaccard similarity of the k-mers
if their order agrees, and less if it doesn't.

Words are what white space separates, lower-cased, without marks at their ends; what holds only
marks is no word. Defined results: a null text counts as empty; equal texts are always of one
class, also without words; texts of fewer than `k` words have one k-mer, all their words; texts
without words have no near copies; a class has the smallest doc_id of its members as id, null if
none has one; a very long text is read whole, as any other; repeated rows keep their own rows; further columns don't matter; an empty table
gives no rows.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_size, whole_text, written
from .graph import components

K = 5
ELL = 2
#: At similarity 0.8 two texts share no entry once in about 200,000 pairs.
ENTRIES = 12
THRESHOLD = 0.8
#: Members of a bucket that meet in a task, of either side.
BLOCK = 768
#: 64-bit words of a text's bitmap.
BITMAP = 16

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """uint64 with every bit depending on every bit."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _bare(word: str) -> str:
    word = word.lower()
    at, end = 0, len(word)
    while at < end and not word[at].isalnum():
        at += 1
    while end > at and not word[end - 1].isalnum():
        end -= 1
    return word[at:end]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """uint64 hashes of all texts' words end to end, and where each text's begin (one more at the end)."""
    split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    coded = pc.dictionary_encode(split.values)
    words = list(map(_bare, coded.dictionary.to_pylist()))
    by_code = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    real = np.fromiter(map(bool, words), bool, len(words))
    code = coded.indices.to_numpy()
    kept = real[code] if len(words) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(kept)])
    return by_code[code[kept]] if len(words) else np.zeros(0, np.uint64), before[split.offsets.to_numpy()]


def labelled(texts: list[str], k: int = K) -> list[np.ndarray]:
    """uint64 hashes of each text's labelled k-mers, in text order; all differ within a text."""
    words, bounds = word_hashes(texts)
    n = max(0, len(words) - k + 1)
    runs = np.zeros(n, np.uint64)
    for i in range(k):
        runs = runs * _ODD + words[i : i + n]
    runs = mixed(runs)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a < k:
            h = np.full(int(b > a), b - a, np.uint64)
            for at in range(a, b):
                h = h * _ODD + words[at : at + 1]
            out.append(mixed(h))
            continue
        x = runs[a : b - k + 1]
        order = np.argsort(x, kind="stable")
        same = np.concatenate([[False], x[order][1:] == x[order][:-1]])
        if same.any():
            at = np.arange(len(x))
            first = np.maximum.accumulate(np.where(same, 0, at))
            times = np.empty(len(x), np.uint64)
            times[order] = (at - first).astype(np.uint64)
            x = np.where(times > 0, mixed(x + times * _ODD), x)
        out.append(x)
    return out


def sketches(kmers: list[np.ndarray], entries: int = ENTRIES, ell: int = ELL) -> list[np.ndarray | None]:
    """int64 bucket keys of each text, one an entry; None for a text without k-mers."""
    real = [i for i, x in enumerate(kmers) if len(x)]
    out: list[np.ndarray | None] = [None] * len(kmers)
    if not real:
        return out
    flat = np.concatenate([kmers[i] for i in real])
    lens = np.array([len(kmers[i]) for i in real])
    starts = np.cumsum(lens) - lens
    owner = np.repeat(np.arange(len(real)), lens)
    keys = np.empty((len(real), entries), np.uint64)
    top = np.uint64(2**64 - 1)
    for e in range(entries):
        v = mixed(flat + np.uint64((e + 1) * int(_ODD) % 2**64))
        places = np.full((len(real), ell), len(flat))
        for r in range(ell):
            least = np.minimum.reduceat(v, starts)
            hit = np.flatnonzero(v == least[owner])
            hit = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])]
            taken = v[hit] != top
            places[owner[hit[taken]], r] = hit[taken]
            v[hit] = top
        places.sort(axis=1)  # the order of the text
        key = np.full(len(real), np.uint64(e + 1))
        for r in range(ell):
            there = places[:, r] < len(flat)
            key = np.where(there, mixed(key * _ODD + flat[np.minimum(places[:, r], len(flat) - 1)]), key)
        keys[:, e] = key
    for row, i in enumerate(real):
        out[i] = keys[row].view(np.int64)
    return out


def alignment_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Similarity of two texts' labelled k-mers; below the threshold it may come out too small, never too large."""
    if not len(a) or not len(b):
        return 0.0
    _, i, j = np.intersect1d(a, b, return_indices=True)
    both = len(a) + len(b)
    if len(i) / (both - len(i)) < threshold:
        return len(i) / (both - len(i))
    j = j[np.argsort(i)]
    i = np.sort(i)
    least = math.ceil(threshold * both / (1 + threshold) - 1e-9)  # of a chain; a match further off the diagonal than all that it leaves is in none
    j = j[np.abs(i - j) <= both - 2 * least]
    if len(j) > 1 and not (j[1:] > j[:-1]).all():
        chain: list[int] = []
        for x in j.tolist():
            at = bisect.bisect_left(chain, x)
            if at == len(chain):
                chain.append(x)
            else:
                chain[at] = x
        return len(chain) / (both - len(chain))
    return len(j) / (both - len(j))


def bitmap(kmers: np.ndarray) -> np.ndarray:
    """int64 words; each k-mer turns one bit over, so two bitmaps differ in no more bits than the k-mers do."""
    bits = np.bincount((kmers & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def text_node(text_col: str = "text"):
    """Key of a text: 16 bytes, equal for equal texts."""
    return F.unhex(F.md5(whole_text(text_col).cast("binary")))


def sketch_table(docs: DataFrame, text_col: str = "text", k: int = K, entries: int = ENTRIES, ell: int = ELL) -> DataFrame:
    """node, keys array<long>: a row for each different text that has words."""

    def run(batches):
        for batch in batches:
            for some in by_size(batch, "text"):
                found = sketches(labelled(some.column("text").to_pylist(), k), entries, ell)
                yield pa.RecordBatch.from_arrays([some.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "keys"])

    rows = docs.select(text_node(text_col).alias("node"), whole_text(text_col).alias("text")).mapInArrow(run, "node binary, keys array<long>")
    return rows.filter(F.col("keys").isNotNull()).groupBy("node").agg(F.first("keys").alias("keys"))


def kmer_table(docs: DataFrame, nodes: DataFrame, text_col: str = "text", k: int = K) -> DataFrame:
    """A row for each node of nodes(node, keys): node, keys, kmers (uint32 hashes as bytes), size (their number), bits (their bitmap)."""

    def run(batches):
        for batch in batches:
            for some in by_size(batch, "text"):
                found = [x >> np.uint64(32) for x in labelled(some.column("text").to_pylist(), k)]
                cols = [pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()), pa.array(map(len, found), pa.int32()), pa.array([bitmap(x).tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([some.column("node"), some.column("keys"), *cols], names=["node", "keys", "kmers", "size", "bits"])

    one_each = docs.select(text_node(text_col).alias("node"), whole_text(text_col).alias("text")).groupBy("node").agg(F.first("text").alias("text"))
    return one_each.join(nodes.select("node", "keys"), "node").select("node", "keys", "text").mapInArrow(run, "node binary, keys array<long>, kmers binary, size int, bits binary")


def aligned(pairs: DataFrame, kmers: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, leader, company, linked boolean of pairs(node, leader, company)."""

    def run(batches):
        for batch in batches:
            for some in by_size(batch, "x"):
                x, y = (some.column(c).to_pylist() for c in ("x", "y"))
                like = [alignment_similarity(np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4"), threshold) >= threshold for p, q in zip(x, y, strict=True)]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("node", "leader", "company")), pa.array(like, pa.bool_())], names=["node", "leader", "company", "linked"])

    left = kmers.select("node", F.col("kmers").alias("x"))
    right = kmers.select(F.col("node").alias("leader"), F.col("kmers").alias("y"))
    return pairs.join(right, "leader").join(left, "node").select("node", "leader", "company", "x", "y").mapInArrow(run, "node binary, leader binary, company long, linked boolean")


def _several(members: DataFrame) -> DataFrame:
    """The members(key, node, label) of buckets with several classes, with n, straggler (outside the largest class) and stragglers (their number)."""
    of_class = members.groupBy("key", "label").agg(F.count("*").alias("m"))
    largest = of_class.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "label")).alias("most")).filter(F.col("n") > F.col("most.m"))
    largest = largest.select("key", "n", (F.col("n") - F.col("most.m")).alias("stragglers"), F.col("most.label").alias("main"))
    return members.join(largest, "key").select("key", "node", "label", "n", "stragglers", (F.col("label") != F.col("main")).alias("straggler"))


#: What a row of a block does there: it is one of the stragglers, one of the members that these meet, or both.
STRAGGLER, MEMBER = 1, 2


def _dealt(open_: DataFrame, block: int) -> DataFrame:
    """open_ with p, q (a block of a bucket's stragglers and one of its members) and role, a row for each block that a member belongs to."""
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    p, q = own("stragglers"), own("n")
    as_straggler = F.transform(every("n"), lambda x: F.struct(p.alias("p"), x.alias("q"), F.when(x == q, STRAGGLER | MEMBER).otherwise(STRAGGLER).alias("role")))
    as_member = lambda xs: F.transform(xs, lambda x: F.struct(x.alias("p"), q.alias("q"), F.lit(MEMBER).alias("role")))
    places = F.when(F.col("straggler"), F.concat(as_straggler, as_member(F.filter(every("stragglers"), lambda x: x != p)))).otherwise(as_member(every("stragglers")))
    return open_.select("key", "node", "label", "straggler", F.explode(places).alias("at")).select("key", "at.p", "at.q", "at.role", "node", "label", "straggler")


def links_within(rows: list[tuple], threshold: float = THRESHOLD) -> list[tuple[bytes, bytes]]:
    """Links that a block's stragglers have with its members, but for those between nodes that other links make one class.

    rows: (key, role, node, label, straggler, keys, kmers, size, bits), all of one key.
    """
    rows = sorted(rows, key=lambda r: (r[7], r[2]))
    roles, sizes = np.array([r[1] for r in rows]), np.array([r[7] for r in rows], np.int64)
    bits = np.frombuffer(b"".join(r[8] for r in rows), np.uint64).reshape(len(rows), BITMAP)
    number: dict[bytes, int] = {}
    label = np.array([number.setdefault(r[3], len(number)) for r in rows])
    above = list(range(len(number)))

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    links = []
    members = np.flatnonzero(roles & MEMBER)
    ours = np.flatnonzero(roles & STRAGGLER)
    share = threshold / (1 + threshold)
    for some in np.array_split(ours, max(1, -(-len(ours) // 32))):
        if not len(some):
            continue
        near = members[np.searchsorted(sizes[members], sizes[some[0]] * threshold - 1e-6) : np.searchsorted(sizes[members], sizes[some[-1]] / threshold + 1e-6, "right")]
        apart = np.bitwise_count(bits[some, None] ^ bits[None, near]).sum(axis=2, dtype=np.int64)
        both = sizes[some, None] + sizes[None, near]
        least = both * share - 1e-6  # matches that a pair at the threshold has
        may = (np.minimum(sizes[some, None], sizes[None, near]) >= least) & ((both - apart) / 2 >= least) & (label[some, None] != label[None, near])
        i, j = np.nonzero(may)
        nearest_first = np.argsort(apart[i, j] / both[i, j], kind="stable")
        for a, b in zip(some[i[nearest_first]].tolist(), near[j[nearest_first]].tolist(), strict=True):
            x, y = rows[a], rows[b]
            if y[4] and not x[2] < y[2] or root(label[a]) == root(label[b]) or min(set(x[5]).intersection(y[5])) != x[0]:
                continue  # two stragglers meet twice, classes may be one by now, and nodes may share several buckets
            if alignment_similarity(np.frombuffer(x[6], "<u4"), np.frombuffer(y[6], "<u4"), threshold) >= threshold:
                above[root(label[a])] = root(label[b])
                links.append((x[2], y[2]))
    return links


def straggler_links(open_: DataFrame, kmers: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """a, b: links of stragglers with members of other classes; open_ as _several returns it."""
    kinds = "a binary, b binary"
    cols = ["key", "role", "node", "label", "straggler", "keys", "kmers", "size", "bits"]

    def run(batches):
        group: list[tuple] = []
        at = None

        def done():
            links = links_within(group, threshold) if len(group) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("key", "p", "q")), strict=True)
            for place, row in zip(places, zip(*(batch.column(c).to_pylist() for c in cols), strict=True), strict=True):
                if place != at:
                    yield done()
                    group, at = [], place
                group.append(row)
        yield done()

    rows = _dealt(open_, block).join(kmers, "node").select("p", "q", *cols)
    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, kinds)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, entries: int = ENTRIES, ell: int = ELL, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """A row a different text, as a written table: node (text_node), label (equal for texts of one class), class_id (the smallest doc_id of the class)."""
    scratch = Scratch(docs.sparkSession, "order-minhash")
    entry = scratch.written(sketch_table(docs, text_col, k, entries, ell).select("node", F.explode("keys").alias("key")), "entries")
    shared = entry.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    sized = scratch.written(entry.join(shared, "key"), "sized")
    nodes = scratch.written(sized.groupBy("node").agg(F.collect_set("key").alias("keys"), F.sum("n").alias("company")), "nodes")  # at most `entries` keys
    kmers = scratch.written(kmer_table(docs, nodes, text_col, k), "kmers")
    ranked = sized.join(nodes.select("node", "company"), "node")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("company", F.xxhash64("node").alias("h"), "node")).alias("l")).select("key", F.col("l.company").alias("company"), F.col("l.node").alias("leader"))
    met = sized.join(leaders, "key").filter(F.col("node") != F.col("leader"))
    pairs = met.groupBy("node", "leader").agg(F.first("company").alias("company"))
    led = scratch.written(aligned(pairs, kmers, threshold), "led").filter("linked")
    # a text goes by the most central leader that it is linked to, or that it is; equal labels are of one class, though a class may still have several
    by_leader = led.select("node", "leader", "company").union(led.select(F.col("leader").alias("node"), "leader", "company"))
    labels = by_leader.groupBy("node").agg(F.max_by("leader", F.struct("company", "leader")).alias("label"))
    labels = scratch.written(labels, "labels")
    # both members of a bucket of two have met
    members = sized.filter(F.col("n") > 2).join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    open_ = scratch.written(_several(members), "open")
    more = scratch.written(straggler_links(open_, kmers, threshold, block), "links")
    links = led.select(F.col("node").alias("a"), F.col("leader").alias("b")).union(more)
    labels = components(links)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_node(text_col).alias("node"))
    own = rows.groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    own = scratch.written(own, "own")
    least = own.groupBy("label").agg(F.min("least").alias("class_id"))
    out = written(own.join(least, "label").select("node", "label", "class_id"), "order-minhash-classes")
    scratch.clear()
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row a document: doc_id, class_id (the smallest doc_id of its class). options as for `classes`."""
    found = classes(docs, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_node(text_col).alias("node"))
    return rows.join(found.select("node", "class_id"), "node").select("doc_id", "class_id")
