"""BPE encoding and decoding by a priority queue of merge ranks over a linked list of symbols.

A match of the splitter begins as a list of symbols, each linked to its neighbours. Every pair of
neighbours that the merge table knows waits in a heap under its rank and place; the least comes out,
its two symbols become one, and the new neighbours enter. An entry whose symbols have changed since
is stale and skipped, so a match of n symbols takes O(n log n) steps however long it is. Decoding
concatenates the vocabulary's strings and reads the bytes that they spell.

The vocabulary file is that of a byte-level tokenizer: its splitter and its letters for bytes are
used, its own merging is not. Matches that come again in a Python worker keep their ids.

Defined results: a null text counts as empty (no ids, empty text); names of added tokens inside a
text are those tokens; ids outside the vocabulary decode to nothing, null ids to the empty text;
repeated rows are encoded each on their own; a very long text is encoded whole; further columns are
carried along, unless they have the name of an output column, which then replaces them; an empty
table gives an empty table.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import id_lists
from .common import slices, whole_text
from .packing import StretchEncoder

#: A space after white space.
_SECOND_SPACE = re.compile(r" (?<=\s )")
#: Bits of a symbol's place, which shares a number with a rank.
_PLACE_BITS = 40
_PLACE = (1 << _PLACE_BITS) - 1
#: A symbol that has been merged into the one before it.
GONE = -1


class MergeTable:
    """The merges and vocabulary of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("not the file of a byte-level BPE tokenizer")
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: By rank: the left and the right id, and that of both together.
        self.left, self.right, self.both = [self.vocab[a] for a, _ in pairs], [self.vocab[b] for _, b in pairs], [self.vocab[a + b] for a, b in pairs]
        #: By left id: the entry, without its place, of each right id that it merges with.
        self.entries: list[dict[int, int]] = [{} for _ in range(max(self.vocab.values()) + 1)]
        for rank, (left, right) in enumerate(zip(self.left, self.right, strict=True)):
            self.entries[left][right] = rank << _PLACE_BITS
        self.added = {t["content"]: t["id"] for t in said["added_tokens"]}
        letters = _bytes_of_letters()
        spelled = {i: bytes(map(letters.__getitem__, s)) for s, i in self.vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        size = max(spelled) + 1
        each = [spelled.get(i, b"") for i in range(size)]
        self.lens = np.array([len(b) for b in each], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(each), np.uint8)

    def ids(self, match: str) -> list[int]:
        """Ids of one match, spelled in the vocabulary's letters."""
        symbols = list(map(self.vocab.__getitem__, match))
        n, entries, lefts, rights = len(symbols), self.entries, self.left, self.right
        # an entry is a rank and a place in one number, so that the least rank comes first, and of equal ranks the first place
        queue = [entry + i for i in range(n - 1) if (entry := entries[symbols[i]].get(symbols[i + 1])) is not None]
        if not queue:
            return symbols
        heapify(queue)
        symbols.append(GONE)  # after the last
        before, after = list(range(-1, n)), list(range(1, n + 2))
        while queue:
            entry = heappop(queue)
            i, rank = entry & _PLACE, entry >> _PLACE_BITS
            j = after[i]
            if symbols[i] != lefts[rank] or symbols[j] != rights[rank]:
                continue  # stale: one of the two has been merged away since
            symbols[i] = both = self.both[rank]
            symbols[j] = GONE
            after[i] = k = after[j]
            before[k] = i
            entry = entries[both].get(symbols[k])
            if entry is not None:
                heappush(queue, entry + i)
            h = before[i]
            if h >= 0:
                entry = entries[symbols[h]].get(both)
                if entry is not None:
                    heappush(queue, entry + h)
        return [s for s in symbols if s != GONE]

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids' strings spell, one after the other."""
        ids = ids[(ids >= 0) & (ids < len(self.lens))]
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        return self.flat[np.repeat(self.starts[ids] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def _bytes_of_letters() -> dict[str, int]:
    """The letter that spells each byte: the byte's own character where that is visible, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def uneven(text: str) -> bool:
    """Whether a text can't be taken apart at its spaces: it is empty, begins with one, ends in white space, or has one after white space."""
    return not text or text[0] == " " or text[-1].isspace() or _SECOND_SPACE.search(text) is not None


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    """Once for each Python worker."""
    return MergeTable(path)


class QueueEncoder(StretchEncoder):
    """Whole texts by stretches between spaces; every match's ids come from the merge queue."""

    def __init__(self, path: str):
        super().__init__(path)
        self.table = merge_table(path)
        names = sorted(self.table.added, key=len, reverse=True)
        self.names = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def _model_ids(self, match: str) -> list[int]:
        return self.table.ids(match)

    def _whole(self, text: str) -> np.ndarray:
        """A text with added tokens, or with white space that stretches can't be cut at."""
        parts = self.names.split(text) if self.names else [text]
        out: list[int] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.table.added[part])
            elif part:
                out += self._of_any(part)
        return np.array(out, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        return [x[:-1] for x in super().encode(texts)]


@lru_cache(maxsize=1)
def queue_encoder(path: str) -> QueueEncoder:
    """Once for each Python worker, so that tasks find what earlier ones have learned."""
    return QueueEncoder(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs without (or with) the text, plus ids array<int> and n_tokens long."""
    kept = [c for c in docs.columns if c not in (text_col, "ids", "n_tokens")]
    source = docs.select(*kept, whole_text(text_col).alias(text_col))
    carried = kept + [text_col] * keep_text
    schema = T.StructType([f for f in source.select(*carried).schema] + [T.StructField("ids", T.ArrayType(T.IntegerType(), True)), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        mine = queue_encoder(path)
        for batch in slices(batches, text_col):
            ids = mine.encode(batch.column(text_col).to_pylist())
            cols = [batch.column(c) for c in carried] + [id_lists(ids), pa.array([len(x) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*carried, "ids", "n_tokens"])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """df plus decoded string: the ids' strings one after the other; bytes that are no character become U+FFFD."""
    source = df.drop("decoded")
    names = source.columns
    schema = T.StructType([*source.schema, T.StructField("decoded", T.StringType())])

    def run(batches):
        table = merge_table(path)
        for batch in slices(batches, ids_col):
            texts = [table.raw(x.values.drop_null().to_numpy(zero_copy_only=False)).decode("utf-8", "replace") if x.is_valid else "" for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return source.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    coded = decode(encode(docs.select("doc_id", "text"), path), path)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
