"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at places where the splitting pattern always ends a match, so the cut
changes no token; decoding joins raw bytes, never characters.

Defined results: a null text counts as empty (no ids, empty bytes); repeated rows are encoded
each on their own; further columns are carried along as they are, unless they have the name of
an output column, which then replaces them; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, whole_text

#: Texts longer than this many characters are cut before encoding.
PIECE_CHARS = 1 << 16
#: A match of the pattern can't cross from a non-space to a space or newline, nor from a letter
#: to a mark; what is right of the cut is read alike with or without what is left of it.
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n])|(?<=[^\W\d_])(?=[^\w\s])")


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """The text cut at safe boundaries into pieces of about `size` characters."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        cut = _SAFE_CUT.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """tiktoken's encoding of a rank file, once for each Python worker."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(enc, text: str) -> np.ndarray:
    """uint32 ids of a whole text, without special tokens."""
    parts = [enc.encode_to_numpy(p, disallowed_special=()) for p in safe_pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def id_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    return pa.ListArray.from_arrays(ends, pa.array(flat.astype(np.int32, copy=False)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs without (or with) the text, plus ids array<int> and n_tokens long."""
    kept = [c for c in docs.columns if c not in (text_col, "ids", "n_tokens")]
    source = docs.select(*kept, whole_text(text_col).alias(text_col))
    carried = kept + [text_col] * keep_text
    schema = T.StructType([f for f in source.select(*carried).schema] + [T.StructField("ids", T.ArrayType(T.IntegerType(), True)), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for batch in slices(batches, text_col):
            ids = [encode_text(enc, x) for x in batch.column(text_col).to_pylist()]
            cols = [batch.column(c) for c in carried] + [id_lists(ids), pa.array([len(x) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*carried, "ids", "n_tokens"])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """df plus decoded binary: the ids' raw bytes. Null ids give empty bytes."""
    source = df.drop("decoded")
    names = source.columns
    schema = T.StructType([*source.schema, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for batch in slices(batches, ids_col):
            texts = [enc.decode_bytes(x.values.to_pylist() if x.is_valid else []) for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*names, "decoded"])

    return source.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    coded = decode(encode(docs.select("doc_id", "text"), ranks_path, pattern), ranks_path, pattern)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
