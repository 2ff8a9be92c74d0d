"""The merge queue against the tokenizers library, id by id."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliant.llm import merge_queue

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "中", "<|endoftext|>", "<|endof", "'s", "'t", "12", "½", " ", " ", "\U0001f600", "́", "the", "ing", "\x00", "​", "\U00016d40", "٣", "\x85"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts_have_the_library_s_ids(library):
    r, mine = random.Random(1), merge_queue.QueueEncoder(PATH)
    for _ in range(100):
        texts = ["".join(r.choices(PARTS, k=r.randint(0, 40))) for _ in range(50)]
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        got = mine.encode(texts)
        assert [x.tolist() for x in got] == want
        assert [mine.table.raw(x.astype(np.int64)).decode("utf-8", "replace") for x in got] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_any_ids_decode_as_the_library_decodes_them(library):
    r, table = random.Random(2), merge_queue.merge_table(PATH)
    for _ in range(2000):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 9))]
        assert table.raw(np.array(ids, np.int64)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_long_matches_and_equal_ranks(library):
    table = merge_queue.merge_table(PATH)
    for match in ("a" * 50_001, "ab" * 9_999, "thethe" * 4_001, "x", "Ġ", "ĠĠĠ"):
        assert table.ids(match) == [t.id for t in library.model.tokenize(match)]


def test_edges(spark, library):
    long = "stone and letters, é中 " * 60_000
    rows = [(1, "two words", "k", "n"), (1, "two words", "k", "n"), (2, None, "k", "n"), (3, "", "k", "n"), (4, long, "k", "n"), (None, " <|endoftext|>\n x ", "k", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    coded = merge_queue.decode(merge_queue.encode(docs, PATH), PATH).collect()
    assert sorted((r["decoded"] for r in coded)) == sorted(r[1] or "" for r in rows)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in merge_queue.round_trip(docs, PATH).collect()}
    for d, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[d] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert merge_queue.round_trip(docs.limit(0), PATH).count() == 0


def test_ids_that_are_null_or_unknown(spark):
    df = spark.createDataFrame([([50256, -1, 90000, None, 0],), (None,), ([],)], "ids array<int>")
    assert sorted(r["decoded"] for r in merge_queue.decode(df, PATH).collect()) == ["", "", "<|endoftext|>!"]
