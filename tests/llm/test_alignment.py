"""Alignment of two tokenizers against a plain walk over both."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foliant.llm import alignment, entry

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "中", "<|endoftext|>", "<s>", "'s", "12", "½", " ", " ", "\U0001f600", "́", "the", " the", "ing", "\x00", "​", "▁", "\U00016d40", "　", "\x85", " word", ". "]


@pytest.fixture(scope="module")
def walk():
    """(n_a, n_b, groups, links) of a text, token by token."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in visible]
    letters = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(hidden)}
    of_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def walked(text):
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        raw = (" " + (text or "")).encode()
        if not text or b"".join(map(of_a, x)) != raw or b"".join(map(of_b, y)) != raw:
            return 0, 0, "", []
        ends, at = {}, 0
        for k, i in enumerate(x):
            at += len(of_a(i))
            ends[at] = k + 1
        groups, links, at, done_a, done_b = [], [], 0, 0, 0
        for k, i in enumerate(y):
            at += len(of_b(i))
            if at in ends:
                groups.append(",".join(map(str, x[done_a : ends[at]])) + "|" + ",".join(map(str, y[done_b : k + 1])))
                links.append((x[ends[at] - 1], i))
                done_a, done_b = ends[at], k + 1
        return len(x), len(y), ";".join(groups), links

    return walked


def brute(walk, docs):
    each = [(d, *walk(t)) for d, t in docs]
    counts = Counter(x for *_, links in each for x in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    sha = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    return sorted(((d, na, nb, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha(g)) for d, na, nb, g, links in each), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_random_texts(walk):
    r, (a, b) = random.Random(3), alignment.coders(A, B)
    for _ in range(40):
        texts = ["".join(r.choices(PARTS, k=r.randint(0, 30))) for _ in range(40)]
        found = alignment.align(texts, a, b)
        for i, t in enumerate(texts):
            links = [(int(found["pairs"][j]) >> 32, int(found["pairs"][j]) & 0xFFFFFFFF) for j in np.frombuffer(found["links"][i], np.int32)]
            assert (found["n_a"][i], found["n_b"][i], found["groups"][i].decode(), links) == walk(t)


def test_no_text_at_all():
    a, b = alignment.coders(A, B)
    assert alignment.align(["", "x▁"], a, b)["groups"] == [b"", b""]
    assert len(alignment.align(["", "x▁"], a, b)["pairs"]) == 0


def test_edges_over_many_slices(spark, walk):
    r = random.Random(4)
    words = ["stone", "letters", "naïve", "Straße", "élan", "3.14", "don't", "中文", "water,", "gärden"]
    prose = lambda n: " ".join(r.choices(words, weights=range(10, 0, -1), k=n))
    docs = [(i, prose(r.choice([1, 30, 200]))) for i in range(60)]
    docs += [(3, docs[3][1]), (3, docs[3][1]), (None, prose(20)), (None, None), (70, None), (71, ""), (72, "a▁b c"), (73, prose(60_000)), (74, " x  y \n"), (75, "ab" * 40_000)]
    df = spark.createDataFrame([(*x, "q", 1, 2) for x in docs], "doc_id long, text string, links string, slice int, n_a int").repartition(3)
    want = brute(walk, docs)
    assert rows(alignment.aligned(df, A, B)) == want
    assert rows(alignment.aligned(df, A, B, slice_bytes=1000)) == want
    kept = {(x["doc_id"], x["groups"]) for x in alignment.aligned(df, A, B, keep_groups=True).collect()}
    assert kept == {(d, walk(t)[2]) for d, t in docs}
    assert alignment.aligned(df.limit(0), A, B).count() == 0
    assert rows(alignment.aligned(df.filter("doc_id in (70, 72)"), A, B)) == brute(walk, [(70, None), (72, "a▁b c")])


def test_query(spark, walk):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = entry.op12_tokenizer_alignment(spark, folder)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows(got) == brute(walk, docs)
