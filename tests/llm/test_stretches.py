"""Stretches between spaces and ends of line against the tokenizers library, id by id."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliant.llm import alignment, merge_queue, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Ends of line, marks and letters in all orders: what decides whether a text can be taken apart.
PARTS = ["word", "Wörter", "é", "中", "ſ", "ⅳ", "12", "½", "'s", "'", "’", "”", "…", ".", "!?", "***", "<|", "|>", "--", "_", "\n", "\n", "\n\n", "\r\n", "\r", "\t", " ", " ", "  ", "\x85", "\x1c", " ", "　", "​", "<|endoftext|>", packing.BEGINS, packing.ENDS]


@pytest.mark.parametrize("encoder", [packing.StretchEncoder, merge_queue.QueueEncoder])
def test_ends_of_line_and_marks_have_the_library_s_ids(encoder):
    library, r, mine = Tokenizer.from_file(PATH), random.Random(5), encoder(PATH)
    end = [packing.END_ID] if encoder is packing.StretchEncoder else []
    for size in (3, 8, 40):
        for _ in range(60):
            texts = ["".join(r.choices(PARTS, k=r.randint(0, size))) for _ in range(50)]
            want = [library.encode(t, add_special_tokens=False).ids + end for t in texts]
            assert [x.tolist() for x in mine.encode(texts)] == want


def test_blank_lines_and_carriage_returns_are_taken_apart(monkeypatch):
    library, mine = Tokenizer.from_file(PATH), packing.StretchEncoder(PATH)
    monkeypatch.setattr(mine, "_whole", None)  # none of these is encoded whole
    texts = ["One line.\nAnother, “as long”.\n\nA third\n", "a\r\nb c\r\nd", "x\n\n(y) z", "x\n y"]
    assert [x.tolist() for x in mine.encode(texts)] == [library.encode(t, add_special_tokens=False).ids + [packing.END_ID] for t in texts]


def test_a_word_is_learned_once_whatever_follows_it():
    r, mine = random.Random(6), packing.StretchEncoder(PATH)
    words = ["".join(r.choices("abcdefgh", k=7)) for _ in range(100)]
    mine.encode(["a " + " ".join(w + m for w in words) + "." for m in ("", ".", ",", "!", "?!", "***", "$$$", "\nNext")])
    assert len(mine.known) < 200  # 801 when every stretch was kept with its marks


def test_what_is_kept_is_bounded():
    r, mine, library = random.Random(7), packing.StretchEncoder(PATH, kept=50), Tokenizer.from_file(PATH)
    for _ in range(20):
        text = " ".join("".join(r.choices("abc.", k=5)) for _ in range(30))
        assert mine.encode([text])[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, packing.END_ID]
        assert len(mine.known) <= 50 + 2 * 30


def test_the_queue_merges_a_word_once_whatever_follows_it():
    r, mine = random.Random(8), merge_queue.QueueEncoder(PATH)
    words = ["".join(r.choices("abcdefgh", k=7)) for _ in range(100)]
    mine.encode(["a " + " ".join(w + m for w in words) + "." for m in ("", "\nNext", "\n(next)", "***", "!?")])
    assert len(mine.known) < 200  # 501 when every stretch was kept with its marks


def test_stretches_behind_a_space_have_the_library_s_ids():
    library, r, mine = Tokenizer.from_file(PATH), random.Random(9), alignment.Spaced(PATH, 500)
    library.encode_special_tokens = True
    for size in (2, 5, 40):  # the last are long
        for _ in range(40):
            words = list(dict.fromkeys("".join(r.choices(PARTS, k=r.randint(0, size))).lstrip(" ") for _ in range(50)))
            ids, word = mine.tokens(words)
            for i, w in enumerate(words):
                assert ids[word == i].tolist() == library.encode(" " + w, add_special_tokens=False).ids
            assert (word[1:] >= word[:-1]).all() and len(mine.known) <= 500 + 2 * 51
    assert not any(len(w) > alignment.LONG + len(packing.ENDS) for w in mine.known)


def test_the_alignment_learns_a_word_once_whatever_follows_it():
    r, (a, _) = random.Random(10), alignment.coders(PATH, public_tokenizers.path("piece_bpe_32k.model"))
    words, known = ["".join(r.choices("abcdefgh", k=7)) for _ in range(100)], a.tokens.__self__.known
    a.tokens([w + m for w in words for m in ("", ".", "?!", "***", ",", "$$$")])
    assert 100 <= len(known) < 120
