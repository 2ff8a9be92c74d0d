"""What files are, and what their bytes say: format by first bytes, name and type; text by its charset.

A file is a row of (content, filename, mime). Bad files give a row that says so, never an exception.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First bytes of sounds and pictures (place, bytes), and brands of one family that are pictures.
SOUNDS = [(0, b"fLaC"), (0, b"OggS")]
PICTURES = [(0, b"\x89PNG\r\n\x1a\n"), (0, b"\xff\xd8\xff"), (0, b"GIF87a"), (0, b"GIF89a"), (0, b"II*\0"), (0, b"MM\0*")]
PICTURE_BRANDS = {b"heic", b"heix", b"heim", b"heis", b"mif1", b"msf1", b"avif", b"avis"}
FRAMES = {0xFB, 0xFA, 0xF3, 0xF2, 0xF1, 0xF9}
#: By the ends of names, tried after the content.
BY_NAME = [(r"\.epub$", "epub"), (r"\.pdf$", "pdf"), (r"\.djvu?$", "djvu"), (r"\.docx$", "docx"), (r"\.odt$", "odt"), (r"\.fb2(?:\.zip)?$", "fb2"), (r"\.(?:mobi|azw3?|prc|pdb)$", "mobi"), (r"\.(?:md|markdown)$", "markdown"), (r"\.(?:html?|xhtml)$", "html"), (r"\.rtf$", "rtf"), (r"\.doc$", "unknown")]
BY_TYPE = [("epub", "epub"), ("pdf", "pdf"), ("djvu", "djvu"), ("markdown", "markdown"), ("html", "html"), ("rtf", "rtf")]
HEAD = 4096


def media_kind(b: bytes) -> str | None:
    """audio, picture or None, by the first bytes alone."""
    if len(b) >= 10 and b[:3] == b"ID3" and 2 <= b[3] <= 4 and b[4] < 16 and max(b[6:10]) < 128:
        return "audio"
    if b[:4] == b"RIFF" and b[8:12] in (b"WAVE", b"WEBP"):
        return "audio" if b[8:12] == b"WAVE" else "picture"
    if b[4:8] == b"ftyp" and len(b) >= 12:
        return "picture" if b[8:12].lower() in PICTURE_BRANDS else "audio"
    if any(b[at : at + len(sig)] == sig for at, sig in SOUNDS) or len(b) >= 4 and b[0] == 0xFF and b[1] in FRAMES:
        return "audio"
    bitmap = len(b) >= 26 and b[:2] == b"BM" and b[6:10] == b"\0\0\0\0"
    return "picture" if bitmap or any(b[at : at + len(sig)] == sig for at, sig in PICTURES) else None


def _in_zip(b: bytes, name: str, mime: str) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(b)) as z:
            names = set(z.namelist())
            kind = z.read("mimetype").decode("ascii", "replace").strip() if "mimetype" in names else ""
    except (zipfile.BadZipFile, KeyError, OSError, RuntimeError, ValueError):
        names, kind = set(), ""
    if kind == "application/epub+zip" or "META-INF/container.xml" in names:
        return "epub"
    if kind == "application/vnd.oasis.opendocument.text" or {"content.xml", "meta.xml"} <= names:
        return "odt"
    if "word/document.xml" in names:
        return "docx"
    if any(n.lower().endswith(".fb2") for n in names):
        return "fb2"
    return "epub" if name.endswith(".epub") or "epub" in mime else None


def format_of(b: bytes | None, filename: str | None = None, mime: str | None = None) -> str:
    """epub, pdf, djvu, mobi, docx, odt, fb2, rtf, html, markdown, text, or unknown for sounds, pictures and old Word files."""
    b, name, kind = b or b"", (filename or "").lower(), (mime or "").lower()
    if media_kind(b):
        return "unknown"
    for sig, found in ((b"%PDF-", "pdf"), (b"{\\rtf", "rtf"), (b"AT&TFORM", "djvu")):
        if b.startswith(sig):
            return found
    if b[60:68] in (b"BOOKMOBI", b"TEXtREAd"):
        return "mobi"
    if b[:4] == b"PK\x03\x04" and (found := _in_zip(b, name, kind)):
        return found
    head = b[:400].decode("utf-8", "ignore").lstrip("﻿ \t\r\n")
    if "<FictionBook" in head:
        return "fb2"
    for pattern, found in BY_NAME:
        by_type = next((f for t, f in BY_TYPE if t in kind and f == found), None)
        if re.search(pattern, name) or by_type:
            return found
    low = head.lower()
    if low.startswith(("<html", "<!doctype html")) or low.startswith("<?xml") and "<html" in low:
        return "html"
    return "markdown" if re.search(r"(?m)^#{1,6}\s", head) else "text"


def looks_binary(b: bytes | None) -> bool:
    """Whether the first bytes are of no text: zeros that don't fall in step as in UTF-16, or over 2 % control characters."""
    head = (b or b"")[:HEAD]
    n = len(head)
    if not n or head[:2] in (b"\xff\xfe", b"\xfe\xff") or head[:4] == b"\0\0\xfe\xff":
        return False
    even, odd = head[::2].count(0), head[1::2].count(0)
    control = sum(c < 32 and c not in b"\0\t\n\x0b\x0c\r\x1a\x1b" for c in head)
    in_step = odd > n / 5 and even < n / 50 or even > n / 5 and odd < n / 50
    return not (in_step and control < n / 50) and (even + odd > 1 or control > n / 50)


def guess_east_asian(b: bytes) -> str | None:
    """Shift_JIS, Big5, EUC-JP, EUC-KR or GB18030 of text in byte pairs; None if runs of high bytes aren't even enough for it."""
    b = b[:65536]
    runs = [m[0] for m in re.finditer(rb"(?:[\x80-\xff][\x40-\xff])+[\x80-\xff]?|[\x80-\xff]", b)]
    pairs = [(r[k], r[k + 1]) for r in runs for k in range(0, len(r) - 1, 2)]
    high = sum(map(len, runs))
    if high < 16 or len(pairs) < 8:
        return None
    even = sum(len(r) % 2 == 0 for r in runs) / len(runs)
    dense = b.count(b" ") * 20 < high
    if not (len(runs) >= 4 and even >= 0.95 or dense and even >= 0.9):
        return None
    share = lambda test: sum(map(test, pairs)) / len(pairs)
    if share(lambda p: 0x81 <= p[0] <= 0x9F) > 0.3:
        return "shift_jis"
    if share(lambda p: 0x40 <= p[1] < 0x7F) > 0.1:
        return "big5"
    if share(lambda p: p[0] in (0xA4, 0xA5) and p[1] >= 0xA1) > 0.2:
        return "euc_jp"
    return "euc_kr" if not dense and high / len(runs) < 12 else "gb18030"


def guess_cyrillic(b: bytes) -> str | None:
    """cp1251, koi8_r or cp866, by which makes most of the high bytes small letters; None if these are few, or fewer than ASCII letters."""
    b = b[:65536]
    high = [c for c in b if c >= 128]
    if len(high) < 8 or len(high) < sum(65 <= c <= 90 or 97 <= c <= 122 for c in b):
        return None
    raw, best = bytes(high), ("", len(high) // 2)
    for page in ("cp1251", "koi8_r", "cp866"):
        score = len(re.findall("[а-яёєії]", raw.decode(page, "replace")))
        best = (page, score) if score > best[1] else best
    return best[0] or None


_MARKS = [(codecs.BOM_UTF8, "utf-8"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe\0\0", "utf-32-le"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
_DECLARED = [re.compile(rb"""<\?xml[^>]*encoding\s*=\s*["']([^"']+)["']""", re.I), re.compile(rb"""<meta[^>]*charset\s*=\s*["']?([\w:.-]+)""", re.I)]
#: As browsers do, Latin-1 and ASCII are read as the superset of both.
_READ_AS = {"iso8859-1": "cp1252", "ascii": "cp1252", "gb2312": "gb18030", "gbk": "gb18030"}


def charset_of(b: bytes, declared: str | None = None, markup: bool = False) -> str:
    """The charset to read bytes by: a mark, what is declared, UTF-8 if they are (or mostly), UTF-16 by its zeros, then guesses, and cp1252 in the end."""
    for mark, name in _MARKS:
        if b.startswith(mark):
            return name
    if not declared and markup:
        found = next((m for p in _DECLARED if (m := p.search(b[:1024]))), None)
        declared = found[1].decode("ascii", "ignore") if found else None
    if declared:
        try:
            name = codecs.lookup(declared.strip()).name
            name = _READ_AS.get(name, name)
            b.decode(name)
            return name
        except (LookupError, UnicodeDecodeError):
            pass
    try:
        b.decode("utf-8")
        return "iso2022_jp" if b"\x1b$" in b and b"\x1b(" in b else "utf-8"
    except UnicodeDecodeError:
        pass
    good = len(re.findall(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}", b))
    bad = b.decode("utf-8", "replace").count("�")
    if good >= 10 * bad:
        return "utf-8+cp1252"
    n = len(b)
    if b[1::2].count(0) > n / 5 and b[::2].count(0) < n / 50:
        return "utf-16-le"
    if b[::2].count(0) > n / 5 and b[1::2].count(0) < n / 50:
        return "utf-16-be"
    return guess_east_asian(b) or guess_cyrillic(b) or "cp1252"


def _repair(e: UnicodeDecodeError):
    return e.object[e.start : e.start + 1].decode("cp1252", "replace"), e.start + 1


codecs.register_error("foliant-cp1252", _repair)


def decoded(b: bytes | None, declared: str | None = None, markup: bool = False) -> str:
    """The text of bytes; those that no charset has are replacement characters."""
    if not b:
        return ""
    name = charset_of(b, declared, markup)
    b = b[next((len(m) for m, _ in _MARKS if b.startswith(m)), 0) :]
    if name == "utf-8+cp1252":
        codecs.register_error("foliant-cp1252", _repair)
        return b.decode("utf-8", "foliant-cp1252")
    return b.decode(name, "replace")


def described(files: DataFrame, content: str = "content", filename: str | None = None, mime: str | None = None) -> DataFrame:
    """files with media, format, is_binary, charset, for columns of the file's bytes and, if there are any, its name and type."""

    @F.pandas_udf("struct<media:string,format:string,is_binary:boolean,charset:string>")
    def read(b: pd.Series, n: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = [(media_kind(x or b""), format_of(x, y, z), looks_binary(x), charset_of(x or b"", None, True)) for x, y, z in zip(b, n, t, strict=True)]
        return pd.DataFrame(rows, columns=["media", "format", "is_binary", "charset"])

    none = F.lit(None).cast("string")
    found = read(F.col(content), F.col(filename) if filename else none, F.col(mime) if mime else none)
    return files.withColumn("_f", found).select(*files.columns, "_f.media", "_f.format", "_f.is_binary", "_f.charset")


def text_of(content: Column, markup: bool = False) -> Column:
    @F.pandas_udf("string")
    def read(b: pd.Series) -> pd.Series:
        return b.map(lambda x: decoded(x, None, markup))

    return read(content)


#: Places of the blocks that stand for a file, and their size.
SAMPLED, SAMPLE = [0, *(1024 << 2 * i for i in range(11))], 1024


def partial_digest(b: bytes | None) -> str:
    """MD5 of blocks of a file at doubling distances, as readers that share places name files by."""
    import hashlib

    b = b or b""
    return hashlib.md5(b"".join(b[at : at + SAMPLE] for at in SAMPLED if at < len(b))).hexdigest()
