"""Books in containers: EPUB, FB2, DOCX, ODT, RTF as sections and blocks; feeds of catalogues; narration clips.

A file is a row of bytes (`spark.read.format("binaryFile")`); each is read by itself, so a book's size bounds a
task. A file that can't be read gives one row that says why, in `error`.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detect import decoded, format_of
from .web import blocks_of, markdown_blocks, tree

Block = tuple[str, int, str]
Section = tuple[str | None, list[Block]]


class Unreadable(Exception):
    """Why a book can't be read, in words."""


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _xml(raw: bytes) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(re.sub(rb"<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", b"", raw))
    except ElementTree.ParseError as e:
        raise Unreadable(f"bad XML: {e}") from e


def _all(node: ElementTree.Element, name: str):
    return (x for x in node.iter() if _local(x.tag) == name)


def _attr(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _said(node: ElementTree.Element, skip: frozenset[str] = frozenset()) -> str:
    def parts(n):
        if _local(n.tag) in skip:
            return
        yield n.text or ""
        for c in n:
            yield from parts(c)
            yield c.tail or ""

    return " ".join("".join(parts(node)).split())


def _zip(raw: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise Unreadable("not a zip file") from e


def _member(z: zipfile.ZipFile, name: str) -> bytes:
    try:
        return z.read(name)
    except KeyError as e:
        raise Unreadable(f"{name} is missing") from e


def zip_entries(raw: bytes | None) -> list[tuple[str, int]]:
    """(name, size) of a zip file's entries; none if it isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
            return [(i.filename, i.file_size) for i in z.infolist()]
    except zipfile.BadZipFile:
        return []


def read_epub(raw: bytes) -> list[Section]:
    """The spine's documents in order, titled by the table of contents, else by their first heading. Encrypted books are refused."""
    z = _zip(raw)
    if "META-INF/encryption.xml" in z.namelist() and b"EncryptedData" in z.read("META-INF/encryption.xml") and b"font" not in z.read("META-INF/encryption.xml").lower():
        raise Unreadable("the book is encrypted")
    opf_path = next((_attr(x, "full-path") for x in _all(_xml(_member(z, "META-INF/container.xml")), "rootfile")), None)
    if not opf_path:
        raise Unreadable("no package document")
    opf, base = _xml(_member(z, opf_path)), posixpath.dirname(opf_path)
    at = lambda href: posixpath.normpath(posixpath.join(base, unquote(href)))
    items = {_attr(x, "id"): x for x in _all(opf, "item")}
    titles: dict[str, str] = {}
    for x in items.values():
        if "nav" in (_attr(x, "properties") or "").split() or (_attr(x, "media-type") or "").endswith("dtbncx+xml"):
            path = at(_attr(x, "href") or "")
            if path in z.namelist():
                toc = _xml(z.read(path))
                for p in _all(toc, "navPoint"):
                    src = next((_attr(c, "src") for c in _all(p, "content")), "")
                    titles.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(path), unquote((src or "").split("#")[0]))), next((_said(t) for t in _all(p, "text")), ""))
                for a in _all(toc, "a"):
                    titles.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(path), unquote((_attr(a, "href") or "").split("#")[0]))), _said(a))
    out: list[Section] = []
    for ref in _all(opf, "itemref"):
        item = items.get(_attr(ref, "idref"))
        path = at(_attr(item, "href") or "") if item is not None else ""
        if path not in z.namelist() or "html" not in (_attr(item, "media-type") or "html"):
            continue
        blocks = blocks_of(tree(decoded(z.read(path), None, True)))
        out.append((titles.get(path) or next((t for r, _, t in blocks if r == "heading"), None), blocks))
    return out


def read_fb2(raw: bytes) -> list[Section]:
    """A section of each body's sections; notes are a body of their own and left out."""
    if raw[:2] == b"PK":
        z = _zip(raw)
        raw = z.read(next(n for n in z.namelist() if n.lower().endswith(".fb2")))
    book = _xml(decoded(raw, None, True).encode() if b"encoding" in raw[:200] and b"utf-8" not in raw[:200].lower() else raw)
    out: list[Section] = []

    def visit(section) -> None:
        title = next((_said(x) for x in section if _local(x.tag) == "title"), None)
        blocks: list[Block] = [("heading", 1, title)] if title else []
        inner = []
        for x in section:
            kind = _local(x.tag)
            if kind == "section":
                inner.append(x)
            elif kind in ("p", "subtitle", "cite", "epigraph", "poem", "text-author"):
                leaves = [p for p in x.iter() if _local(p.tag) in ("p", "v", "text-author")] or [x]
                blocks += [("quote" if kind in ("cite", "epigraph", "poem") else "paragraph", 0, t) for p in leaves if (t := _said(p, frozenset(["a"]) if kind == "note" else frozenset()))]
        if blocks:
            out.append((title, blocks))
        for x in inner:
            visit(x)

    for body in _all(book, "body"):
        if _attr(body, "name") != "notes":
            visit(body)
    return out


def _by_headings(blocks: list[Block]) -> list[Section]:
    out: list[Section] = []
    for b in blocks:
        if b[0] == "heading" or not out:
            out.append((b[2] if b[0] == "heading" else None, []))
        out[-1][1].append(b)
    return out


def read_docx(raw: bytes) -> list[Section]:
    """Paragraphs by style; a heading begins a section; contents fields, deleted text and pictures are left out."""
    doc = _xml(_member(_zip(raw), "word/document.xml"))
    blocks: list[Block] = []
    for p in _all(doc, "p"):
        style = next((_attr(s, "val") or "" for s in _all(p, "pStyle")), "").lower()
        if style.startswith("toc"):
            continue
        text = " ".join("".join((x.text or "") if _local(x.tag) == "t" else " " if _local(x.tag) in ("tab", "br") else "" for x in p.iter()).split())
        level = re.match(r"(?:heading|title)\s*(\d?)", style)
        if text:
            blocks.append(("heading", int(level[1] or 1), text) if level else ("item" if any(True for _ in _all(p, "numPr")) else "paragraph", 0, text))
    return _by_headings(blocks)


def read_odt(raw: bytes) -> list[Section]:
    doc = _xml(_member(_zip(raw), "content.xml"))
    blocks: list[Block] = []
    inside = {id(x) for kind in ("table-of-content", "note", "annotation") for t in _all(doc, kind) for x in t.iter()}
    for x in doc.iter():
        kind = _local(x.tag)
        if kind in ("h", "p") and id(x) not in inside:
            text = _said(x, frozenset(["note", "annotation"]))
            if text:
                blocks.append(("heading", int(_attr(x, "outline-level") or 1), text) if kind == "h" else ("paragraph", 0, text))
    return _by_headings(blocks)


_RTF = re.compile(rb"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|([^\\{}\r\n]+)", re.I)
#: Groups that hold no text of the book.
_RTF_APART = frozenset(b"fonttbl colortbl stylesheet info pict header headerl headerr footer footerl footerr footnote object themedata datastore listtable listoverridetable generator".split())


def read_rtf(raw: bytes) -> list[Section]:
    """Paragraphs of the text; groups of fonts, styles, pictures, headers and notes are left out."""
    page = re.search(rb"\\ansicpg(\d+)", raw[:1000])
    charset = f"cp{page[1].decode()}" if page else "cp1252"
    lines, out, hidden, uc, skip = [], bytearray(), [False], [1], 0
    text: list[str] = []

    def flush() -> None:
        if out:
            text.append(bytes(out).decode(charset, "replace"))
            out.clear()

    for word, number, hexed, sign, brace, plain in _RTF.findall(raw):
        if brace == b"{":
            hidden.append(hidden[-1])
            uc.append(uc[-1])
        elif brace == b"}":
            if len(hidden) > 1:
                hidden.pop()
                uc.pop()
        elif word:
            if word in _RTF_APART:
                hidden[-1] = True
            elif word == b"uc":
                uc[-1] = int(number or 1)
            elif hidden[-1]:
                continue
            elif word in (b"par", b"line", b"page", b"sect"):
                flush()
                lines.append("".join(text))
                text.clear()
            elif word == b"tab":
                out += b" "
            elif word == b"u" and number:
                flush()
                text.append(chr(int(number) % 65536))
                skip = uc[-1]
        elif sign == b"*":
            hidden[-1] = True
        elif not hidden[-1]:
            piece = bytes([int(hexed, 16)]) if hexed else b" " if sign == b"~" else sign if sign in (b"\\", b"{", b"}") else plain
            drop = min(skip, len(piece))
            skip -= drop
            out += piece[drop:]
    flush()
    lines.append("".join(text))
    return _by_headings([("paragraph", 0, t) for x in lines if (t := " ".join(x.split()))])


READERS = {
    "epub": read_epub, "fb2": read_fb2, "docx": read_docx, "odt": read_odt, "rtf": read_rtf,
    "html": lambda raw: _by_headings(blocks_of(tree(decoded(raw, None, True)))), "markdown": lambda raw: _by_headings(markdown_blocks(decoded(raw))),
    "text": lambda raw: [(None, [("paragraph", 0, t) for p in re.split(r"\n\s*\n", decoded(raw)) if (t := " ".join(p.split()))])],
}


def ingested(raw: bytes | None, filename: str | None = None, mime: str | None = None) -> tuple[str, str | None, list[Section]]:
    """(format, error, sections) of a file."""
    kind = format_of(raw, filename, mime)
    if kind not in READERS:
        return kind, f"{kind} files are not read", []
    try:
        return kind, None, READERS[kind](raw or b"")
    except Unreadable as e:
        return kind, str(e), []
    except Exception as e:  # a broken file is a row, not a failed job
        return kind, f"{type(e).__name__}: {e}", []


def books(files: DataFrame, id_col: str, content: str = "content", filename: str | None = None, mime: str | None = None) -> DataFrame:
    """id, format, error, sec, title, blk, role, level, text: a row a block; a file without any has one row without a text."""
    blocks = "array<struct<sec:int,title:string,blk:int,role:string,level:int,text:string>>"

    @F.pandas_udf(f"struct<format:string,error:string,blocks:{blocks}>")
    def read(b: pd.Series, n: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, name, kind in zip(b, n, t, strict=True):
            form, error, found = ingested(raw, name, kind)
            rows.append((form, error, [{"sec": s, "title": title, "blk": i, "role": r, "level": v, "text": x} for s, (title, own) in enumerate(found) for i, (r, v, x) in enumerate(own)]))
        return pd.DataFrame(rows, columns=["format", "error", "blocks"])

    none = F.lit(None).cast("string")
    got = files.select(id_col, read(F.col(content), F.col(filename) if filename else none, F.col(mime) if mime else none).alias("r"))
    return got.select(id_col, "r.format", "r.error", F.explode_outer("r.blocks").alias("b")).select(id_col, "format", "error", "b.*")


def clips(smil: str) -> list[tuple[str, str, str]]:
    """(text, begin, end) of the clips of an overlay's audio, the clock values as written."""
    return [(_attr(t, "src") or "", _attr(a, "clipBegin") or "0", _attr(a, "clipEnd") or "") for p in _all(_xml(smil.encode()), "par") for t in _all(p, "text") for a in _all(p, "audio")]


def feed_entries(raw: str) -> list[tuple[str, str, str, str]]:
    """(title, author, link, type) of a catalogue's entries, Atom or JSON; the link is the one to take, or else the first."""
    if raw.lstrip().startswith("{"):
        feed = json.loads(raw)
        out = []
        for e in [*feed.get("publications", []), *feed.get("navigation", [])]:
            meta, links = e.get("metadata", e), e.get("links", [e] if "href" in e else [])
            best = next((x for x in links if "acquisition" in str(x.get("rel", ""))), links[0] if links else {})
            author = meta.get("author", "")
            author = author if isinstance(author, str) else (author[0] if isinstance(author, list) and author else author)
            out.append((meta.get("title", ""), author if isinstance(author, str) else (author or {}).get("name", ""), best.get("href", ""), best.get("type", "")))
        return out
    out = []
    for e in _all(_xml(raw.encode()), "entry"):
        links = list(_all(e, "link"))
        best = next((x for x in links if "acquisition" in (_attr(x, "rel") or "")), links[0] if links else None)
        said = lambda n: next((_said(x) for x in e.iter() if _local(x.tag) == n), "")  # noqa: E731, B023
        out.append((said("title"), said("name"), (_attr(best, "href") or "") if best is not None else "", (_attr(best, "type") or "") if best is not None else ""))
    return out


def imported(books_: DataFrame, chapters: DataFrame, bodies: DataFrame) -> DataFrame:
    """book, place, title, text from a backup's tables: books(url, title), chapters(book_url, url, title, position), bodies(url, body). Chapters without a body stay, without a text."""
    titled = books_.select(F.col("url").alias("book_url"), F.col("title").alias("book"))
    rows = chapters.join(titled, "book_url").join(bodies.select("url", "body"), "url", "left")
    return rows.select("book", F.col("position").alias("place"), "title", F.col("body").alias("text"))


def feed_rows(feeds: DataFrame, id_col: str, feed_col: str) -> DataFrame:
    """id, n, title, author, link, type: the entries of catalogues; none for what can't be read."""

    @F.pandas_udf("array<struct<title:string,author:string,link:string,type:string>>")
    def read(texts: pd.Series) -> pd.Series:
        def of(t):
            try:
                return [dict(zip(("title", "author", "link", "type"), e, strict=True)) for e in feed_entries(t or "")]
            except (Unreadable, ValueError, AttributeError):
                return []

        return texts.map(of)

    rows = feeds.select(id_col, F.posexplode(read(F.col(feed_col))).alias("n", "e"))
    return rows.select(id_col, "n", "e.*")


def clip_rows(overlays: DataFrame, id_col: str, smil_col: str) -> DataFrame:
    """id, n, place, begin, end: the clips of narration overlays, clock values as written."""

    @F.pandas_udf("array<struct<place:string,begin:string,end:string>>")
    def read(texts: pd.Series) -> pd.Series:
        def of(t):
            try:
                return [dict(zip(("place", "begin", "end"), c, strict=True)) for c in clips(t or "")]
            except Unreadable:
                return []

        return texts.map(of)

    rows = overlays.select(id_col, F.posexplode(read(F.col(smil_col))).alias("n", "c"))
    return rows.select(id_col, "n", "c.*")
