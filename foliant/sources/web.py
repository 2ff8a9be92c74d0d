"""Web pages and marked-up texts as blocks; the article of a page."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dealt

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript svg math head title textarea select".split())
BLOCKS = {"p": "paragraph", "li": "item", "blockquote": "quote", "pre": "code", "td": "cell", "th": "cell", "dt": "item", "dd": "item", "figcaption": "caption", "caption": "caption", **{f"h{i}": "heading" for i in range(1, 7)}}
DIVISIONS = frozenset("html body div section article main header footer nav aside form ul ol dl table tbody thead tr figure center details summary fieldset address".split())
#: What starting an element ends, up to the nearest of the second.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


#: Elements within each other; what is deeper belongs to the one at this depth.
MOST_DEPTH = 200


@dataclass
class Node:
    name: str
    parent: Node | None = None
    names: str = ""  # class and id
    parts: list = field(default_factory=list)  # nodes and texts
    depth: int = 0

    def raw(self) -> str:
        return "".join(p if isinstance(p, str) else f" {p.raw()} " if p.name in BLOCKS or p.name in DIVISIONS or p.name == "br" else p.raw() for p in self.parts if isinstance(p, str) or p.name not in SILENT)

    def text(self) -> str:
        return " ".join(self.raw().split())

    def linked(self) -> int:
        return sum(len(p.text()) if p.name == "a" else p.linked() for p in self.parts if not isinstance(p, str) and p.name not in SILENT)

    def walk(self):
        yield self
        for p in self.parts:
            if not isinstance(p, str) and p.name not in SILENT:
                yield from p.walk()


class _Reader(HTMLParser):
    """A tree of whatever markup there is: what isn't closed ends with its parent, what isn't open isn't closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def _close(self, names: set[str], until: set[str] = frozenset()) -> None:
        node = self.at
        while node is not None and node.name not in names:
            if node.name in until:
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag in DIVISIONS:
            self._close({"p"}, {"table", "td", "th"})
        if tag in ENDS:
            self._close(*ENDS[tag])
        given = dict(attrs)
        node = Node(tag, self.at, f"{given.get('class') or ''} {given.get('id') or ''}".strip().lower(), depth=self.at.depth + 1)
        self.at.parts.append(node)
        if tag not in VOID and node.depth < MOST_DEPTH:
            self.at = node

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close({tag})

    def handle_data(self, data):
        self.at.parts.append(data)


def tree(html: str | None) -> Node:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.root


def blocks_of(node: Node) -> list[tuple[str, int, str]]:
    """(role, level of a heading, text) in page order. Text of a division that stands beside blocks is a paragraph."""
    out: list[tuple[str, int, str]] = []
    loose: list[str] = []

    def flush() -> None:
        text = " ".join("".join(loose).split())
        loose.clear()
        if text:
            out.append(("paragraph", 0, text))

    def visit(n: Node) -> None:
        for p in n.parts:
            if isinstance(p, str):
                loose.append(p)
            elif p.name in SILENT:
                continue
            elif p.name in BLOCKS and not any(c.name in BLOCKS or c.name in DIVISIONS for c in p.walk() if c is not p):
                flush()
                text = p.text()
                if text:
                    out.append((BLOCKS[p.name], int(p.name[1]) if p.name[0] == "h" and p.name[1:].isdigit() else 0, text))
            elif p.name in BLOCKS or p.name in DIVISIONS:
                flush()
                visit(p)
                flush()
            elif p.name == "br":
                loose.append(" ")
            else:
                visit(p)

    visit(node)
    flush()
    return out


# Least length of a paragraph that counts, most of it in links, shares of its points for the levels above.
LEAST_PARAGRAPH, MOST_LINKED, SHARES = 25, 0.5, (1.0, 0.5, 0.25)
_GOOD, _BAD = re.compile(r"article|body|content|entry|main|post|story|text"), re.compile(r"comment|footer|menu|nav|promo|related|share|side|sponsor|widget|ad(?:s|vert)?\b")


def article_node(root: Node) -> Node:
    """The element whose paragraphs have most points, for length and commas, less with each level, times what its names say and the share outside of links."""
    points: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for n in root.walk():
        if n.name not in ("p", "pre", "td", "blockquote") or any(c.name in BLOCKS for c in n.walk() if c is not n):
            continue
        text = n.text()
        if len(text) < LEAST_PARAGRAPH or n.linked() > MOST_LINKED * len(text):
            continue
        worth, above, level = 1 + text.count(",") + min(len(text) // 100, 3), n.parent, 0
        while above is not None and level < len(SHARES):
            nodes[id(above)] = above
            points[id(above)] = points.get(id(above), 0.0) + worth * SHARES[level]
            level += above.name != "section"  # a section is no level of its own
            above = above.parent

    def final(n: Node) -> float:
        factor = (1.25 if _GOOD.search(n.names) else 1.0) * (0.5 if _BAD.search(n.names) or n.name in ("nav", "aside", "footer") else 1.0)
        return points[id(n)] * factor * (1 - n.linked() / max(1, len(n.text())))

    return max(nodes.values(), key=final) if nodes else root


def markdown_blocks(text: str | None) -> list[tuple[str, int, str]]:
    """(role, level, text) of Markdown: headings of both kinds, lists, quotes, fenced code, tables' cells, paragraphs; front matter is dropped."""
    body = re.sub(r"\A---\n.*?\n(?:---|\.\.\.)\n", "", (text or "").replace("\r\n", "\n"), flags=re.S)
    out: list[tuple[str, int, str]] = []
    plain: list[str] = []
    fence = ""

    def flush(role: str = "paragraph", level: int = 0) -> None:
        joined = " ".join(" ".join(plain).split())
        plain.clear()
        if joined:
            out.append((role, level, _unmarked(joined)))

    for line in body.split("\n"):
        if fence:
            if line.strip().startswith(fence):
                if plain:
                    out.append(("code", 0, "\n".join(plain)))
                plain.clear()
                fence = ""
            else:
                plain.append(line)
            continue
        m = re.match(r"\s*(```|~~~)", line)
        if m:
            flush()
            fence = m[1]
        elif m := re.match(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            flush()
            plain.append(m[2])
            flush("heading", len(m[1]))
        elif plain and (m := re.match(r" {0,3}(=+|-+)\s*$", line)):
            flush("heading", 1 if m[1][0] == "=" else 2)
        elif re.match(r"\s*(?:[-*_]\s*){3,}$", line) or re.match(r"\s*\|?[\s:|-]+\|[\s:|-]*$", line) or not line.strip():
            flush()
        elif m := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line):
            flush()
            plain.append(m[1])
            flush("item")
        elif m := re.match(r"\s*>\s?(.*)", line):
            flush()
            plain.append(m[1])
            flush("quote")
        elif re.match(r"\s*\|.*\|\s*$", line):
            flush()
            out.extend(("cell", 0, _unmarked(c.strip())) for c in line.strip().strip("|").split("|") if c.strip())
        else:
            plain.append(line)
    if fence:
        fence = ""
        out.append(("code", 0, "\n".join(plain)))
        plain.clear()
    flush()
    return out


def _unmarked(text: str) -> str:
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"\[\^[^\]]+\]", "", text)
    return re.sub(r"(\*\*|__|\*|_|`|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", text)


_ROWS = "array<struct<role:string,level:int,text:string>>"


def block_rows(docs: DataFrame, id_col: str, text_col: str, kind: str = "html") -> DataFrame:
    """id, n, role, level, text: the blocks of pages (html), of their articles (article), or of Markdown (markdown). Only the text column goes through Python."""
    return _block_rows(docs, text_col, kind, id_col)


def _block_rows(docs: DataFrame, text_col: str, kind: str, *keep: str | Column) -> DataFrame:
    """block_rows with some columns of docs."""
    read = {"html": lambda t: blocks_of(tree(t)), "article": lambda t: blocks_of(article_node(tree(t))), "markdown": markdown_blocks}[kind]

    @F.pandas_udf(_ROWS)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"role": r, "level": n, "text": x} for r, n, x in read(t)])

    rows = docs.select(*keep, F.posexplode(found(F.col(text_col))).alias("n", "b"))
    return rows.select("*", "b.role", "b.level", "b.text").drop("b")


def web_chapters(docs: DataFrame, id_col: str, html_col: str, title_col: str) -> DataFrame:
    """id, n, text: a chapter's lines without a site's furniture, and without its title where it is said again at the top."""
    from ..functions.text import is_junk_line, same_chapter_title

    rows = _block_rows(dealt(docs.filter(F.col(id_col).isNotNull()), id_col), html_col, "html", id_col, F.col(title_col).alias("_title"))
    kept = rows.filter(~is_junk_line(F.col("text")) & ~((F.col("n") < 3) & same_chapter_title(F.col("text"), F.col("_title"))))
    return kept.select(id_col, "n", "text")
