"""Main text of web pages by tree scoring.

A page is read into a tree that forgives unclosed and truncated markup. Every paragraph passes
points for its length and commas to its ancestors, less with each level; an element's points
are discounted by the share of its text that is inside links. From the best container the way goes
up to the article or main element around it, or else to the ancestor that gathers the paragraphs;
all of its blocks are kept, and those of its siblings that look like text. What never belongs to an
article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) is
left out, by element name, role, and names in class and id: of paragraphs and the like only by a
whole name, of containers also by a part of one, within an article only if the rest of the name says no more than a place. Lists of related pages go if they are links.

Defined results: null or empty html, and a page without text, give the empty text and 0
characters; a page of which nothing else is left falls back to its whole body; equal pages give
equal texts; ties go to the container that comes first; a very long page is read whole; further
columns are carried along unless they have the name of an output column; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: A comment, declaration or processing instruction; or a tag with its attributes, quotes respected.
_MARKUP = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|/?[a-zA-Z][^>]*+(?:>|\Z))""",
    re.S,
)
#: One attribute with its value, whose quotes are consumed, so that nothing inside a value is taken for a name.
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset("nav header footer aside form noscript template svg math button select object canvas audio video dialog menu head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
#: Starting one of these ends an open p.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
#: Starting the key ends open ones of the value, up to the nearest list or table.
ENDS_ALIKE = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Names in class and id, by what the contract leaves out.
MENUS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager".split())
SIDEBARS = frozenset("sidebar rail widget widgets".split())
NOTICES = frozenset("cookie cookies consent gdpr notice notices alert popup modal toast overlay paywall".split())
ADVERTS = frozenset("advert adverts advertisement advertising sponsor sponsored promo promotion".split())
FORMS = frozenset("form login signup subscribe newsletter".split())
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
HEADS_AND_FEET = frozenset("header masthead banner footer colophon copyright".split())
#: With these before it, a header or footer is the page's.
OF_PAGE = frozenset("site page global main top web".split())
AD = frozenset("ad ads".split())
#: What else is in the name of a place for adverts.
AD_PLACE = frozenset("slot unit box container wrapper block top bottom left right side inline google text label banner zone space area".split())
SHARING = frozenset("share sharing social".split())
#: What else is in the name of a part of a page that isn't text, as against "form-of-government".
PLACES = AD_PLACE | frozenset("list item items buttons button bar links link icons icon section area panel wrap inner outer row col column post article entry page site main content tools group form footer header title heading count thread field input email tweet facebook action actions".split())
ANYWHERE = MENUS | SIDEBARS | NOTICES | ADVERTS | FORMS | COMMENTS | SHARING
LINKS = frozenset("related recommended tags".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
KEPT_WHOLE = frozenset("html body article main".split())
#: Elements that hold text; names on them count only as a whole.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figure figcaption".split()) | INLINE

#: Points that an element has by its name.
BY_NAME = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 5.0, "pre": 3.0, "blockquote": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "form": -3.0, "h1": -5.0, "h2": -5.0, "h3": -5.0, "h4": -5.0, "h5": -5.0, "h6": -5.0, "th": -5.0}
LEAST_PARAGRAPH = 25
LEVELS = (1.0, 0.5, 0.25, 0.125)


def _named_noise(token: str, textual: bool, in_article: bool) -> bool:
    """Whether a name in a class or id says that the element doesn't belong to an article; within one a part of a name does only if all else in it are places."""
    low = token.lower()
    if low in ANYWHERE or low in AD or low in HEADS_AND_FEET:
        return True
    if textual:
        return False
    parts = [x.lower() for x in _PARTS.findall(token)]
    if not ANYWHERE.isdisjoint(parts) and (not in_article or all(x in ANYWHERE or x in AD or x in PLACES or x in LINKS or x in HEADS_AND_FEET or x.isdigit() for x in parts)):
        return True
    if not AD.isdisjoint(parts) and all(x in AD or x in AD_PLACE or x.isdigit() for x in parts):
        return True
    return len(parts) > 1 and parts[0] in OF_PAGE and not HEADS_AND_FEET.isdisjoint(parts)


PLAIN, NOISY, LINKED, HOLDS = range(4)


def _kind(name: str, attrs: str, in_article: bool = False) -> int:
    """What the element is by its name and attributes: plain, noise, a list of links if it is mostly links, or a holder of the article."""
    if name in LEFT_OUT:
        return NOISY
    kind = HOLDS if name in ("article", "main") else PLAIN
    if not attrs or name in ("html", "body"):
        return kind
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            tokens = value.split()
            if any(_named_noise(t, name in TEXTUAL or name in KEPT_WHOLE, in_article) for t in tokens):
                # an article element is noise only as a comment
                if name not in KEPT_WHOLE or any(not COMMENTS.isdisjoint(x.lower() for x in _PARTS.findall(t)) for t in tokens):
                    return NOISY
            elif any(not LINKS.isdisjoint(x.lower() for x in _PARTS.findall(t)) for t in tokens) and kind == PLAIN:
                kind = LINKED
        elif key == "role":
            if value.strip().lower() in NOISE_ROLES:
                return NOISY
            kind = HOLDS if value.strip().lower() in ("main", "article") else kind
        elif key == "itemprop":
            kind = HOLDS if value.strip() == "articleBody" else kind
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return NOISY
    return kind


class Page:
    """Elements in page order with their parents, and the blocks of text with the elements that own them."""

    def __init__(self, html: str, drop_noise: bool = True):
        self.names, self.parents, self.ends = ["#root"], [-1], [0]
        self.noise = [False]  # whether an element is noise or inside it
        self.kinds = [PLAIN]
        self.blocks: list[tuple[int, str, int]] = []  # owner, text, characters inside links
        self.stack = [0]
        self._held = 0  # open article and main elements
        self._parts: list[str] = []
        self._link_parts: list[str] = []
        self._links = 0
        self._read(html, drop_noise)
        while self.stack:
            self._close()

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                at = next(i for i in reversed(self.stack) if self.names[i] not in INLINE)
                self.blocks.append((at, text, len(" ".join("".join(self._link_parts).split()))))
            self._parts, self._link_parts = [], []

    def _text(self, s: str) -> None:
        if s and not self.noise[self.stack[-1]]:
            s = unescape(s) if "&" in s else s
            self._parts.append(s)
            if self._links:
                self._link_parts.append(s)

    def _open(self, name: str, kind: int = PLAIN) -> None:
        if name not in INLINE:
            if not self.noise[self.stack[-1]]:
                self._flush()
            if name in ENDS_P:
                self._end("p", {"table", "td", "th", "button", "object", "template", "svg", "math", "select"})
            if name in ENDS_ALIKE:
                alike, until = ENDS_ALIKE[name]
                for i in reversed(self.stack):
                    if self.names[i] in until:
                        break
                    if self.names[i] in alike:
                        self._pop_to(i)
        self.names.append(name)
        self.parents.append(self.stack[-1])
        self.noise.append(kind == NOISY or self.noise[self.stack[-1]])
        self.kinds.append(kind)
        self.ends.append(0)
        self.stack.append(len(self.names) - 1)
        self._links += name == "a"
        self._held += kind == HOLDS

    def _close(self) -> None:
        name = self.names[self.stack[-1]]
        if name not in INLINE and not self.noise[self.stack[-1]]:
            self._flush()
        self._links -= name == "a"
        self._held -= self.kinds[self.stack[-1]] == HOLDS
        self.ends[self.stack.pop()] = len(self.names)

    def _pop_to(self, node: int) -> None:
        while self.stack[-1] != node:
            self._close()
        self._close()

    def _end(self, name: str, until=frozenset()) -> None:
        for i in reversed(self.stack):
            if self.names[i] == name:
                return self._pop_to(i)
            if self.names[i] in until:
                return None

    def _read(self, html: str, drop_noise: bool) -> None:
        at, size = 0, len(html)
        while at < size:
            m = _MARKUP.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if not m["name"]:
                continue
            name, ends = m["name"].lower(), bool(m["end"])
            noisy = self.noise[self.stack[-1]]
            if ends:
                if name == "br":
                    self._parts.append("" if noisy else " ")
                elif name == "p" and not any(self.names[i] == "p" for i in self.stack):
                    if not noisy:
                        self._flush()
                else:
                    self._end(name)
            elif name in RAW:
                at = self._after(html, name, at)
            elif name in VOID and noisy or noisy and m["attrs"].endswith("/"):
                continue
            elif name in VOID:
                self._parts.append(" ") if name in ("br", "img") else None if name == "wbr" else self._flush()
            else:
                kind = _kind(name, m["attrs"], self._held > 0)
                kind = PLAIN if kind == NOISY and not drop_noise else kind
                if not m["attrs"].endswith("/"):
                    self._open(name, kind)
                elif kind == NOISY and name not in INLINE and not noisy:
                    self._flush()
                elif kind != NOISY and name not in ("svg", "path"):
                    self._open(name, kind)

    @staticmethod
    def _after(html: str, name: str, at: int) -> int:
        m = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
        return m.end() if m else len(html)

    def kept_blocks(self) -> list[str]:
        """The texts of the best container, or what gathers its article, and of its siblings that look like text."""
        n = len(self.names)
        points, whole, chars, links = [0.0] * n, [0.0] * n, [0] * n, [0] * n
        scored = [kind == HOLDS for kind in self.kinds]
        for owner, text, linked in self.blocks:
            chars[owner] += len(text)
            links[owner] += linked
            if len(text) < LEAST_PARAGRAPH:
                continue
            worth = (1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)) * (1 - linked / len(text))
            whole[owner] += worth
            node = self.parents[owner] if self.names[owner] in ("p", "pre", "li", "td", "dd", "blockquote") and owner else owner
            for share in LEVELS:
                points[node] += worth * share
                scored[node] = True
                if not node:
                    break
                node = self.parents[node]
        for i in range(n - 1, 0, -1):
            for sums in (chars, links, whole):
                sums[self.parents[i]] += sums[i]
        density = [links[i] / chars[i] if chars[i] else 0.0 for i in range(n)]
        final = [(points[i] + BY_NAME.get(self.names[i], 0.0)) * (1 - density[i]) if scored[i] and chars[i] else float("-inf") for i in range(n)]
        best = max(range(n), key=lambda i: (final[i], -i))
        if final[best] == float("-inf"):
            best = 0
        best = self._gathering(best, whole)
        inside = [False] * n
        for i in [best, *self._like_text(best, final, chars, density)]:
            inside[i : self.ends[i]] = [True] * (self.ends[i] - i)
        for i in range(1, n):
            if self.kinds[i] == LINKED and density[i] > 0.5:
                inside[i : self.ends[i]] = [False] * (self.ends[i] - i)
        return [text for owner, text, _ in self.blocks if inside[owner]]

    def _gathering(self, best: int, whole: list[float]) -> int:
        """The article or main element around the best container, articles first, the outermost of its kind; or the ancestor that gathers more paragraphs."""
        above = []
        node = best
        while node > 0:
            above.append(node)
            node = self.parents[node]
        holders = [i for i in above if self.kinds[i] == HOLDS]
        articles = [i for i in holders if self.names[i] != "main"]
        if holders:
            return (articles or holders)[-1]
        for i in [*above, 0]:
            if whole[i] > 1.2 * whole[best]:
                best = i
        return best

    def _like_text(self, best: int, final: list[float], chars: list[int], density: list[float]) -> list[int]:
        """The best container's siblings that are worth a fifth of it, or hold text that isn't in links."""
        if not best:
            return []
        least = max(10.0, 0.2 * final[best])
        held = self.kinds[best] == HOLDS
        of_page = self.names[self.parents[best]] in ("#root", "html", "body")  # whose short divisions may be anything
        kept = []
        for i in range(1, len(self.names)):
            if self.parents[i] == self.parents[best] and i != best and chars[i]:
                plain = density[i] < 0.25 and (self.names[i] in TEXTUAL or self.names[i] in ("ul", "ol", "dl", "table", "hgroup") or chars[i] > 80 or not of_page)
                if final[i] >= least or plain and not held:
                    kept.append(i)
        return kept


def main_text(html: str | None) -> str:
    if not html:
        return ""
    blocks = Page(html).kept_blocks() or Page(html, drop_noise=False).kept_blocks()
    return "\n".join(blocks)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html, plus text string and n_chars long."""
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    source = pages.select(*kept, F.col(html_col).cast("string").alias(html_col))
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in slices(batches, html_col):
            texts = [main_text(h) for h in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return source.mapInArrow(run, schema)
