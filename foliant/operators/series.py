"""Series of books, found in titles: in one alone, or in the words that several share.

A place in a series is a number after a word that says so ("Book 3", "Part IV", "#1"), or a bare number up
to 30. `from_title` reads a title alone; `across` takes a library together: a title is in the series of the
longest run of words before a place that another title has too, not all at one place, or that names a
series known already; else in the one that it names alone.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MARKED, PLAIN

# Words before a place, numbers as words, and the little words that don't name a series alone.
MARKERS = frozenset("book bk bk. vol vol. volume part pt. no. number tome episode #".split())
NUMBERS = {w: i + 1 for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split())}
JOINING = frozenset("of and & or in on at to for with by from into de del des du et und".split())
ARTICLES = frozenset("the a an der die das le la les el los las il lo un una une ein eine".split())
MOST_BARE, MOST_ROMAN = 30, 399
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}

# The patterns of a place in a series, of what is in brackets, and of words.
_PLACE = r"\d{1,4}(?:\.\d+)?|[ivxlc]+|" + "|".join(NUMBERS)
_MARKED = re.compile(r"(?i)^(.*?\S)[\s,:;.–—-]*(?:\b(?:book|bk\.?|vol\.?|volume|part|pt\.|no\.|number|tome|episode)\s*|#\s*)(" + _PLACE + ")$")
_BARE = re.compile(r"^(.*\S)\s+(\d{1,2})$")
_BRACKETED = re.compile(r"\S\s*[(\[]\s*([^()\[\]]+?)\s*[)\]]$")
_TOKEN = re.compile(r"#|[^\s#,:;/|()\[\]{}]+")
_FOLDED = str.maketrans(MARKED, PLAIN)


def _tidy(name: str) -> str:
    return " ".join(re.sub(r"^[\s,:;.–—-]+|[\s,:;.–—-]+$", "", name).split())


def roman(word: str) -> int | None:
    """A numeral's value, if it is one as people write them."""
    units = [ROMAN.get(c, 0) for c in word]
    total = sum(-a if a < b else a for a, b in zip(units, [*units[1:], 0], strict=False))
    if not 0 < total <= MOST_ROMAN:
        return None
    tens = "".join(("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc")[total // 10 % 10])
    ones = ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")[total % 10]
    return total if "c" * (total // 100) + tens + ones == word else None


def place_of(word: str) -> float | None:
    word = word.lower()
    if word in NUMBERS:
        return float(NUMBERS[word])
    if re.fullmatch("[ivxlc]+", word):
        value = roman(word)
        return None if value is None else float(value)
    return float(word) if re.fullmatch(r"\d{1,4}(?:\.\d+)?", word) else None


def _named(text: str) -> tuple[str, float] | None:
    m = _MARKED.match(text)
    if m:
        place, name = place_of(m[2]), _tidy(m[1])
        if place is not None and any(c.isalpha() for c in name):
            return name, place
    m = _BARE.match(text)
    if not m:
        return None
    name, n = _tidy(m[1]), int(m[2])
    good = 1 <= n <= MOST_BARE and len(name.split(" ")) >= 2 and any(c.isalpha() for c in name)
    return (name, float(n)) if good else None


def alone(title: str | None) -> tuple[str, float] | None:
    """The series that a title names by itself, and the place in it."""
    t = (title or "").strip()
    m = _BRACKETED.search(t)
    return (m and _named(m[1])) or _named(t) if t else None


def _words(text: str) -> list[tuple[str, str, int, int]]:
    """(as compared, as written in small letters, from, to) of a title's words."""
    out = []
    for m in _TOKEN.finditer(text):
        low = m[0].lower()
        raw = low.translate(_FOLDED) if len(low) == len(m[0]) else m[0]
        key = raw.strip("\"'.!?*«»")
        if key in ("#", "&") or any(c.isalnum() for c in key):
            out.append((key, raw, m.start(), m.end()))
    return out


def _little(key: str) -> bool:
    return key in JOINING or key in ARTICLES


def runs(title: str | None) -> list[tuple[str, float, int, str]]:
    """(run of words, place, number of words, as the title writes it) of all runs before places that could name a series."""
    text = (title or "").strip()
    words = _words(text)
    out = []
    for n in range(1, len(words)):
        place, end = None, n
        if words[n - 1][1] in MARKERS and re.fullmatch(_PLACE, words[n][0]):
            place, end = place_of(words[n][0]), n - 1
        if place is None:
            end = n
            place = float(words[n][0]) if re.fullmatch(r"[0-9]{1,2}", words[n][0]) and 1 <= int(words[n][0]) <= MOST_BARE else None
        if place is None or not end or _little(words[end - 1][0]):
            continue
        for start in range(end - 2, -1, -1):
            keys = [w[0] for w in words[start:end]]
            if keys[0] in JOINING or start and _little(words[start - 1][0]):
                continue
            if any(not _little(k) and any(c.isalpha() for c in k) for k in keys):
                out.append((" ".join(keys), place, end - start, _tidy(re.sub(r"[()\[\]{}]", " ", text[words[start][2] : words[end - 1][3]]))))
    return out


def from_title(books: DataFrame, id_col: str, title_col: str) -> DataFrame:
    """id, series, place: null for titles that name none alone."""

    def read(batches):
        for batch in batches:
            found = [alone(t) or (None, None) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[id_col, "series", "place"])

    kind = books.schema[id_col].dataType.simpleString()
    return books.select(id_col, F.col(title_col).cast("string")).mapInArrow(read, f"{id_col} {kind}, series string, place double")


def across(books: DataFrame, id_col: str, title_col: str, known: DataFrame | None = None) -> DataFrame:
    """id, series, place of all books taken together. known(name): series that books are in already.

    A series is spelled as known ones are, else as most of its titles spell it, ties in order. Runs meet by a
    shuffle on their words; a run that very many titles share is counted in partial sums before it.
    """

    def cut(batches):
        for batch in batches:
            rows = [(i, *r) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in runs(t)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (batch.column(0).type, pa.string(), pa.float64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[id_col, "run", "place", "words", "spelling"])

    kind = books.schema[id_col].dataType.simpleString()
    every = books.select(id_col, F.col(title_col).cast("string")).mapInArrow(cut, f"{id_col} {kind}, run string, place double, words int, spelling string")
    names = known if known is not None else books.sparkSession.createDataFrame([], "name string")

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(w[0] for w in _words(x or "")) for x in batch.column(0).to_pylist()], pa.string())], names=["spelling", "run"])

    spelled = names.select(F.col("name").alias("spelling")).mapInArrow(keyed, "spelling string, run string").filter("run <> ''")
    common = Window.partitionBy("run").orderBy(F.desc("n"), "spelling")
    by_known = spelled.groupBy("run", "spelling").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(common)).filter("r = 1").select("run", F.col("spelling").alias("known"))
    shared = every.groupBy("run").agg(F.min(id_col).alias("a"), F.max(id_col).alias("b"), F.min("place").alias("p"), F.max("place").alias("q"))
    shared = shared.filter((F.col("a") != F.col("b")) & (F.col("p") != F.col("q"))).select("run")
    as_most = every.groupBy("run", "spelling").agg(F.countDistinct(id_col).alias("n")).withColumn("r", F.row_number().over(common)).filter("r = 1").select("run", F.col("spelling").alias("most"))
    naming = shared.join(as_most, "run").join(by_known, "run", "full_outer").select("run", F.coalesce("known", "most").alias("series"))
    # the longest run, of equal ones the first in the title: the least place in it is told by the order of words
    best = every.join(naming, "run").groupBy(id_col).agg(F.max_by(F.struct("series", "place"), F.struct("words", F.col("run"), F.col("place"))).alias("x"))
    single = from_title(books, id_col, title_col).select(id_col, F.col("series").alias("s"), F.col("place").alias("p"))
    return single.join(best, id_col, "left").select(id_col, F.coalesce("x.series", "s").alias("series"), F.coalesce("x.place", "p").alias("place"))
