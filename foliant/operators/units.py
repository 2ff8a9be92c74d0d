"""Reading units: sentences of texts as rows, sections, and chunks of them for an index.

Sentences end at stops; what follows an abbreviation, an initial or a decimal point doesn't
begin one. Finding the bounds is a fold over a text, so it runs in Python, a text at a time; sentences
and chunks are cut out where the bounds are found, as rows of a bounded number of characters at once.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_space
from ..session import small_batches

HARD = "।॥。！？؟۔"
SOFT = ".!?…"
CLOSERS = "\"')]}»”’"
# Abbreviations before a name, and those inside a sentence.
TITLES = frozenset("mr mrs ms dr prof st capt col gen lt rev hon sgt messrs mme mlle sr sra hr fr".split())
INNER = frozenset("e.g i.e etc vs cf al no vol pp fig ed approx bzw z.b usw p.ej".split())
LONGEST = 280
CHUNK_CHARS, CHUNK_UNITS = 420, 5


def _ends(text: str, at: int) -> int:
    """Where the stops and closing marks from `at` on end."""
    while at < len(text) and text[at] in SOFT + HARD:
        at += 1
    while at < len(text) and text[at] in CLOSERS:
        at += 1
    return at


def sentence_bounds(text: str, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, end) of sentences, trimmed; long ones are cut at clauses."""
    cuts, at, start = [], 0, 0
    for m in re.finditer(rf"[{re.escape(SOFT + HARD)}]|\n+", text):
        if m.start() < at:
            continue
        if m[0][0] == "\n":
            cuts.append((start, m.start()))
            start = at = m.end()
            continue
        end = _ends(text, m.start())
        at = end
        if text[m.start()] in HARD:
            cuts.append((start, end))
            start = end
            continue
        follows = text[end : end + 2].lstrip()
        if end < len(text) and not text[end].isspace():
            continue
        if text[m.start() : end].startswith("."):
            word = re.search(r"([^\s]*)$", text[start : m.start()])[1].lower().lstrip("(\"'“‘")
            if word in TITLES or word in INNER or len(word) == 1 and word.isalpha():
                continue
        if follows[:1].islower():
            continue
        cuts.append((start, end))
        start = end
    cuts.append((start, len(text)))
    out = []
    for a, b in cuts:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        while b - a > longest:
            clause = [m.end() for m in re.finditer(r"[,;:—] ", text[a : a + longest])]
            space = text.rfind(" ", a + 1, a + longest)
            cut = a + clause[-1] if clause else space + 1 if space > a else a + longest
            out.append((a, a + len(text[a:cut].rstrip())))
            a = cut
        if b > a:
            out.append((a, b))
    return out


# Words for a chapter, and numbers that may follow or precede them.
_CHAPTER = "chapter|kapitel|chapitre|cap[ií]tulo|capitolo|hoofdstuk|rozdzia[łl]|глава|part|teil|partie|parte|book|buch|livre|libro|volume|band|tome|episode|act|akt"
_COUNT = r"\d+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|eins|zwei|drei|vier|un|deux|trois|uno|dos|tres"
CHAPTER_LINE = rf"(?i)^(?:(?:{_CHAPTER})\s+(?:{_COUNT})(?![\p{{L}}\p{{N}}])|(?:prologue|epilogue|prolog|epilog|interlude|afterword|foreword|vorwort|nachwort)(?![\p{{L}}\p{{N}}])|第\s*[\d零一二三四五六七八九十百千]+\s*[章回节話话])"
_PYTHON_LINE = re.compile(CHAPTER_LINE.replace(r"[\p{L}\p{N}]", r"[^\W_]"))
_PROSE = r"[.!?]\s*\S+\s+\S+\s+\S+"
LONGEST_LINE, SHORT_LINE = 90, 40


def looks_like_chapter_line(c: Column) -> Column:
    """A short line that names a chapter and doesn't go on as prose."""
    t = F.trim(c)
    return (F.length(t) <= LONGEST_LINE) & t.rlike(CHAPTER_LINE) & (~t.rlike(_PROSE) | (F.length(t) < SHORT_LINE))


def chapter_line(line: str) -> bool:
    t = line.strip()
    return len(t) <= LONGEST_LINE and bool(_PYTHON_LINE.search(t)) and (len(t) < SHORT_LINE or not re.search(_PROSE, t))


def chunk_bounds(sizes: list[int], most_chars: int = CHUNK_CHARS, most_units: int = CHUNK_UNITS, sections: list[int] | None = None) -> list[int]:
    """The chunk of each unit: one ends before a unit of another section, or once it has most_chars characters or most_units units."""
    out, chunk, chars, units = [], 0, 0, 0
    for i, n in enumerate(sizes):
        turned = bool(sections) and i > 0 and sections[i] != sections[i - 1]
        if units and (turned or chars >= most_chars or units >= most_units):
            chunk, chars, units = chunk + 1, 0, 0
        out.append(chunk)
        chars, units = chars + n + bool(units), units + 1  # joined by a space
    return out


def _layout(text: str) -> list[tuple[int, int, int, int, int, int]]:
    """(start, end, section, block, sentence, chunk) of a text's sentences; blocks are lines, and a line that names a chapter begins a section."""
    bounds = sentence_bounds(text)
    places, sec, blk, sen, begin = [], 0, 0, 0, 0
    for a, b in bounds:
        if "\n" in text[begin:a]:
            blk, sen = blk + 1, 0
        if not sen and chapter_line(text[a:b]):
            sec += 1
        places.append((sec, blk, sen))
        sen, begin = sen + 1, b
    chunks = chunk_bounds([b - a for a, b in bounds], sections=[p[0] for p in places])
    return [(a, b, *p, c) for (a, b), p, c in zip(bounds, places, chunks, strict=True)]


#: Characters of the rows that a worker hands on at once, about; a text's rows aren't parted.
HANDED = 1_000_000


def _cut(batches, rows_of, schema: pa.Schema):
    """Arrow batches of the rows that each (id, text) has, of HANDED characters of texts."""
    rows, chars = [], 0
    for batch in batches:
        for key, text in zip(batch.column("id"), batch.column("text"), strict=True):
            text = text.as_py() or ""
            rows += ((key.as_py(), *r) for r in rows_of(text))
            chars += len(text)
            if chars >= HANDED:
                yield _as_batch(rows, schema)
                rows, chars = [], 0
    if rows:
        yield _as_batch(rows, schema)


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _unit_rows(text: str):
    return ((sec, blk, sen, a, b, text[a:b], chunk) for a, b, sec, blk, sen, chunk in _layout(text))


def _chunk_rows(text: str):
    last = None
    for a, b, sec, _, _, chunk in _layout(text):
        if last and last[0] == chunk:
            last = (*last[:3], b)
        else:
            if last:
                yield (*last, text[last[2] : last[3]])
            last = (chunk, sec, a, b)
    if last:
        yield (*last, text[last[2] : last[3]])


def _ints(*names: str) -> list[pa.Field]:
    return [pa.field(n, pa.int32()) for n in names]


_UNIT = pa.schema([pa.field("id", pa.int64()), *_ints("sec", "blk", "sen", "start", "end"), pa.field("text", pa.string()), *_ints("chunk")])
_CHUNK = pa.schema([pa.field("id", pa.int64()), *_ints("chunk", "sec", "start", "end"), pa.field("body", pa.string())])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sec, blk, sen, start, end, text, chunk: a row a sentence; chunks run through the text."""
    cut = lambda batches: _cut(batches, _unit_rows, _UNIT)
    return _rows(docs, id_col, text_col).mapInArrow(cut, "id long, sec int, blk int, sen int, start int, end int, text string, chunk int")


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk, sec, start, end, body: stretches of a text, cut out of it; no sentence is a row, nothing is put together again."""
    cut = lambda batches: _cut(batches, _chunk_rows, _CHUNK)
    rows = _rows(docs, id_col, text_col).mapInArrow(cut, "id long, chunk int, sec int, start int, end int, body string")
    return rows.withColumn("body", collapse_space(F.col("body")))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sec, title, start, words: a text's sections, each from a line that names a chapter (the first from the begin) to the next; without SQL windows over texts, as lines stay in their row."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.posexplode(lines).alias("n", "line"))
    by = Window.partitionBy("id").orderBy("n")
    titled = looks_like_chapter_line(F.col("line"))
    numbered = rows.withColumn("sec", F.count_if(titled).over(by)).withColumn("titled", titled)
    grouped = numbered.groupBy("id", "sec").agg(F.min_by("line", "n").alias("head"), F.max(F.struct(-F.col("n"), F.col("titled"))).alias("first"), F.min("n").alias("start"), F.sum(F.size(F.filter(F.split(F.trim("line"), r"\s+"), lambda w: w != ""))).cast("long").alias("words"))
    return grouped.select("id", F.col("sec").cast("int").alias("sec"), F.when(F.col("first.titled"), F.trim("head")).alias("title"), "start", "words")


def words_before(unit_rows: DataFrame, words: str) -> DataFrame:
    """unit_rows with `before`: the words ahead of each unit in its text."""
    order = Window.partitionBy("id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return unit_rows.withColumn("before", F.coalesce(F.sum(words).over(order), F.lit(0)))
