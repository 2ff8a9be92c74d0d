"""How a text is said: words, what isn't read out as written, a reader's own spellings, stretches left out. Offsets are code points."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WIDE = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_WIDE_MARKS = "　-〿＀-￯"
_WORDS = re.compile(rf"[{_WIDE}][{_WIDE_MARKS}]*|[^\s{_WIDE}]+")
#: What claims its characters first.
HINTS = [
    ("email", re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")),
    ("url", re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+|(?<![\w.@])(?:[a-z0-9-]+\.)+(?:com|net|org|io|co|me|info|edu|gov)(?:/[^\s<>\"')\]]*)?(?![\w.])", re.I)),
    ("citation", re.compile(r"\[\d+(?:\s*[,–-]\s*\d+)*\]")),
    ("symbols", re.compile(r"(?m)^[^\w\n]*[*=_~#•·–—-][^\w\n]*$")),
]
SPANS = "array<struct<start:int,end:int>>"
#: Rules that a reader's lists may hold together; they go to every task.
MOST_RULES = 20_000


def word_spans(text: Column) -> Column:
    """array<struct<start, end>> of words; Han and kana are one each, with the marks behind them."""

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": m.start(), "end": m.end()} for m in _WORDS.finditer(t or "")])

    return found(text)


def hints_in(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of addresses, links, citations and rows of symbols, in order; none overlap."""
    out: list[tuple[int, int, str]] = []
    for kind, pattern in HINTS:
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end() > m.start() and not any(m.start() < b and a < m.end() for a, b, _ in out)]
    return sorted(out)


def speech_hints(text: Column) -> Column:
    """array<struct<start, end, kind>>."""

    @F.pandas_udf("array<struct<start:int,end:int,kind:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "kind": k} for a, b, k in hints_in(t or "")])

    return found(text)


def said(text: str, rules: list[tuple[str, str, re.Pattern]]) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The text with words replaced, and (start, end there, start, end here) of each change. rules come longest first; a place belongs to the first that takes it."""
    hits: list[tuple[int, int, str]] = []
    for _, to, pattern in rules:
        hits += [(m.start(), m.end(), to) for m in pattern.finditer(text) if not any(m.start() < b and a < m.end() for a, b, _ in hits)]
    out, changes, at = "", [], 0
    for a, b, to in sorted(hits):
        out += text[at:a]
        changes.append((len(out), len(out) + len(to), a, b))
        out += to
        at = b
    return out + text[at:], changes


def respelled(docs: DataFrame, text_col: str, rules: DataFrame) -> DataFrame:
    """docs with `said` and `changes`. rules(word, say, ordinal): whole words in any case, the longest first, then by ordinal."""
    rows = rules.select("word", "say", "ordinal").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    ordered = [(r["word"], r["say"]) for r in sorted(rows, key=lambda r: (-len(r["word"]), r["ordinal"])) if r["word"]]

    @F.pandas_udf("struct<said:string,changes:array<struct<start:int,end:int,from:int,to:int>>>")
    def spoken(texts: pd.Series) -> pd.DataFrame:
        made = [(w, s, re.compile(rf"(?<![^\W_]){re.escape(w)}(?![^\W_])", re.I)) for w, s in ordered]
        out = [said(t or "", made) for t in texts]
        return pd.DataFrame({"said": [x[0] for x in out], "changes": [[dict(zip(("start", "end", "from", "to"), c, strict=True)) for c in x[1]] for x in out]})

    return docs.withColumn("_s", spoken(F.col(text_col))).select(*docs.columns, "_s.said", "_s.changes")


def without_spans(text: Column, spans: Column) -> Column:
    """The text without stretches that are in order and don't overlap, as merged_intervals gives them."""
    end = F.length(text)
    begun = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"])).alias("out"), x["end"].alias("at")),
    )
    return F.concat(begun["out"], F.substring(text, begun["at"] + 1, end))


# How lines begin that a translator or author adds to a chapter.
NOTE = r"(?i)^\W*(?:(?:author|translator|editor|a|t|tl|ed)(?:['’]?s)?[ /]?(?:note|n)s?|tl note|t/n|a/n)\b\s*[:\-–]"


def quiet_lines(text: Column, title: Column) -> Column:
    """array<boolean> by line: notes, rows of symbols, and the chapter's title said again."""
    same = lambda a: F.regexp_replace(F.lower(a), r"[^\p{L}\p{N}]+", "")
    return F.transform(F.split(text, "\n"), lambda line: line.rlike(NOTE) | (~line.rlike(r"[\p{L}\p{N}]") & (F.trim(line) != "")) | ((same(line) != "") & (same(line) == same(F.coalesce(title, F.lit(""))))))
