"""Plain text as paragraphs: wrapped lines are joined, words broken at a line's end made whole.

A text's shape decides how: with blank lines, they part paragraphs; without, an indented line
begins one, or else every line is its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Share of lines that must be indented for indents to mean paragraphs.
INDENTED = 0.05
_START = re.compile(r"^\*{3} ?START OF (?:THE|THIS) PROJECT [^\n]*\n", re.M | re.I)
_END = re.compile(r"^\*{3} ?END OF (?:THE|THIS) PROJECT [^\n]*$", re.M | re.I)


def joined(lines: list[str]) -> str:
    """Lines of a paragraph as one; a hyphen between lower-case letters at a line's end is taken out."""
    out = ""
    for line in (x.strip() for x in lines):
        if not line:
            continue
        if out.endswith("-") and len(out) > 1 and out[-2].islower() and line[0].islower():
            out = out[:-1] + line
        else:
            out = f"{out} {line}" if out else line
    return out


def body_of(text: str) -> str:
    """The text between the marks of a licence, if it has them."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    start, end = _START.search(text), _END.search(text)
    at = start.end() if start else 0
    return text[at : end.start() if end and end.start() > at else len(text)]


def paragraphs(text: str) -> list[str]:
    text = body_of(text)
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    if re.search(r"\n[ \t]*\n", text.strip()):
        blocks = [b.split("\n") for b in re.split(r"\n(?:[ \t]*\n)+", text)]
    elif full and sum(x[0] in " \t" for x in full) >= max(1, INDENTED * len(full)):
        blocks = [[]]
        for x in full:
            if x[0] in " \t" and blocks[-1]:
                blocks.append([])
            blocks[-1].append(x)
    else:
        blocks = [[x] for x in full]
    return [p for p in map(joined, blocks) if p]


def paragraph_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, paragraph, text; a null text has no rows."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, n, p) for doc, text in batch.itertuples(index=False) for n, p in enumerate(paragraphs(text or ""))]
            yield pd.DataFrame(rows, columns=["id", "paragraph", "text"]).astype({"paragraph": "int32"})

    return docs.select(id_col, text_col).mapInPandas(run, f"id {kind}, paragraph int, text string")
