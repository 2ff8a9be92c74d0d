"""Speech in quotation marks, apart from what is told around it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Opening marks and what closes them.
PAIRS = {"“": "”", "«": "»", "„": "“", "「": "」", "『": "』", '"': '"'}
CLOSE_ONLY = "”»」』"


def begins_inside(text: str) -> bool:
    """Whether a paragraph closes a quotation that it never opened."""
    closes = min((i for c in CLOSE_ONLY if (i := text.find(c)) >= 0), default=-1)
    opens = min((i for c in PAIRS if (i := text.find(c)) >= 0), default=-1)
    return closes >= 0 and (opens < 0 or closes < opens)


def quotations(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, closed) of a paragraph's quotations, marks included; one left open runs to the end, if it says anything."""
    found, waits = split_dialogue(text)
    out = [(a, b, not (waits and b == len(text))) for a, b, spoken in found if spoken]
    return [q for q in out if q[2] or len(text[q[0] : q[1]].strip()) > 1]


def split_dialogue(text: str, inside: str = "") -> tuple[list[tuple[int, int, bool]], str]:
    """(start, end, spoken) stretches of a paragraph, and the mark that its last quotation still waits for.

    inside: the mark that the paragraph before has left open. Marks belong to the speech.
    """
    out: list[tuple[int, int, bool]] = []
    start, waits = 0, inside
    if not waits and begins_inside(text):
        waits = next(c for c in text if c in CLOSE_ONLY)
    for i, c in enumerate(text):
        if waits:
            if c == waits:
                out.append((start, i + 1, True))
                start, waits = i + 1, ""
        elif c in PAIRS:
            if i > start:
                out.append((start, i, False))
            start, waits = i, PAIRS[c]
    if start < len(text):
        out.append((start, len(text), bool(waits)))
    return out, waits


def dialogue(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, paragraph, start, end, spoken; a quotation may go on over paragraphs of one text."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in batch.itertuples(index=False):
                waits = ""
                for n, paragraph in enumerate((text or "").split("\n")):
                    found, waits = split_dialogue(paragraph, waits)
                    rows += [(doc, n, a, b, s) for a, b, s in found]
            yield pd.DataFrame(rows, columns=["id", "paragraph", "start", "end", "spoken"]).astype({"paragraph": "int32", "start": "int32", "end": "int32"})

    return docs.select(id_col, text_col).mapInPandas(run, f"id {kind}, paragraph int, start int, end int, spoken boolean")


def quotation_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, paragraph, start, end, closed: the quotations of each paragraph, by itself."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, n, a, b, c) for doc, text in batch.itertuples(index=False) for n, p in enumerate((text or "").split("\n")) for a, b, c in quotations(p)]
            yield pd.DataFrame(rows, columns=["id", "paragraph", "start", "end", "closed"]).astype({"paragraph": "int32", "start": "int32", "end": "int32"})

    return docs.select(id_col, text_col).mapInPandas(run, f"id {kind}, paragraph int, start int, end int, closed boolean")
