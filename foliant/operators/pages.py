"""Pages of placed lines, as a PDF's or a scan's text layer gives them, to paragraphs in reading order.

Input: book, page, line (a number within the page), x, y (of the top, downwards), width, size, text. Sizes and running heads are
matters of a whole book and are votes: partial sums, and windows over one key's pages. What is on one page is decided page by
page, each a row with its lines: gutters are found by the lines that keep clear of them, columns are read one after
the other between lines that cross them, and lines become paragraphs by indents, short ends, gaps and sizes. A
paragraph that a page leaves open goes on on the next page with text; that takes a row a page.

Defined results: lines without text, or with a null place, book or page, are left out; a null size is the body's, which for a book without
sizes is 0, and then nothing is judged by size; lines at one place stay in the order of their numbers; a book of
one page has no furniture that others could show; further columns don't matter; no lines give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .links import written

# How small a note is and how large a heading, to the body's size; how many pages a running head is on, how near others are.
NOTE_SIZE, HEADING_SIZE, OTHER_SIZE = 0.92, 1.2, 1.1
HEAD_SHARE, HEAD_LEAST, NEAR_PAGES, NEAR_LEAST, LONGEST_HEAD = 0.3, 3, 4, 2, 60
# Fixed value: a column this many times as wide as its letters' size is no list of numbers or marks.
NARROW_EMS = 8.0
# Fixed value: a line taken away at most this far above or below a column stood in it.
LEAD_EMS = 2.0
# What begins a note, and what a page's number looks like.
NOTE_MARK = r"^(?:\d{1,3}|\(\d{1,3}\)|\[\d{1,3}\]|[*†‡§¶]{1,3})(?:[\s.)\]]|\p{L})"
PAGE_NUMBER = r"(?i)^[-–—(\[]?\s*(?:page\s+)?(\d{1,4}|[ivxlcdm]{1,6})(?:\s*(?:of|/)\s*\d{1,4})?\s*[-–—)\]]?$"
ENDS = re.compile("[.!?…।:;\"”’')\\]]$")


def placed_lines(lines: DataFrame) -> DataFrame:
    """The lines that count, with their columns in one type."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    cols = [F.col("book").cast("string").alias("book"), *(F.col(c).cast("int").alias(c) for c in ("page", "line")), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "size")), text.alias("text")]
    rows = lines.select(*cols).filter("text <> '' AND x IS NOT NULL AND y IS NOT NULL AND book IS NOT NULL AND page IS NOT NULL")
    return rows.withColumns({"line": F.coalesce("line", F.lit(0)), "width": F.coalesce("width", F.lit(0.0)), "size": F.when(~F.isnan("size") & (F.col("size") > 0), F.col("size"))})


_EDGES = "book string, page int, line int, x double, y double, size double, text string, rounded double, letters long"


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch the two highest and lowest lines of each page, and without a page the letters of each book's sizes."""
    for batch in batches:
        book, page, line, x, y = (batch.column(c) for c in ("book", "page", "line", "x", "y"))
        book = book.dictionary_encode().indices
        order = np.lexsort([c.to_numpy(zero_copy_only=False) for c in (line, x, y, page, book)])
        place = np.stack([book.to_numpy(zero_copy_only=False)[order], page.to_numpy(zero_copy_only=False)[order]])
        first = np.ones(len(order), dtype=bool)
        first[1:] = (place[:, 1:] != place[:, :-1]).any(axis=0)
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(order)))
        down = np.arange(len(order)) - np.repeat(starts, sizes)
        edges = batch.take(pa.array(order[(down < 2) | (down >= np.repeat(sizes, sizes) - 2)]))
        yield edges.set_column(edges.schema.names.index("letters"), "letters", pa.nulls(edges.num_rows, pa.int64()))
        votes = pa.table({c: batch.column(c) for c in ("book", "rounded", "letters")}).filter(batch.column("rounded").is_valid()).group_by(["book", "rounded"]).aggregate([("letters", "sum")]).combine_chunks()
        if votes.num_rows:
            given = {"book": votes["book"], "rounded": votes["rounded"], "letters": votes["letters_sum"]}
            yield pa.table([given[f.name].cast(f.type) if f.name in given else pa.nulls(votes.num_rows, f.type) for f in batch.schema], schema=batch.schema).to_batches()[0]


def edges_and_sizes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, among them each page's two highest and lowest; book, body: the size of most letters, to a tenth; the smaller of equal ones).

    rows are read once; what other lines there are stays in its task, so little of a book is written and dealt.
    """
    asked = rows.select("book", "page", "line", "x", "y", "size", "text", F.round("size", 1).alias("rounded"), F.length("text").cast("long").alias("letters"))
    kept = written(asked.mapInArrow(_at_edges, _EDGES))
    votes = kept.filter("page IS NULL").groupBy("book", F.col("rounded").alias("s")).agg(F.sum("letters").alias("n"))
    return kept.filter("page IS NOT NULL").drop("rounded", "letters"), votes.groupBy("book").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body"))


def edge_key(text: Column) -> Column:
    """What running heads of different pages share: letters, in lower case, single spaces between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def roman_value(text: Column) -> Column:
    """The number that letters i to m spell."""
    values = F.create_map(*(F.lit(v) for pair in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000)) for v in pair))
    digits = F.transform(F.filter(F.split(F.lower(text), ""), lambda c: c != ""), lambda c: values[c])
    signed = F.transform(digits, lambda d, i: F.when(d < F.coalesce(F.get(digits, i + 1), F.lit(0)), -d).otherwise(d))
    return F.aggregate(signed, F.lit(0), lambda s, d: s + d)


def furniture(rows: DataFrame, bodies: DataFrame) -> DataFrame:
    """book, page, line of running heads, running feet and page numbers; of the lines at the edges of pages, others don't matter.

    At a page's edges (its two highest and lowest lines) a number that counts with the pages near it, and words that the
    edges of many pages or of several near ones share: not long, not set large, and not the one
    copy without a number, which is the heading itself.
    """
    on_page = Window.partitionBy("book", "page")  # a page's lines, which are few
    down, up = on_page.orderBy("y", "x", "line"), on_page.orderBy(F.desc("y"), F.desc("x"), F.desc("line"))
    edges = rows.withColumns({"down": F.row_number().over(down), "up": F.row_number().over(up)}).filter("down <= 2 OR up <= 2").drop("down", "up")
    said = F.regexp_extract("text", PAGE_NUMBER, 1)
    roman = F.lower(said).rlike("^[ivxlcdm]+$")
    numbers = edges.withColumn("said", said).filter("said <> ''").withColumns({"roman": roman, "ahead": F.when(roman, roman_value(F.col("said"))).otherwise(F.col("said").try_cast("int")) - F.col("page")})
    counting = Window.partitionBy("book", "roman", "ahead").orderBy("page")
    last, next_ = F.lag("page").over(counting), F.lead("page").over(counting)
    near = lambda other: F.coalesce(F.abs(other - F.col("page")).between(1, NEAR_PAGES), F.lit(False))
    paged = numbers.withColumn("counts", near(last) | near(next_)).filter("counts").select("book", "page", "line")

    keyed = edges.withColumns({"key": edge_key(F.col("text")), "numbered": F.col("text").rlike(r"\p{Nd}")}).filter(F.length("key").between(1, LONGEST_HEAD))
    seen = keyed.groupBy("book", "key", "page").agg(F.max("numbered").alias("numbered"), F.count_if(~F.col("numbered")).alias("bare"))
    around = Window.partitionBy("book", "key").orderBy("page").rangeBetween(-NEAR_PAGES, NEAR_PAGES)
    of_key = Window.partitionBy("book", "key")
    pages = rows.groupBy("book").agg(F.countDistinct("page").alias("pages"))
    shared = seen.withColumns({"near": F.count("*").over(around) - 1, "all": F.count("*").over(of_key), "bare": F.sum("bare").over(of_key), "some_numbered": F.max("numbered").over(of_key)}).drop("numbered").join(pages, "book")
    heads = shared.filter((F.col("all") >= F.greatest(F.lit(HEAD_LEAST), F.ceil(F.col("pages") * HEAD_SHARE))) | (F.col("near") >= NEAR_LEAST))
    found = keyed.join(heads.select("book", "key", "page", "bare", "some_numbered"), ["book", "key", "page"]).join(bodies, "book", "left")
    large = F.coalesce(F.col("size") >= F.col("body") * HEADING_SIZE, F.lit(False))
    own = ~F.col("numbered") & (F.col("bare") == 1) & F.col("some_numbered")
    return paged.unionByName(found.filter(~large & ~own).select("book", "page", "line")).distinct()


# ---- one page


def reach(y: np.ndarray, taken: np.ndarray, em: float) -> tuple[float, float]:
    """Where a column begins and ends, with the lines taken away that stood right above or below."""
    top, bottom = float(y.min()), float(y.max())
    for at in sorted(taken.tolist(), reverse=True):
        top = at if 0 < top - at <= LEAD_EMS * em else top
    for at in sorted(taken.tolist()):
        bottom = at if 0 < at - bottom <= LEAD_EMS * em else bottom
    return top, bottom


def beside(left: tuple[float, float], right: tuple[float, float], several: bool) -> bool:
    """Whether two columns, from where they begin to where they end, are side by side; several: both have more than one line."""
    top, bottom = max(left[0], right[0]), min(left[1], right[1])
    shorter = min(left[1] - left[0], right[1] - right[0])
    return bottom - top >= 0.5 * shorter and bottom >= top and not (several and bottom == top)


NONE_TAKEN = (np.zeros(0), np.zeros(0), np.zeros(0))


def gutter(x0: np.ndarray, x1: np.ndarray, y: np.ndarray, em: float, taken: tuple[np.ndarray, np.ndarray, np.ndarray] = NONE_TAKEN) -> float | None:
    """Where two columns part: a place that most lines keep clear of, with lines side by side on both sides. None for one column.

    taken: x0, x1, y of lines that were taken away as furniture; a column that lost its first line to it still began there.
    """
    if len(x0) < 4:
        return None
    left, right = x0.min(), x1.max()
    best = None
    for at in np.unique(x1):
        over_l, over_r = x1 <= at, x0 >= at + 0.5 * em
        n_l, n_r = int(over_l.sum()), int(over_r.sum())
        crossing = len(x0) - n_l - n_r
        # one line may be the last of a text, at the head of its column; it takes a page of lines that keep clear of it
        least = 1 if n_l + n_r >= max(6, 8 * crossing) else 2
        if min(n_l, n_r) < least or crossing > 0.5 * (n_l + n_r):
            continue
        # numbers and marks beside lines are no column; words in short lines are one, however wide the page
        least_width = min(0.15 * (right - left), NARROW_EMS * em)
        if x1[over_l].max() - x0[over_l].min() < least_width or (n_r > 2 and x1[over_r].max() - x0[over_r].min() < least_width):
            continue
        of_l, of_r = taken[2][taken[1] <= x0[over_r].min()], taken[2][taken[0] >= x1[over_l].max()]
        several = min(n_l, n_r) > 1
        if not any(beside(reach(y[over_l], l, em), reach(y[over_r], r, em), several) for l, r in ((of_l[:0], of_r[:0]), (of_l, of_r))):
            continue
        score = (n_l + n_r - 2 * crossing, x0[over_r].min() - x1[over_l].max())
        if best is None or score > best[0]:
            best = (score, (x1[over_l].max() + x0[over_r].min()) / 2)
    return None if best is None else float(best[1])


def read_order(x0: np.ndarray, x1: np.ndarray, y: np.ndarray, size: np.ndarray, taken: tuple[np.ndarray, np.ndarray, np.ndarray] = NONE_TAKEN) -> list[list[int]]:
    """The lines of each column, one column after the other, in the order in which they are read; taken as of `gutter`."""
    em = float(np.median(size)) if len(size) and np.median(size) > 0 else 10.0
    out: list[list[int]] = []

    def by_row(of: np.ndarray) -> list[int]:
        """From the top down; lines that begin within a third of a line of the first of a row are one row, read from the left."""
        rows: list[list[int]] = []
        for i in of[np.lexsort((of, x0[of], y[of]))].tolist():
            if rows and y[i] - y[rows[-1][0]] <= em / 3:
                rows[-1].append(i)
            else:
                rows.append([i])
        return [i for r in rows for i in sorted(r, key=lambda i: (x0[i], i))]

    def read(of: np.ndarray) -> None:
        at = gutter(x0[of], x1[of], y[of], em, taken)
        if at is None:
            if len(of):
                out.append(by_row(of))
            return
        left: list[int] = []
        right: list[int] = []
        wide: list[int] = []

        def flush() -> None:
            if wide:
                out.append(by_row(np.array(wide)))
            for side in (left, right):
                if side:
                    read(np.array(side))
            wide.clear(), left.clear(), right.clear()

        for i in by_row(of):
            if x1[i] <= at:
                left.append(i)
            elif x0[i] >= at:
                right.append(i)
            else:
                if left or right:
                    flush()
                wide.append(i)
        flush()

    read(np.arange(len(x0)))
    return out


def paragraph_starts(columns: list[list[int]], x0: np.ndarray, x1: np.ndarray, y: np.ndarray, size: np.ndarray, texts: list[str]) -> list[tuple[int, bool]]:
    """(line, whether it begins a paragraph) in reading order; of a page's first line it is whether it looks like one."""
    out: list[tuple[int, bool]] = []
    before: int | None = None
    for lines in columns:
        em = float(np.median(size[lines])) or 10.0
        margin, edge = float(x0[lines].min()), float(x1[lines].max())
        steps = np.diff(y[lines])
        usual = float(np.median(steps[steps > 0])) if (steps > 0).any() else 0.0
        for k, i in enumerate(lines):
            indented = 0.8 * em <= x0[i] - margin <= 6 * em
            if before is None:
                starts = indented
            else:
                ended = ENDS.search(texts[before]) is not None
                other = size[i] > 0 and size[before] > 0 and max(size[i], size[before]) >= OTHER_SIZE * min(size[i], size[before])
                if k == 0:  # a column goes on where the last one ended
                    starts = other or (ended and indented)
                else:
                    gap = usual > 0 and y[i] - y[before] > 1.5 * usual
                    short = x1[before] < edge - 2 * em
                    starts = other or gap or (ended and ((indented and x0[i] - x0[before] >= 0.8 * em) or short))
            out.append((i, bool(starts)))
            before = i
    return out


def joined(lines: Column) -> Column:
    """Lines as one text: a word parted at a line's end is whole again, other ends are spaces."""
    return F.replace(F.regexp_replace(F.array_join(lines, "\n"), r"(?<=\p{L})[-\x{AD}\x{2010}]\n(?=\p{Ll})", ""), F.lit("\n"), F.lit(" "))


def _pages(rows: DataFrame) -> DataFrame:
    """book, page, line, seq, par (a paragraph's number in the page), starts, text, size: the page's text in reading order. rows say which lines are taken."""
    line = F.struct("line", "x", "y", "width", "size", "text", "taken")
    held = rows.groupBy("book", "page").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # a page's lines, which are few

    def run(batches):
        for batch in batches:
            out = []
            for book, page, placed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines, away = [r for r in placed if not r["taken"]], [r for r in placed if r["taken"]]
                taken = (np.array([r["x"] for r in away]), np.array([r["x"] + r["width"] for r in away]), np.array([r["y"] for r in away])) if away else NONE_TAKEN
                x0 = np.array([r["x"] for r in lines])
                x1 = x0 + np.array([r["width"] for r in lines])
                y, size, texts = np.array([r["y"] for r in lines]), np.array([r["size"] or 0.0 for r in lines]), [r["text"] for r in lines]
                par = 0
                for seq, (i, starts) in enumerate(paragraph_starts(read_order(x0, x1, y, size, taken), x0, x1, y, size, texts)):
                    par += starts and seq > 0
                    out.append((book, page, lines[i]["line"], seq, par, starts, texts[i], size[i]))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.float64()]
            names = ["book", "page", "line", "seq", "par", "starts", "text", "size"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return held.select("book", "page", "lines").mapInArrow(run, "book string, page int, line int, seq int, par int, starts boolean, text string, size double")


def footnotes(rows: DataFrame) -> DataFrame:
    """book, page, line, note (its number in the page): the lowest lines of a page, all small, from one that begins with a mark on. rows carry body."""
    up = Window.partitionBy("book", "page").orderBy(F.desc("y"), F.desc("x"), F.desc("line"))  # a page's lines, which are few
    on_page = Window.partitionBy("book", "page")
    small = F.coalesce(F.col("size") < F.col("body") * NOTE_SIZE, F.lit(False))
    foot = rows.withColumn("foot", F.min(small).over(up)).withColumn("all", F.min("foot").over(on_page)).filter("foot AND NOT all")
    down = Window.partitionBy("book", "page").orderBy("y", "x", "line")
    marked = F.col("text").rlike(NOTE_MARK)
    return foot.withColumns({"note": F.sum(marked.cast("int")).over(down), "first": F.first(marked).over(down)}).filter("first").select("book", "page", "line", F.col("note").cast("int").alias("note"), "y", "x", "text")


def _found(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the furniture; book, page, body, gone: a row a page, with its body's size and the lines that are furniture)."""
    edges, bodies = edges_and_sizes(rows)
    gone = written(furniture(edges, bodies))
    by_page = gone.groupBy("book", "page").agg(F.collect_set("line").alias("gone"))
    return gone, edges.select("book", "page").distinct().join(bodies, "book", "left").join(by_page, ["book", "page"], "left")


def _rest(rows: DataFrame, by_page: DataFrame) -> DataFrame:
    """The lines that are no furniture, with their body's size; dealt by page once, which notes and reading go on with."""
    return rows.join(written(by_page), ["book", "page"]).filter("gone IS NULL OR NOT array_contains(gone, line)").drop("gone")


def _noted(notes: DataFrame) -> DataFrame:
    return notes.groupBy("book", "page", "note").agg(F.array_sort(F.collect_list(F.struct("y", "x", "line", "text"))).alias("l")).select("book", "page", "note", joined(F.col("l.text")).alias("text"))


def page_notes(lines: DataFrame) -> DataFrame:
    """book, page, note, text: the notes alone; pages aren't read, and lines are read twice rather than written."""
    rows = placed_lines(lines)
    return _noted(written(footnotes(_rest(rows, _found(rows)[1]))))


def page_furniture(lines: DataFrame) -> DataFrame:
    """book, page, line of the furniture alone; pages aren't read."""
    return _found(placed_lines(lines))[0]


def paragraphs(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(book, page, par, text, size of paragraphs, by the page that they begin on; book, page, note, text of notes; book, page, line, text of what was left out)."""
    rows = written(placed_lines(lines))
    gone, by_page = _found(rows)
    rest = written(_rest(rows, by_page))
    notes = written(footnotes(rest))
    read = rest.join(notes.select("book", "page", "line"), ["book", "page", "line"], "left_anti").drop("body").withColumn("taken", F.lit(False))
    taken = rows.join(gone, ["book", "page", "line"], "left_semi")
    text = written(_pages(read.unionByName(taken.withColumn("taken", F.lit(True)))))

    # a row a page: whether its first line goes on with what the page before left open
    ends = text.groupBy("book", "page").agg(F.max_by("text", "seq").alias("last"), F.min_by("starts", "seq").alias("starts"), F.min_by("size", "seq").alias("first_size"), F.max_by("size", "seq").alias("last_size"), F.max("par").alias("pars"))
    in_book = Window.partitionBy("book").orderBy("page")
    open_ = ~F.lag("last").over(in_book).rlike(ENDS.pattern)
    alike = F.greatest("first_size", F.lag("last_size").over(in_book)) < OTHER_SIZE * F.least("first_size", F.lag("last_size").over(in_book))
    sized = (F.least("first_size", F.lag("last_size").over(in_book)) <= 0) | alike
    goes_on = F.coalesce(open_ & ~F.col("starts") & sized, F.lit(False))
    # a page that begins a paragraph of its own, or has more than one, is where a later page's first one may have begun
    holds = F.when(~F.col("goes_on") | (F.col("pars") > 0), F.struct("page", F.col("pars").alias("par")))
    begun = ends.withColumn("goes_on", goes_on).withColumn("holds", holds)
    origin = F.last("holds", ignorenulls=True).over(in_book.rowsBetween(Window.unboundedPreceding, -1))
    first = begun.select("book", "page", F.when(F.col("goes_on"), origin).alias("origin"))
    placed = text.join(first, ["book", "page"]).withColumn("to", F.when((F.col("par") == 0) & F.col("origin").isNotNull(), F.col("origin")).otherwise(F.struct("page", "par")))
    whole = placed.groupBy("book", F.col("to.page").alias("at_page"), F.col("to.par").alias("par")).agg(F.array_sort(F.collect_list(F.struct("page", "seq", "text"))).alias("l"), F.max("size").alias("size"))
    made = whole.select("book", F.col("at_page").alias("page"), "par", joined(F.col("l.text")).alias("text"), "size")
    return made, _noted(notes), taken.select("book", "page", "line", "text")
