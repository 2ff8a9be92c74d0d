"""Page layout on generated books, whose order, notes, heads and paragraphs are known."""

import random

import numpy as np
import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import pages

KIND = "book string, page int, line int, x double, y double, width double, size double, text string"
WORDS = "river stone garden letter window harbour evening morning silver lantern bridge winter".split()


def sentence(r):
    return " ".join(r.choices(WORDS, k=r.randint(4, 14))).capitalize() + r.choice([".", "!", "?", ".”"])


def set_lines(r, paras, chars):
    """(text, indent, last of its paragraph) of lines of at most so many characters."""
    out = []
    for p in paras:
        lines, now = [], ""
        for w in p.split():
            if now and len(now) + 1 + len(w) > chars - (3 if not lines else 0):
                lines.append(now)
                now = w
            else:
                now = f"{now} {w}".strip()
        lines.append(now)
        out += [(t, not i, i == len(lines) - 1) for i, t in enumerate(lines)]
    return out


def page_of(r, columns, em=10.0):
    """(x0, x1, y, size) of lines in the order in which they are read, some with a wide heading between."""
    chars = {1: 70, 2: 32, 3: 20}[columns]
    wide, gap, lead = chars * 5.0, 20.0, 12.0
    y, out = 80.0, []
    for band in range(r.randint(1, 2)):
        if r.random() < 0.6:
            out.append((60 + 0.2 * columns * wide, 60 + columns * wide * 0.8 + (columns - 1) * gap, y, 14.0))
            y += 2 * lead
        depth = r.randint(8, 20)
        for c in range(columns):
            for k in range(depth - (r.randint(0, 3) if c == columns - 1 else 0)):
                last = r.random() < 0.15
                x0 = 60 + c * (wide + gap) + (15 if r.random() < 0.15 else 0)
                x1 = 60 + c * (wide + gap) + wide * (r.uniform(0.2, 0.9) if last else r.uniform(0.97, 1.0))
                out.append((x0, max(x1, x0 + 20), y + k * lead + r.uniform(-0.3, 0.3), em))
        y += depth * lead + lead
    return out


def accuracy(r, kinds, n=60):
    right = total = 0
    for _ in range(n):
        lines = page_of(r, r.choice(kinds))
        shuffled = list(range(len(lines)))
        r.shuffle(shuffled)
        a = np.array([lines[i] for i in shuffled])
        got = [shuffled[i] for col in pages.read_order(a[:, 0], a[:, 1], a[:, 2], a[:, 3]) for i in col]
        assert sorted(got) == list(range(len(lines)))
        right += sum(b == a_ + 1 for a_, b in zip(got, got[1:], strict=False))
        total += len(lines) - 1
    return right / total


@pytest.mark.parametrize(("kinds", "least"), [([1], 0.99), ([2], 0.90), ([3], 0.75), ([1, 2, 3], 0.85)])
def test_order_of_generated_pages(kinds, least):
    assert accuracy(random.Random(11), kinds) >= least


def book(r, name, columns, heads=True):
    """Lines of a book and its paragraphs and notes."""
    chars = {1: 64, 2: 34}[columns]
    paras = [" ".join(sentence(r) for _ in range(r.randint(1, 6))) for _ in range(60)]
    lines, rows, notes, page = set_lines(r, paras, chars), [], [], 0
    while lines:
        page += 1
        n = 0
        depth = 20
        if heads:
            rows.append((name, page, n, 60.0, 40.0, 120.0, 9.0, f"The Silver Bridge {page + 6}" if page % 2 else "A Winter Book"))
            rows.append((name, page, 1, 200.0, 720.0, 10.0, 9.0, str(page + 6)))
            n = 2
        for c in range(columns):
            for k in range(min(depth, len(lines))):
                text, first, last = lines.pop(0)
                width = chars * 5.0 - (15 if first else 0) if not last else len(text) * 4.2
                x = 60.0 + c * (chars * 5 + 24)
                rows.append((name, page, n, x + (15.0 if first else 0.0), 80.0 + 12 * k, min(width, chars * 5.0 - (15 if first else 0)), 10.0, text))
                n += 1
        if page % 3 == 1 and columns == 1:
            for k, t in enumerate((f"{page} See the letter of that", f"{WORDS[page % 12]} evening.", f"{page + 1} So in the {WORDS[(page + 5) % 12]}.")):
                rows.append((name, page, n, 60.0, 400.0 + 10 * k, 150.0, 8.0, t))
                n += 1
            notes += [(page, f"{page} See the letter of that {WORDS[page % 12]} evening."), (page, f"{page + 1} So in the {WORDS[(page + 5) % 12]}.")]
    r.shuffle(rows)
    return rows, paras, notes


def test_books_come_back_as_they_were_set(spark):
    r = random.Random(12)
    made = {"one": book(r, "one", 1), "two": book(r, "two", 2), "bare": book(r, "bare", 1, heads=False)}
    lines = spark.createDataFrame([(*x, "clash", 1) for b in made.values() for x in b[0]], KIND + ", key string, par int").repartition(5)
    text, notes, gone = (x.collect() for x in pages.paragraphs(lines))
    for name, (rows, paras, want) in made.items():
        got = [x["text"] for x in sorted((x for x in text if x["book"] == name), key=lambda x: (x["page"], x["par"]))]
        whole, mine = " ".join(paras), " ".join(got)
        assert mine == whole, name
        # a paragraph is missed only where nothing on the page shows it
        assert len(set(got) & set(paras)) >= 0.9 * len(paras), name
        assert sorted((x["page"], x["text"]) for x in notes if x["book"] == name) == sorted(want)
        assert sum(x["book"] == name for x in gone) == (2 * max(x[1] for x in rows) if name != "bare" else 0)


def test_words_parted_at_line_and_page_ends(spark):
    rows = [("b", 1, 0, 60.0, 100.0, 300.0, 10.0, "The lan-"), ("b", 1, 1, 60.0, 112.0, 300.0, 10.0, "tern of Half-"), ("b", 1, 2, 60.0, 124.0, 300.0, 10.0, "Moon and the har­"), ("b", 3, 0, 60.0, 100.0, 300.0, 10.0, "bour were"), ("b", 4, 0, 60.0, 100.0, 300.0, 10.0, "lit."), ("b", 5, 0, 60.0, 100.0, 300.0, 10.0, "Then came winter.")]
    text, _, _ = pages.paragraphs(spark.createDataFrame(rows, KIND))
    assert [x["text"] for x in text.orderBy("page", "par").collect()] == ["The lantern of Half- Moon and the harbour were lit.", "Then came winter."]


def test_heads_and_numbers(spark):
    body = lambda p, k: ("b", p, 5 + k, 60.0, 100.0 + 12 * k, 300.0, 10.0, f"{WORDS[(p * 7 + k) % 12]} {WORDS[(p + k * 5) % 12]} {WORDS[p % 12]} river")
    rows = [body(p, k) for p in range(1, 8) for k in range(8)]
    rows += [("b", p, 0, 60.0, 40.0, 90.0, 10.0, f"THE NOBLE BRIDGE {p}") for p in range(2, 6)]
    rows += [("b", 1, 0, 60.0, 40.0, 90.0, 10.0, "The Noble Bridge")]  # the heading that the heads repeat
    rows += [("b", p, 1, 60.0, 700.0, 10.0, 10.0, {1: "iv", 2: "v", 3: "1914", 4: "vii", 5: "12"}[p]) for p in range(1, 6)]
    rows += [("b", 6, 1, 60.0, 700.0, 10.0, 10.0, "13"), ("b", 7, 0, 60.0, 40.0, 90.0, 14.0, "THE NOBLE BRIDGE 7")]
    gone = {(x["page"], x["text"]) for x in pages.paragraphs(spark.createDataFrame(rows, KIND))[2].collect()}
    assert gone == {(p, f"THE NOBLE BRIDGE {p}") for p in range(2, 6)} | {(1, "iv"), (2, "v"), (4, "vii"), (5, "12"), (6, "13")}


def test_edges(spark):
    rows = [("b", 1, 0, 1.0, 1.0, None, None, "alone"), ("b", 1, 1, None, 1.0, 5.0, 9.0, "nowhere"), ("b", None, 1, 1.0, 1.0, 5.0, 9.0, "no page"), (None, 1, 1, 1.0, 1.0, 5.0, 9.0, "no book"), ("b", 2, 0, 1.0, 1.0, 5.0, float("nan"), "  "), ("c", 1, 0, 5.0, 5.0, 5.0, 9.0, "same"), ("c", 1, 0, 5.0, 5.0, 5.0, 9.0, "same")]
    text, notes, gone = pages.paragraphs(spark.createDataFrame(rows, KIND))
    assert sorted((x["book"], x["text"]) for x in text.collect()) == [("b", "alone"), ("c", "same same")]
    assert notes.count() == 0 and gone.count() == 0
    assert all(x.count() == 0 for x in pages.paragraphs(spark.createDataFrame([], KIND)))


@pytest.mark.parametrize("query", ["a12_page_furniture", "s16_read_pages"])
def test_lines_that_come_again_and_narrow_columns_equal_the_sql(spark, tmp_path, query):
    import duckdb

    from foliant.plans import paged

    again = " ".join(f"{w}" for w in ["the"] * 900 + ["of"] * 900)
    rows = [(3, again, "src3"), (6, " ".join(f"w{i}" for i in range(700)), "src3"), (5, " ".join(["Nd"] * 226), "src5"), (8, " ".join(["a"] * 500), "src5"), (9, "iv", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(paged.ORACLE_SQL[query])
    names = [c[0] for c in cur.description]
    assert sorted(tuple(r[c] for c in names) for r in paged.QUERIES[query](spark, str(tmp_path)).collect()) == sorted(cur.fetchall())


def test_notes_alone_read_no_pages(spark, monkeypatch):
    """Notes are the same without the paragraphs, and no page is put in reading order for them."""
    rows = [("a", p, n, 50.0, 100.0 + 12 * n, 300.0, 10.0, f"line {n} of a page with some words") for p in range(1, 5) for n in range(12)]
    rows += [("a", p, 20, 50.0, 700.0, 200.0, 8.0, f"* a note of page {p}") for p in (1, 3)]
    lines = spark.createDataFrame(rows, "book string, page int, line int, x double, y double, width double, size double, text string")
    want = sorted(tuple(r) for r in pages.paragraphs(lines)[1].collect())
    assert len(want) == 2
    monkeypatch.setattr(pages, "_pages", None)
    assert sorted(tuple(r) for r in pages.page_notes(lines).collect()) == want


@pytest.mark.parametrize("columns", [2, 3])
def test_a_column_whose_first_line_is_a_running_head_is_still_read_first(spark, columns):
    """The last page has one line in its second column, and its first column's first line is on every page."""
    texts = lambda page, k: f"words of line number {chr(97 + page)}{chr(97 + k // 20)}{chr(97 + k % 20)} and others" if k else "we say the same once more and again"
    rows = [("b", p, k, 60.0 + 420 * (k // 20), 80.0 + 12 * (k % 20), 200.0, 10.0, texts(p, k)) for p in range(1, 6) for k in range(21 if p == 5 else 20 * columns)]
    made, _, gone = pages.paragraphs(spark.createDataFrame(rows, KIND))
    assert {(r["page"], r["line"]) for r in gone.collect()} >= {(p, 0) for p in range(1, 6)}
    got = " ".join(r["text"] for r in made.orderBy("page", "par").collect())
    assert got.endswith(" ".join(texts(5, k) for k in range(1, 21)))


def test_lines_taken_away_far_from_a_column_do_not_lengthen_it():
    y, taken = np.array([100.0, 112.0, 124.0]), np.array([40.0, 88.0, 76.0, 300.0])
    assert pages.reach(y, taken, 10.0) == (76.0, 124.0)
    assert pages.reach(y, taken[:0], 10.0) == (100.0, 124.0)


def test_furniture_and_notes_alone_are_those_of_pages_that_are_read(spark):
    """Whatever the batches of lines; sizes and numbers are missing from some."""
    r = random.Random(5)
    rows = []
    for b in ("one", "two", "three"):
        for p in range(1, 30):
            rows.append((b, p, 0, 60.0, 40.0, 300.0, r.choice([9.0, None]), "The Long Road" if r.random() < 0.7 else "Another Head Of It"))
            rows += [(b, p, k, 60.0, 70.0 + 12 * k, 400.0, r.choice([10.0, 10.04]), sentence(r)) for k in range(1, r.randint(3, 40))]
            if r.random() < 0.5:
                rows += [(b, p, 100 + k, 60.0, 600.0 + 10 * k, 400.0, 8.0, ("* " if not k else "") + "a note of " + sentence(r)) for k in range(r.randint(1, 3))]
            rows.append((b, p, 200, 200.0, 720.0, 20.0, 8.0, str(p + 3) if r.random() < 0.9 else "x"))
    r.shuffle(rows)
    lines = spark.createDataFrame(rows, KIND)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        _, notes, gone = pages.paragraphs(lines)
        assert sorted(map(tuple, pages.page_notes(lines).collect())) == sorted(map(tuple, notes.collect())) != []
        alone = pages.page_furniture(lines)
        assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, gone.drop("text").collect())) != []
        asked = pages.placed_lines(lines)
        edges, bodies = pages.edges_and_sizes(asked)
        assert edges.count() <= asked.count() and {x["body"] for x in bodies.collect()} == {10.0}
        down, up = [Window.partitionBy("book", "page").orderBy(*by) for by in (("y", "x", "line"), (F.desc("y"), F.desc("x"), F.desc("line")))]
        two = lambda of: {(x["book"], x["page"], x["line"]) for x in of.withColumns({"d": F.row_number().over(down), "u": F.row_number().over(up)}).filter("d <= 2 OR u <= 2").collect()}
        assert two(edges) == two(asked)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("alone, most", [(lambda lines: pages.page_furniture(lines), 0.1), (lambda lines: pages.page_notes(lines), 0.1)])
def test_furniture_and_notes_alone_write_little(spark, tmp_path, monkeypatch, alone, most):
    rows = [("b", p, k, 60.0, 80.0 + 12 * k, 400.0, 10.0, f"{k} {p} " + "words of many letters " * 5) for p in range(1, 40) for k in range(60)]
    wrote = []
    kept = pages.written
    monkeypatch.setattr(pages, "written", lambda df: wrote.append(kept(df)) or wrote[-1])
    alone(spark.createDataFrame(rows, KIND)).collect()
    letters = sum(t.select(F.sum(F.length("text"))).first()[0] or 0 for t in wrote if "text" in t.columns)
    assert letters < most * sum(len(x[-1]) for x in rows)
