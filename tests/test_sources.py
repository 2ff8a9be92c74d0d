"""Stores and plain text."""

import json

from foliant.sources import plain, stores


def test_paragraph_shapes():
    assert plain.paragraphs("A wrapped\nline of hy-\nphens.\n\nNext\n") == ["A wrapped line of hyphens.", "Next"]
    assert plain.paragraphs("  First one\ngoes on\n  Second") == ["First one goes on", "Second"]
    assert plain.paragraphs("one\ntwo") == ["one", "two"]
    assert plain.paragraphs("Well-\nKnown") == ["Well-", "Known"]
    assert plain.paragraphs("head\n*** START OF THE PROJECT X ***\nBody\n*** END OF THE PROJECT X ***\nlicence") == ["Body"]
    assert plain.paragraphs("") == [] and plain.paragraphs("﻿\r\n \r\n") == []


def test_a_broken_line_is_set_aside(spark, tmp_path):
    rows = [{"day": "2024-01-01", "listen": 5, "books": {"a": 3, "b": 2}}, {"day": "2024-01-02"}]
    (tmp_path / "days.json").write_text("\n".join([*map(json.dumps, rows), "{broken"]))
    days = stores.read_store(spark, f"file://{tmp_path}/days.json", "days").cache()
    assert days.count() == 3 and days.filter("_broken IS NOT NULL").count() == 1
    assert sorted((r["book"], r["ms"]) for r in stores.day_books(days).collect()) == [("a", 3), ("b", 2)]


def test_library_entries(spark, tmp_path):
    rows = [{"id": "1", "title": "T", "progress": 0.996, "series": "", "addedAt": "2024-01-01T00:00:00Z"}, {"id": "2"}]
    (tmp_path / "library.json").write_text("\n".join(map(json.dumps, rows)))
    got = {r["id"]: (r["finished"], r["series"], r["last_touched"] is None) for r in stores.library(spark, f"file://{tmp_path}/library.json").collect()}
    assert got == {"1": (True, None, False), "2": (False, None, True)}


def test_marks_as_markdown(spark, tmp_path):
    rows = [{"id": "1", "book": "B", "text": "late", "at": {"section": 2, "block": 0, "sentence": 0}}, {"id": "2", "book": "B", "text": "early", "note": "n", "at": {"section": 1, "block": 0, "sentence": 0}}]
    (tmp_path / "marks.json").write_text("\n".join(map(json.dumps, rows)))
    stores.write_marks_as_markdown(stores.read_store(spark, f"file://{tmp_path}/marks.json", "marks"), f"file://{tmp_path}/out")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "## B\n\n> early\n\nn\n\n> late\n\n"
