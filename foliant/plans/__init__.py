"""Operators bound to tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from . import files, finding, folds, graph, kept, memory, merging, more, noting, paged, queued, reading, sounds, streams, text, wording

MODULES = (reading, graph, text, streams, folds, memory, wording, finding, files, more, kept, noting, paged, queued, sounds, merging)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
