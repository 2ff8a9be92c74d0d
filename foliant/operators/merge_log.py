"""Who an entity is one with, as a log of decisions: merges, hand-overs from a chapter on, undoings.

Nothing is moved when two entities turn out to be one. Decisions are events with steps, and what holds as of any step follows from
them: an id leads to the one it was merged into, or from some chapter on to the one its story was handed to, and so on to
the end of the path. One pass over a book's log, in the order of its steps, gives each id's owners as intervals of steps and chapters; rows of any
table take their owner as of a step by a join. An undone merge leaves no trace.

Defined results: a decision about an id and itself, a merge of an id that is merged already, an undoing of what isn't in
force, and whatever would close a circle count for nothing; a hand-over goes before a merge, a later chapter's
before an earlier's, of one chapter the later decided; of rows of one step the order is op, from, into; rows with a null book, step or op, or a null id where one
is needed, are left out; a null chapter of a hand-over is all chapters; further columns don't matter, an empty log gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .notes import first_object

_FIRST = float("-inf")
_OUT = "book string, id long, owner long, ch_from int, ch_until int, since long, until long"


class _Log:
    """One book's decisions in force, and what follows from them."""

    def __init__(self):
        self.force: dict[int, tuple[str, int, int, float]] = {}
        self.merged: dict[int, int] = {}  # from -> step
        self.handed: dict[int, list[tuple[float, int]]] = {}  # from -> (chapter, step), rising
        self.into: dict[int, set[int]] = {}  # who leads to an id
        self.now: dict[int, dict[tuple[float, float], tuple[int, int]]] = {}  # id -> chapters -> (owner, since)

    def _next(self, id_: int, ch: float) -> int | None:
        step = max((x for x in self.handed.get(id_, ()) if x[0] <= ch), default=(0, self.merged.get(id_)))[1]
        return None if step is None else self.force[step][2]

    def _chapters(self, id_: int) -> list[float]:
        """Chapters at which the owner of an id may change."""
        seen, todo, out = {id_}, [id_], {_FIRST}
        while todo:
            x = todo.pop()
            out |= {c for c, _ in self.handed.get(x, ())}
            for y in {self.force[s][2] for s in (*([self.merged[x]] if x in self.merged else []), *(s for _, s in self.handed.get(x, ())))} - seen:
                seen.add(y)
                todo.append(y)
        return sorted(out)

    def _circle(self, id_: int) -> bool:
        for ch in self._chapters(id_):
            at = self._next(id_, ch)
            while at is not None and at != id_:
                at = self._next(at, ch)
            if at == id_:
                return True
        return False

    def _put(self, step: int, what: tuple[str, int, int, float]) -> None:
        op, a, b, ch = what
        self.force[step] = what
        if op == "merge":
            self.merged[a] = step
        else:
            self.handed.setdefault(a, []).append((ch, step))
        self.into.setdefault(b, set()).add(a)

    def _drop(self, step: int) -> tuple[str, int, int, float]:
        op, a, b, ch = what = self.force.pop(step)
        if op == "merge":
            del self.merged[a]
        else:
            self.handed[a].remove((ch, step))
        if all(self.force[s][2] != b for s in (*([self.merged[a]] if a in self.merged else []), *(s for _, s in self.handed.get(a, ())))):
            self.into[b].discard(a)
        return what

    def decide(self, step: int, op: str, a: int, b: int | None, ch: float) -> int | None:
        """Puts a decision in force, or not; the id whose way has changed."""
        if op == "undo":
            if a not in self.force:
                return None
            what = self._drop(a)
            if self._circle(what[1]):
                self._put(a, what)
                return None
            return what[1]
        if a == b or (op == "merge" and a in self.merged) or step in self.force:
            return None
        self._put(step, (op, a, b, ch))
        if self._circle(a):
            self._drop(step)
            return None
        return a

    def changes(self, id_: int, step: int) -> Iterator[tuple]:
        """Intervals that end with a step, of all that lead to an id whose way has changed; what begins is kept."""
        seen, todo = {id_}, [id_]
        while todo:
            for y in self.into.get(todo.pop(), set()) - seen:
                seen.add(y)
                todo.append(y)
        for x in sorted(seen):
            points = [*self._chapters(x), float("inf")]
            new: dict[tuple[float, float], int] = {}
            for c, d in zip(points[:-1], points[1:], strict=True):
                at = x
                while (on := self._next(at, c)) is not None:
                    at = on
                last = next(reversed(new), None)
                if last is not None and new[last] == at:
                    del new[last]
                    c = last[0]
                new[c, d] = at
            new = {k: v for k, v in new.items() if v != x}
            old = self.now.get(x, {})
            for k, (owner, since) in old.items():
                if new.get(k) != owner and since < step:
                    yield (x, owner, *k, since, step)
            self.now[x] = {k: old[k] if k in old and old[k][0] == v else (v, step) for k, v in new.items()}

    def rest(self) -> Iterator[tuple]:
        for x in sorted(self.now):
            yield from ((x, owner, *k, since, None) for k, (owner, since) in self.now[x].items())


def owner_intervals(log: DataFrame) -> DataFrame:
    """book, id, owner, ch_from, ch_until, since, until of a log (book, step, op, a, b, ch).

    op merge: a is one with b; hand: a's from ch on is b's; undo: a is the step that is undone. Intervals are half open, null is no
    bound; an id without one is its own. Books are dealt over tasks, which hold one book's decisions in force.
    """
    rows = log.select(F.col("book").cast("string").alias("book"), F.col("step").cast("long").alias("step"), "op", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("ch").cast("int").alias("ch"))
    rows = rows.filter("book IS NOT NULL AND step IS NOT NULL AND a IS NOT NULL AND (op = 'undo' OR (op IN ('merge', 'hand') AND b IS NOT NULL))")

    def run(batches):
        name, held = None, _Log()
        number = lambda c: None if c in (_FIRST, float("inf")) else int(c)

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            found = [(b, x, o, number(c), number(d), s, u) for b, x, o, c, d, s, u in found]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _OUT.split(", ")])

        for batch in batches:
            out = []
            for book, step, op, a, b, ch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if book != name:
                    out += [(name, *x) for x in held.rest()]
                    name, held = book, _Log()
                changed = held.decide(step, op, a, b, _FIRST if ch is None else float(ch))
                if changed is not None:
                    out += [(book, *x) for x in held.changes(changed, step)]
            yield batch_of(out)
        yield batch_of([(name, *x) for x in held.rest()])

    return rows.repartition("book").sortWithinPartitions("book", "step", "op", "a", "b").mapInArrow(run, _OUT)


def owned(rows: DataFrame, who: list[str], at: str, intervals: DataFrame, step: Column) -> DataFrame:
    """rows (with book) whose ids in `who` are the owners as of a step, each at its row's chapter; a null id stays null."""
    out = rows.withColumn("_step", step)
    columns = rows.columns
    for i, c in enumerate(who):
        mine = intervals.select(F.col("book").alias("_book"), F.col("id").alias("_id"), F.col("owner").alias("_owner"), "ch_from", "ch_until", "since", "until")
        held = (
            (F.col("book") == F.col("_book")) & (F.col(c) == F.col("_id")) & (F.col("since") <= F.col("_step")) & (F.col("until").isNull() | (F.col("until") > F.col("_step")))
            & (F.col("ch_from").isNull() | (F.col(at) >= F.col("ch_from"))) & (F.col("ch_until").isNull() | (F.col(at) < F.col("ch_until")))
        )
        out = out.join(mine, held, "left").withColumn(c, F.coalesce("_owner", c)).select(*columns, "_step")
    return out.select(*columns)


def tidy_decisions(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log rows, names: book, step, id, name, kept) of a model's replies on a cast: book, step, shown array<long>, reply.

    same: entries that are one; taken: an entry whose story is another's from a chapter on; names and wrong: a name that an entry goes by from now on,
    or does not go by. Only entries that were shown count. Steps of a reply are its step times a million, and on.
    """
    kinds = "book string, step long, op string, a long, b long, ch int, name string"

    def run(batches):
        for batch in batches:
            out = []
            for book, step, shown, reply in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                said, known = first_object(reply) or {}, set(shown or [])

                def id_of(v):
                    text = str(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) < 2**62 else str(v or "").removeprefix("e")
                    return int(text) if text.isascii() and text.isdigit() and int(text) in known else None

                def entries(key):
                    return [x for x in said.get(key) or [] if isinstance(x, dict)] if isinstance(said.get(key), list) else []

                found = []
                for s in entries("same"):
                    keep = id_of(s.get("keep"))
                    found += [("merge", a, keep, None, None) for a in map(id_of, s["merge"] if isinstance(s.get("merge"), list) else []) if a is not None and keep is not None and a != keep]
                for t in entries("taken"):
                    a, b, ch = id_of(t.get("id")), id_of(t.get("by")), t.get("from_ch")
                    if a is not None and b is not None and a != b and isinstance(ch, (int, float)) and 1 <= ch < 2**31:
                        found.append(("hand", a, b, int(ch) - 1, None))
                for w in entries("wrong"):
                    found += [("wrong", id_of(w.get("id")), None, None, n.strip()) for n in (w["names"] if isinstance(w.get("names"), list) else []) if isinstance(n, str) and id_of(w.get("id")) is not None and n.strip()]
                found += [("name", id_of(n.get("id")), None, None, n["name"].strip()) for n in entries("names") if isinstance(n.get("name"), str) and n["name"].strip() and id_of(n.get("id")) is not None]
                out += [(book, step * 1_000_000 + i, *x) for i, x in enumerate(found)]
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(types)], names=[c.split()[0] for c in kinds.split(", ")])

    source = replies.filter("book IS NOT NULL AND step IS NOT NULL").select(F.col("book").cast("string").alias("book"), F.col("step").cast("long").alias("step"), F.col("shown").cast("array<bigint>").alias("shown"), F.col("reply").cast("string").alias("reply"))
    found = source.mapInArrow(run, kinds)
    return found.filter("op IN ('merge', 'hand')").drop("name"), found.filter("op IN ('name', 'wrong')").select("book", "step", F.col("a").alias("id"), "name", (F.col("op") == "name").alias("kept"))
