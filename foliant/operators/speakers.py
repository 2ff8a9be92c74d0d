"""Who speaks: the characters of a book by the tags of its speeches, and a speaker for each quotation.

The cast is the whole book's: names are counted over all its paragraphs, and names that one person goes by are joined
(union-find over titles, surnames and first names, where only one person can be meant and sexes agree). Who speaks is found
stretch by stretch, with nothing carried from one to the next, so books of any length are spread over tasks:
by the tag beside a quotation, by what the speaker does beside it, by whom a paragraph leads up to, by the
turns of an exchange of two, by whom the turn before spoke to. Somebody only described ("said the old man") is a stranger:
no one of the cast, and no one to take turns with. Quotations without a sign of who speaks are left to no one.

Defined results: a null text has no quotations; paragraphs at one place are read in the order of their texts; names that nobody speaks under
are no one; a pronoun means the one person of its sex at hand, and no one where there are two; ties between names
go to the longer, then to the first in the alphabet; further columns don't matter; no paragraphs give no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dealt, small_batches
from .dialogue import quotations

#: Paragraphs of a stretch, and those before a paragraph whose people are at hand.
STRETCH, SCENE = 300, 3
# Verbs of speaking, titles by sex, what describes somebody without a name.
SAID = "said says asked asks replied answered cried called whispered shouted murmured added continued muttered exclaimed returned repeated demanded began observed remarked agreed laughed sighed snapped told".split()
HE, SHE = "mr mister sir lord king prince father uncle brother".split(), "mrs miss ms lady madam queen princess mother aunt sister".split()
PEOPLE = "man woman boy girl stranger voice guard driver child officer maid servant nurse clerk soldier captain doctor".split()
_VERB = "(?:" + "|".join(SAID) + ")"
_TITLE = "(?:Mr|Mrs|Ms|Miss|Dr|Lord|Lady|Sir|King|Queen|Prince|Princess)"
_NAME = rf"(?:{_TITLE}\.? )?[A-Z][a-zà-ÿ]+(?: [A-Z][a-zà-ÿ]+){{0,2}}"
_SOMEBODY = rf"(?:[Tt]he|[Aa]n?) (?:[a-z]+ ){{0,2}}(?:{'|'.join(PEOPLE)})"
_WHO = rf"{_NAME}|[Hh]e|[Ss]he|{_SOMEBODY}"
_AFTER = re.compile(rf"^[\s,.]*(?:{_VERB}\s+(?P<a>{_SOMEBODY}|{_NAME}|he|she)\b|(?P<b>{_WHO})\s+(?:\w+ly\s+)?{_VERB}\b)")
_BEFORE = re.compile(rf"(?P<b>{_WHO})\s+(?:\w+ly\s+)?{_VERB}[^.!?]{{0,40}}[,:]\s*$")
#: A paragraph that leads up to the next one's speech.
_LEADS = re.compile(rf"(?P<b>{_WHO})\b(?:[^.!?]|(?<=Mr)\.|(?<=Mrs)\.|(?<=Dr)\.)*?\b{_VERB}\b[^.!?]*:\s*$")
_NOT_NAMES = frozenset("The A An He She It They We I You But And Then So".split())
#: Somebody of whom no more is known.
STRANGER = "?"


def _outside(text: str, spans: list[tuple[int, int, bool]]) -> list[tuple[int, str]]:
    """(start, text) of what lies between the quotations."""
    edges = [0, *(x for a, b, _ in spans for x in (a, b)), len(text)]
    return [(a, text[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _tags(text: str, spans: list[tuple[int, int, bool]]) -> list[str | None]:
    """For each quotation what its tag names: after it, or before it."""
    out: list[str | None] = []
    for i, (a, b, _) in enumerate(spans):
        end = spans[i + 1][0] if i + 1 < len(spans) else len(text)
        start = spans[i - 1][1] if i else 0
        m = _AFTER.search(text[b:end]) or _BEFORE.search(text[start:a])
        found = (m.groupdict().get("a") or m.groupdict().get("b")) if m else None
        out.append(None if found in _NOT_NAMES and found not in ("He", "She") else found)
    return out


def _described(tag: str) -> bool:
    return tag.split(" ")[0].lower() in ("the", "a", "an") and tag.split(" ")[-1] in PEOPLE


def tagged_names(text: str) -> list[tuple[str, str]]:
    """(name, sex: m, f or empty) of each tag of a paragraph that gives a name; the sex is its title's, or that of the pronoun that follows."""
    spans, out = quotations(text), []
    for i, (name, (_, b, _)) in enumerate(zip(_tags(text, spans), spans, strict=True)):
        if not name or name.lower() in ("he", "she") or _described(name):
            continue
        title = name.split(" ")[0].rstrip(".").lower()
        end = spans[i + 1][0] if i + 1 < len(spans) else len(text)
        # in the tag's own sentence, or at the begin of the next
        after = re.search(r"^[^.!?]*?(?:\b(his|her|he|she)\b|[.!?]\s+(He|She)\b)", text[b:end].replace("Mr.", "Mr").replace("Mrs.", "Mrs"))
        said = (after[1] or after[2]).lower() if after else ""
        out.append((name, "m" if title in HE else "f" if title in SHE else {"his": "m", "he": "m", "her": "f", "she": "f"}.get(said, "")))
    return out


class _Joined:
    """Union-find over names; a root is the name that stands for all."""

    def __init__(self, names):
        self.up = {n: n for n in names}

    def root(self, n: str) -> str:
        while self.up[n] != n:
            self.up[n] = self.up[self.up[n]]
            n = self.up[n]
        return n

    def join(self, short: str, full: str) -> None:
        self.up[self.root(short)] = self.root(full)


def _parts(name: str) -> tuple[str, list[str]]:
    """(title in small letters, the other words)."""
    words = name.split(" ")
    title = words[0].rstrip(".").lower()
    return (title, words[1:]) if len(words) > 1 and re.fullmatch(_TITLE, words[0].rstrip(".")) else ("", words)


def merged_names(counts: dict[str, tuple[int, int, int]]) -> dict[str, tuple[str, int, str]]:
    """name -> (the person's fullest name, speeches, sex) of counts name -> (speeches, signs of a man, signs of a woman).

    A name is joined to the one person whose fuller name it is part of: a title and surname to a full name of that surname, a first
    name or a surname alone to a name that has it. Not where two people could be meant, and not where sexes differ.
    """
    joined = _Joined(counts)
    votes = {n: [m, f] for n, (_, m, f) in counts.items()}

    def sex(name: str) -> str:
        title = _parts(name)[0]
        m, f = votes[joined.root(name)]
        return "m" if title in HE else "f" if title in SHE else "m" if m > 2 * f else "f" if f > 2 * m else ""

    def agree(a: str, b: str) -> bool:
        return not sex(a) or not sex(b) or sex(a) == sex(b)

    having: dict[str, list[str]] = {}
    for n in counts:
        for w in _parts(n)[1]:
            having.setdefault(w, []).append(n)
    # the fullest first, so that what is joined later finds whole people
    for name in sorted(counts, key=lambda n: (-len(_parts(n)[1]), not _parts(n)[0], n)):
        title, words = _parts(name)
        fuller = []
        for other in having[words[-1]]:
            t, ws = _parts(other)
            whole = len(ws) > len(words) and (ws[-len(words) :] == words or (not title and ws[: len(words)] == words))
            same = ws == words and t != title and (not title or not t) and bool(t)
            if other != name and (whole or same) and agree(name, other) and not (title and t and title != t):
                fuller.append(other)
        roots = {joined.root(o) for o in fuller}
        if len(roots) == 1 and joined.root(name) not in roots:
            full = next(iter(roots))
            m, f = votes[joined.root(name)]
            votes[full] = [votes[full][0] + m, votes[full][1] + f]
            joined.join(name, full)
    total, kin = Counter(), {}
    for name, (n, _, _) in counts.items():
        total[joined.root(name)] += n
        kin.setdefault(joined.root(name), []).append(name)
    shown = {r: max(names, key=lambda n: (len(_parts(n)[1]), len(n), [-ord(c) for c in n])) for r, names in kin.items()}

    def sex_of(root: str) -> str:
        titled = {sex(n) for n in kin[root] if _parts(n)[0] in HE or _parts(n)[0] in SHE}
        return next(iter(titled)) if len(titled) == 1 else sex(root)

    return {name: (shown[joined.root(name)], total[joined.root(name)], sex_of(joined.root(name))) for name in counts}


def characters(paragraphs: list[str], least: int = 2) -> dict[str, tuple[str, int, str]]:
    """name -> (the character's full name, speeches, sex: m, f or empty) of those with so many speeches."""
    counts: dict[str, list[int]] = {}
    for text in paragraphs:
        for name, sex in tagged_names(text):
            c = counts.setdefault(name, [0, 0, 0])
            c[0], c[1], c[2] = c[0] + 1, c[1] + (sex == "m"), c[2] + (sex == "f")
    return {n: who for n, who in merged_names({n: tuple(c) for n, c in counts.items()}).items() if who[1] >= least}


def attributed(paragraphs: list[str], cast: dict[str, tuple[str, int, str]]) -> list[tuple[int, int, int, str | None]]:
    """(paragraph, start, end, who) of each quotation."""
    any_name = "|".join(re.escape(n) for n in sorted(cast, key=lambda n: (-len(n), n)))
    names = re.compile(rf"\b(?:{any_name})\b") if cast else None
    # at the begin of a sentence, and doing something; and called by name in a speech
    acts = re.compile(rf"(?:^|[.!?…]\s+)(?P<who>(?:{any_name})|He|She)(?=\s+(?:\w+ly\s+)?[a-z])") if cast else None
    called = re.compile(rf"(?:^|[,;.!?—]\s*)(?P<who>{any_name})(?=\s*(?:[,!?.;—]|$))") if cast else None
    sexes = {who: s for who, _, s in cast.values()}
    scene: list[tuple[int, str]] = []  # paragraph and person, the last named last
    turns: list[dict] = []
    waiting: str | None = None
    open_by: str | None = None
    for n, text in enumerate(paragraphs):
        spans = quotations(text)
        scene = [x for x in scene if n - x[0] <= SCENE]
        outside = _outside(text, spans)

        def person(tag: str | None) -> str | None:
            if tag is None:
                return None
            if tag.lower() in ("he", "she"):
                sex = "m" if tag.lower() == "he" else "f"
                there = {who for _, who in scene if sexes.get(who) == sex}
                return next(iter(there)) if len(there) == 1 else None
            return cast[tag][0] if tag in cast else STRANGER

        there_now = {cast[m[0]][0] for _, part in outside for m in (names.finditer(part) if names else ())}
        if not spans:
            scene += [(n, w) for w in there_now]
            m = _LEADS.search(text)
            waiting = person(m["b"]) if m else None
            open_by = None
            continue
        tags = [person(t) for t in _tags(text, spans)]
        known = {w for w in tags if w}
        one = next(iter(known)) if len(known) == 1 else None
        addressed = {cast[m["who"]][0] for a, b, _ in spans for m in (called.finditer(text[a + 1 : b - 1]) if called else ())}
        doing = {person(m["who"]) for _, part in outside for m in (acts.finditer(part.strip()) if acts else ())} - {None}
        if one is None and not known and len(doing) == 1 and there_now <= doing and not doing & addressed:
            one = next(iter(doing))
        goes_on = open_by if spans[0][0] == 0 and open_by else None
        found = []
        for (a, b, closed), who in zip(spans, tags, strict=True):
            who = who or one or (goes_on if a == 0 else None) or (waiting if not known else None)
            found.append([n, a, b, who])
            open_by = None if closed else who
        waiting = None
        scene += [(n, w) for w in (*there_now, *(f[3] for f in found)) if w and w != STRANGER]
        said_by = {f[3] for f in found}
        turns.append({"n": n, "found": found, "who": next(iter(said_by)) if len(said_by) == 1 else None, "mixed": len(said_by) > 1, "to": addressed, "others": there_now})
    _take_turns(turns)
    return [(n, a, b, None if who == STRANGER else who) for t in turns for n, a, b, who in t["found"]]


def _take_turns(turns: list[dict]) -> None:
    """Fills in who speaks where an exchange shows it; paragraphs that follow one another are one exchange."""

    def next_to(i: int, j: int) -> bool:
        return 0 <= j < len(turns) and abs(turns[j]["n"] - turns[i]["n"]) == abs(i - j) and not turns[j]["mixed"]

    def by_turns(i: int, step: int) -> str | None:
        """Who spoke two turns away, where another spoke between."""
        if not (next_to(i, i + step) and next_to(i, i + 2 * step)):
            return None
        other, same = turns[i + step]["who"], turns[i + 2 * step]["who"]
        return same if same and other and same != other and STRANGER not in (same, other) else None

    def fits(i: int, who: str) -> bool:
        near = {turns[j]["who"] for j in (i - 1, i + 1) if next_to(i, j)}
        return who not in turns[i]["to"] and turns[i]["others"] <= {who} and not (next_to(i, i - 1) and turns[i - 1]["who"] == who) and (not turns[i]["to"] or bool(turns[i]["to"] & near) or None in near)

    changed = True
    while changed:
        changed = False
        for i, t in enumerate(turns):
            if t["who"] is not None or t["mixed"]:
                continue
            before, after = by_turns(i, -1), by_turns(i, 1) if next_to(i, i - 1) else None  # what begins an exchange is anyone's
            who = before or after  # where the two differ, someone spoke twice; it is read on from what came first
            if who is None and before is None and after is None and next_to(i, i - 1):
                asked = turns[i - 1]
                if asked["who"] not in (None, STRANGER) and len(asked["to"]) == 1 and asked["who"] not in asked["to"] and t["to"] <= {asked["who"]}:
                    who = next(iter(asked["to"]))  # whom the turn before spoke to answers
            if who is not None and fits(i, who):
                t["who"], changed = who, True
                for f in t["found"]:
                    f[3] = who


def book_cast(paragraphs: DataFrame, book: str, text: str, least: int = 1) -> DataFrame:
    """book, name, who, sex, speeches of all names of a book's tags. Names are counted as rows; only a book's different names meet."""
    kind = dict(paragraphs.dtypes)[book]

    def tags(batches):
        for x in batches:
            found = [(b, n, s) for b, t in zip(x[book], x["_t"], strict=True) for n, s in tagged_names(t)]
            yield pd.DataFrame(found, columns=[book, "name", "sex"])

    named = dealt(paragraphs.select(book, F.coalesce(F.col(text), F.lit("")).alias("_t")).filter(F.col(book).isNotNull())).mapInPandas(tags, f"{book} {kind}, name string, sex string")
    counts = named.groupBy(book, "name").agg(F.count("*").alias("n"), F.count_if(F.col("sex") == "m").alias("m"), F.count_if(F.col("sex") == "f").alias("f"))
    names = counts.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("name", "n", "m", "f"))).alias("_names"))

    def people(batches):
        for x in batches:
            found = []
            for b, named_as in zip(x[book], x["_names"], strict=True):
                who = merged_names({r["name"]: (r["n"], r["m"], r["f"]) for r in named_as})
                found += ((b, n, w, s, t) for n, (w, t, s) in who.items() if t >= least)
            yield pd.DataFrame(found, columns=[book, "name", "who", "sex", "speeches"])

    return names.mapInPandas(people, f"{book} {kind}, name string, who string, sex string, speeches long")


def speakers(paragraphs: DataFrame, book: str, place: str, text: str, cast: DataFrame | None = None, stretch: int = STRETCH) -> DataFrame:
    """book, place, start, end, who (null for no one) of the quotations. cast(book, name, who, sex): known names; without it the book's own."""
    kind, at = dict(paragraphs.dtypes)[book], dict(paragraphs.dtypes)[place]
    rows = paragraphs.select(book, place, F.coalesce(F.col(text), F.lit("")).alias("_t"), F.floor(F.col(place) / stretch).cast("long").alias("_s"))
    people = cast if cast is not None else book_cast(paragraphs, book, text)
    known = people.groupBy(book).agg(F.collect_set(F.struct("name", "who", "sex")).alias("_cast"))  # a book's cast
    # a stretch is a row; many short ones are one call of Python
    stretches = dealt(rows, book, "_s").groupBy(book, "_s").agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), "_t"))).alias("_l")).join(known, book, "left")

    def run(batches):
        for x in batches:
            found = []
            for b, said, given in zip(x[book], x["_l"], x["_cast"], strict=True):
                people = {c["name"]: (c["who"], 0, c["sex"]) for c in given} if given is not None else {}
                found += ((b, said[n]["at"], a, z, who) for n, a, z, who in attributed([r["_t"] for r in said], people))
            yield pd.DataFrame(found, columns=[book, place, "start", "end", "who"])

    small_batches(paragraphs.sparkSession)
    return stretches.select(book, "_l", "_cast").mapInPandas(run, f"{book} {kind}, {place} {at}, start int, end int, who string")
