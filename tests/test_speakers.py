"""Who speaks, in a short story told here."""

import random

from foliant.operators.speakers import attributed, book_cast, characters, merged_names, speakers

STORY = [
    "Anna Marsh came in from the garden. Tom was at the table.",
    "“You are late,” said Tom. He put down his cup.",
    "“The gate was shut,” Anna Marsh answered, and took off her coat.",
    "“Again?”",
    "“Again.”",
    "Mr. Reed looked up at Anna from his paper and said:",
    "“I shut it myself.”",
    "“Why?” she asked. “There was no need.”",
    "Nobody spoke for a while.",
    "“A voice from nowhere.”",
    "“I am tired,” said Anna.",
    "“So am I,” said Mr. Reed with his hat on.",
]


def test_characters():
    cast = characters(STORY, 1)
    assert cast["Anna"][0] == cast["Anna Marsh"][0] == "Anna Marsh" and cast["Anna"][2] == "f"
    assert cast["Tom"] == ("Tom", 1, "m") and cast["Mr. Reed"][2] == "m"


def test_quotations_have_speakers():
    who = {(n, a): w for n, a, _, w in attributed(STORY, characters(STORY, 1))}
    got = [w for _, w in sorted(who.items())]
    assert got == ["Tom", "Anna Marsh", "Tom", "Anna Marsh", "Mr. Reed", "Anna Marsh", "Anna Marsh", None, "Anna Marsh", "Mr. Reed"]
    assert attributed([], {}) == [] and attributed(["“Hello.”"], {}) == [(0, 0, 8, None)]


def test_speakers_of_books(spark):
    rows = [(b, n, t) for b in (1, 2) for n, t in enumerate(STORY)] + [(3, 0, None)]
    out = speakers(spark.createDataFrame(rows, "book int, n int, text string"), "book", "n", "text").collect()
    assert len(out) == 20 and {r["who"] for r in out if r["book"] == 2} == {"Tom", "Anna Marsh", "Mr. Reed", None}
    cast = spark.createDataFrame([(1, "Tom", "T", "m")], "book int, name string, who string, sex string")
    known = speakers(spark.createDataFrame(rows, "book int, n int, text string"), "book", "n", "text", cast).filter("book = 1 AND who IS NOT NULL").collect()
    assert {r["who"] for r in known} == {"T"}


# ---- a labelled novel, made here

PEOPLE = [("Anna Marsh", "Anna", "Miss Marsh", "f"), ("Tom Reed", "Tom", "Mr. Reed", "m"), ("Clara Voss", "Clara", "Mrs. Voss", "f"), ("Edmund Hale", "Edmund", "Mr. Hale", "m")]
SAYS = ["I do not think so", "The gate was shut", "We must go before dark", "It is a long way", "You know the road", "There was no letter", "Perhaps the river is high", "Nobody told me", "That may be", "Wait until the morning"]
DOES = ["put down the cup", "looked out of the window", "folded the letter", "went to the door", "smiled a little", "shook the rain from the coat"]
SAID_ = ["said", "asked", "replied", "answered", "cried", "whispered"]


def novel(seed, scenes=90):
    """(paragraphs, {paragraph: who}) of scenes of two, some with a third person, a stranger, narration or a speech that goes on."""
    r = random.Random(seed)
    out, who = [], {}

    def say(p, text):
        who[len(out)] = p[0]
        out.append(text)

    for _ in range(scenes):
        a, b, c = r.sample(PEOPLE, 3)
        call = lambda p: r.choice([p[0], p[1], p[1], p[2]])
        out.append(f"{call(a)} found {call(b)} in the {r.choice(['garden', 'hall', 'kitchen'])}. It was {r.choice(['late', 'cold', 'nearly night'])}.")
        speaker, other = a, b
        for k in range(r.randint(4, 8)):
            line, form = r.choice(SAYS), r.random()
            pronoun = "he" if speaker[3] == "m" else "she"
            if k < 2 or form < 0.25:
                say(speaker, r.choice([f"“{line},” {r.choice(SAID_)} {call(speaker)}.", f"{call(speaker)} {r.choice(SAID_)}, “{line}.”", f"“{line},” {r.choice(SAID_)} {call(speaker)}, and {r.choice(DOES)}. “{r.choice(SAYS)}.”", f"“{line}!” {call(speaker)} {r.choice(SAID_)} quietly."]))
            elif form < 0.35 and a[3] != b[3]:
                say(speaker, f"“{line},” {pronoun} {r.choice(SAID_)}.")
            elif form < 0.5:
                say(speaker, f"“{line}.” {call(speaker)} {r.choice(DOES)}. “{r.choice(SAYS)}.”")
            elif form < 0.6:
                say(speaker, f"“{line}, {other[1]}.”")
            elif form < 0.66:
                say(c, f"“{r.choice(SAYS)},” said {call(c)} from the stairs.")
                out.append("Nobody answered for a while.")
                break
            elif form < 0.71:
                say(("?",), f"“{r.choice(SAYS)},” said the old {r.choice(['man', 'woman'])}.")
                out.append("The rain had begun again.")
                break
            elif form < 0.76:
                out.append(f"{call(speaker)} turned to {call(other)} and {r.choice(['said', 'replied'])}:")
                say(speaker, f"“{line}.”")
            else:
                say(speaker, f"“{line}.”")
            speaker, other = other, speaker
        if r.random() < 0.3:
            say(a, f"“{r.choice(SAYS)},” said {a[1]}. “{r.choice(SAYS)}.")
            say(a, f"“{r.choice(SAYS)}.”")
        out.append(f"The {r.choice(['clock', 'wind', 'river'])} could be heard all over the house.")
    return out, who


def test_precision_and_coverage_on_a_labelled_novel():
    for seed in range(5):
        paragraphs, who = novel(seed)
        assert len(paragraphs) >= 450
        right = wrong = 0
        cast = characters(paragraphs, 2)
        assert {w for w, _, _ in cast.values()} == {p[0] for p in PEOPLE}
        assert {w: s for w, _, s in cast.values()} == {p[0]: p[3] for p in PEOPLE}
        quotes = attributed(paragraphs, cast)
        for n, _, _, found in quotes:
            right += found == who[n]
            wrong += found is not None and found != who[n]
        assert right / (right + wrong) >= 0.98, (seed, right, wrong)
        assert (right + wrong) / len(quotes) >= 0.45


def test_names_of_one_person_are_joined():
    n = merged_names({"Anna Marsh": (5, 0, 3), "Miss Marsh": (4, 0, 0), "Anna": (9, 0, 2), "Marsh": (1, 0, 0), "Mr. Marsh": (2, 0, 0), "Tom": (3, 3, 0), "Tom Reed": (1, 0, 0), "Tom Hale": (1, 0, 0), "Lord Reed": (1, 0, 0), "Dr. Voss": (2, 0, 0), "Clara Voss": (2, 0, 2), "Edmund Voss": (2, 2, 0), "Sam": (1, 0, 0)})
    assert {n[x][0] for x in ("Anna Marsh", "Miss Marsh", "Anna")} == {"Anna Marsh"} and n["Anna"][1] == 18 and n["Anna"][2] == "f"
    assert n["Mr. Marsh"] == ("Mr. Marsh", 2, "m")  # another sex
    assert n["Marsh"][0] == "Marsh"  # two it could be
    assert n["Tom"][0] == "Tom" and n["Dr. Voss"][0] == "Dr. Voss"
    assert n["Lord Reed"][0] == "Tom Reed" and n["Sam"] == ("Sam", 1, "")
    assert merged_names({}) == {}


def test_who_is_spoken_to_acts_or_is_described():
    cast = {"Anna": ("Anna", 3, "f"), "Tom": ("Tom", 3, "m"), "Clara": ("Clara", 2, "f")}
    who = lambda *ps: [w for _, _, _, w in attributed(list(ps), cast)]
    assert who("“Come here, Tom,” said Anna.", "“Why?”") == ["Anna", "Tom"]
    assert who("“Well.” Anna shut the door. “Go on.”") == ["Anna", "Anna"]
    assert who("“Anna, listen.” Anna shut the door.") == [None]  # she is spoken to
    assert who("“No,” said the old man.", "“Yes,” said Tom.", "“No.”") == [None, "Tom", None]
    assert who("Anna saw Clara.", "“So,” she said.") == [None]  # two it could be
    assert who("“One,” said Anna.", "“Two,” said Tom.", "“Three, Anna.”", "“Four.”") == ["Anna", "Tom", None, None]


def test_the_cast_is_the_whole_book_s(spark):
    paragraphs, who = novel(3)
    rows = [(b, n, t) for b in ("x", "y") for n, t in enumerate(paragraphs)] + [(None, 0, "“Hm,” said Sam."), ("z", 0, None)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "book string, n int, text string, name string")
    got = speakers(df, "book", "n", "text", stretch=100).collect()
    cast = {r["name"]: r["who"] for r in book_cast(df, "book", "text").filter("book = 'x'").collect()}
    assert cast["Miss Marsh"] == cast["Anna"] == "Anna Marsh"
    for b in ("x", "y"):
        named = [r for r in got if r["book"] == b and r["who"]]
        assert sum(r["who"] == who[r["n"]] for r in named) >= 0.98 * len(named) and len(named) > 200
    # a name tagged once in the first stretch is known in the last
    late = speakers(spark.createDataFrame([("b", 0, "“Hm,” said Sam."), ("b", 900, "“Well.” Sam shut the door.")], "book string, n int, text string"), "book", "n", "text").collect()
    assert {r["who"] for r in late} == {"Sam"}
    assert speakers(df.limit(0), "book", "n", "text").count() == 0


def test_many_short_books_are_few_calls(spark):
    """No group of its own for each stretch or book: one call of Python takes many."""
    rows = [(i, n, t) for i in range(30) for n, t in enumerate(["“Go on,” said Anna.", "“No, and why should I?” Tom answered.", "“Well.”"])]
    got = speakers(spark.createDataFrame(rows, "book long, place int, t string"), "book", "place", "t")
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["book"] for r in got.filter("who = 'Anna' AND place = 0").collect()} == set(range(30))
