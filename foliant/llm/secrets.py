"""Secret scans: patterns find candidates, a random forest removes the false positives.

Candidates are strings of known formats, values assigned to names of credentials, and long runs
of letters and digits; each to its real end. Their features are length, entropy, how likely their
character transitions are in plain words, how much of them a dictionary covers, and what the words
in the path, beside and inside them speak for. That evidence is learned, not listed: for each word
the log odds of standing by a secret, from the labelled findings, out of fold for the forest's own
training. So the forest is trained from labelled findings alone.

Offsets are code points of the whole text. Defined results: a null text counts as empty and has
no candidates; a null path counts as empty; equal rows have equal findings; formats and assigned
values that overlap are one candidate over both, named by the more specific, and runs that overlap another are none; an assigned value of under six
characters is a candidate if it mixes letters with digits or marks; a very long text is read whole, and a
value of any length is taken whole; `redact` carries further columns along, whatever their names;
an empty table gives no rows. A fit without findings of both kinds raises an error.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size, whole_text, written

# Published formats of credentials, most specific first.
FORMATS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s+(?:Proc-Type|DEK-Info|Comment|Version):[^\n]*+)*+(?:\s+[A-Za-z0-9+/]{40,}+={0,2})*+(?:(?:\s+[A-Za-z0-9+/]++={0,2})?\s*-----END [A-Z ]*PRIVATE KEY-----)?",
    "aws_access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "github_token": r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe_key": r"(?<![A-Za-z0-9])[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "google_key": r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}",
    "jwt": r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
_HELD = r"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)"
#: A value in quotes ends at the quote that no letter or digit follows; another at white space, a quote, or a comma that ends it or begins the next name.
_ASSIGNED = re.compile(
    rf"""(?i){_HELD}(?:(?!{_HELD})\w)*+["']?\s*+(?::=|=>|[:=])\s*+"""
    r"""(?:(?P<mark>["'])(?P<q>(?:(?!(?P=mark))[^\n]|(?P=mark)(?=\w))++)(?P=mark)|(?P<v>(?:[^\s"'<>,;]|[,;](?!\s|\Z|["']?[\w-]++["']?\s*[:=]))++))"""
)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}={0,2}")
_FORMAT = re.compile("|".join(f"(?P<{k}>{v})" for k, v in FORMATS.items()))
_FORMAT_START = re.compile(r"-----BEGIN|AKIA|ASIA|gh[pousr]_|xox[abprs]-|[sr]k_(?:live|test)_|AIza|eyJ")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

NUMBERS = ["length", "entropy", "digits", "upper", "lower", "marks", "transitions", "class_changes", "coverage", "distinct", "longest_repeat", "hex_only", "digits_only", "format", "assigned", "quoted", "path_depth"]
#: Where words speak for or against a secret: the one before it, the six before, two after, in the path, and inside the value.
PLACES = ["last", "near", "after", "path", "inside"]
FEATURES = [*NUMBERS, *(f"{p}_words" for p in PLACES)]
#: Labelled findings that a word needs before it counts, and folds for evidence in training.
LEAST_SEEN, FOLDS = 2, 5
#: Assigned values of fewer characters are candidates only if they mix letters with digits or marks; a short word is what prose says.
PLAIN_FROM = 6


class Language:
    """What plain words look like: transitions of characters, and a dictionary."""

    def __init__(self, words: list[str], longest: int = 12):
        self.words = frozenset(w for w in words if len(w) >= 4)
        self.longest = longest
        size = 28
        counts = np.full((size, size), 0.1)
        for w in words:
            codes = [0, *map(self._code, w), 0]
            for a, b in zip(codes[:-1], codes[1:], strict=True):
                counts[a, b] += 1
        self.log = np.log2(counts / counts.sum(axis=1, keepdims=True))

    @staticmethod
    def _code(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27

    def transitions(self, value: str) -> float:
        """Mean log2 probability of a step from one character to the next."""
        codes = [self._code(c) for c in value.lower()]
        return float(self.log[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0

    def coverage(self, value: str) -> float:
        """Share of the characters inside dictionary words, the longest word from each place first."""
        low, at, covered = value.lower(), 0, 0
        while at < len(low):
            size = next((n for n in range(min(self.longest, len(low) - at), 3, -1) if low[at : at + n] in self.words), 0)
            covered += size
            at += size or 1
        return covered / max(1, len(low))


@lru_cache(maxsize=2)
def language(vocab_path: str) -> Language:
    """From the lower-case pieces of a public vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocab_path)
    pieces = (model.id_to_piece(i).removeprefix("▁") for i in range(model.get_piece_size()))
    return Language(sorted({p for p in pieces if len(p) >= 3 and p.isascii() and p.isalpha() and p.islower()}))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, rule) in the order of the text; none overlap."""
    found = []
    if _FORMAT_START.search(text):
        found += [(m.start(), m.end(), m.lastgroup, 0) for m in _FORMAT.finditer(text)]
    for m in _ASSIGNED.finditer(text):
        g = "q" if m["q"] is not None else "v"
        if len(m[g]) >= PLAIN_FROM or re.search(r"[^\W\d_]", m[g]) and re.search(r"[\W\d_]", m[g]):
            found.append((m.start(g), m.end(g), "assigned", 1))
    found = _united(found)
    for m in _RUN.finditer(text):
        value = m[0]
        if any(c in "0123456789" for c in value) and len(set(value)) > 3:
            found.append((m.start(), m.end(), "run", 2))
    found.sort(key=lambda x: (x[3], x[0] - x[1], x[0]))
    taken: list[tuple[int, int, str]] = []
    out = []
    for a, b, rule, _ in found:
        if len(found) < 2 or not any(a < d and c < b for c, d, _ in _near(taken, a, b)):
            _insert(taken, (a, b, rule))
            out.append((a, b, rule))
    return sorted(out)


def _united(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Formats and assigned values that overlap as one span, by the name of the most specific."""
    out: list[tuple[int, int, str, int]] = []
    for a, b, rule, k in sorted(found):
        if out and a < out[-1][1]:
            c, d, first, j = out[-1]
            out[-1] = (c, max(b, d), *min((j, first), (k, rule))[::-1])
        else:
            out.append((a, b, rule, k))
    return out


def _near(taken: list[tuple[int, int, str]], a: int, b: int) -> list[tuple[int, int, str]]:
    """Of spans in order that don't overlap, those that may overlap [a, b)."""
    import bisect

    at = bisect.bisect_left(taken, (a,))
    end = bisect.bisect_left(taken, (b,))
    return taken[max(0, at - 1) : end + 1]


def _insert(taken: list[tuple[int, int, str]], span: tuple[int, int, str]) -> None:
    import bisect

    bisect.insort(taken, span)


def numbers(text: str, start: int, end: int, rule: str, path: str, lang: Language) -> list[float]:
    """What the value itself and its marks say, in the order of NUMBERS."""
    value = text[start:end]
    n = len(value)
    counts = Counter(value)
    before, after = text[max(0, start - 8) : start], text[end : end + 1]
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in value]
    of_kind = Counter(kinds)
    repeat = longest = 1
    for a, b in zip(value[:-1], value[1:], strict=True):
        repeat = repeat + 1 if a == b else 1
        longest = max(longest, repeat)
    return [
        float(n),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        of_kind["d"] / n,
        of_kind["u"] / n,
        of_kind["l"] / n,
        of_kind["m"] / n,
        lang.transitions(value),
        sum(a != b for a, b in zip(kinds[:-1], kinds[1:], strict=True)) / n,
        lang.coverage(value),
        len(counts) / n,
        float(longest),
        float(all(c in string.hexdigits for c in value)),
        float(of_kind["d"] == n),
        float(rule in FORMATS),
        float(bool(re.search(r"(?::=|=>|[:=])\s*[\"']?$", before))),
        float(before.endswith(('"', "'")) and after in ('"', "'") and after != ""),
        float(path.count("/")),
    ]


def words_by(text: str, start: int, end: int, path: str) -> dict[str, list[str]]:
    """The words of each of PLACES, parts of joined names each by itself, in small letters."""
    cut = lambda s: [w.lower() for w in _PARTS.findall(s)]
    before = cut(text[max(0, start - 80) : start])[-6:]
    return {"last": before[-1:], "near": before, "after": cut(text[end : end + 40])[:2], "path": cut(path), "inside": [w for w in cut(text[start:end]) if len(w) > 2]}


class Evidence:
    """Log odds of each word, by place, of standing by a secret; words seen less than LEAST_SEEN times say nothing."""

    def __init__(self, rows: list[tuple[dict[str, list[str]], float]]):
        yes, no = defaultdict(Counter), defaultdict(Counter)
        for words, label in rows:
            for place, ws in words.items():
                (yes if label else no)[place].update(set(ws))
        n_yes, n_no = sum(label > 0 for _, label in rows), sum(label <= 0 for _, label in rows)
        self.odds = {
            place: {w: math.log((yes[place][w] + 0.5) / (n_yes + 1)) - math.log((no[place][w] + 0.5) / (n_no + 1)) for w in {*yes[place], *no[place]} if yes[place][w] + no[place][w] >= LEAST_SEEN}
            for place in PLACES
        }

    def of(self, words: dict[str, list[str]]) -> list[float]:
        """A place's strongest word for a secret and strongest against it, together."""
        out = []
        for place in PLACES:
            said = [self.odds[place].get(w, 0.0) for w in words[place]]
            out.append(max([0.0, *said]) + min([0.0, *said]))
        return out


@dataclass
class Model:
    forest: RandomForestClassificationModel
    evidence: Evidence


def labelled_findings(n: int = 4000, seed: int = 7) -> list[tuple[str, int, int, str, str, int]]:
    """(text, start, end, rule, path, label) made from rules: secrets of known formats and assigned ones, and what only looks like them."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choices(chars, k=k))
    alnum, b64, hexes = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    plain = "the of and river stone letter morning table quiet garden write number open value house under water follow config line server user".split()
    words = lambda k: " ".join(r.choices(plain, k=k))
    # How people name what is secret, what only looks so, and what stands in for a value.
    held = "password passwd pwd passphrase secret token apikey api_key api-key authToken credential credentials private_key access_key accessKey clientSecret".split()
    alike = "sha1 sha256 md5 hash checksum digest commit revision rev uuid guid etag version build id".split()
    counted = "phone card order invoice ticket serial isbn sku".split()
    stand_ins = "your_api_key_here1 changeme123456 xxxxxxxxxxxxxxxx0 example-token-12345 placeholder_value_1 test1234567890test dummyPassword1 insertTokenHere99 sampleSecret2024 todo_replace_this1".split()
    calls = "get_token_from_env os.environ.get request.headers settings.SECRET self.password required_field the_following config.lookup(key) ${API_TOKEN} process.env.SECRET".split()
    name = lambda: r.choice(held) if r.random() < 0.7 else f"{r.choice(['db', 'app', 'my', 'prod', 'client'])}_{r.choice(['password', 'secret', 'token', 'api_key'])}"

    def secret() -> tuple[str, str, str, str]:
        kind = r.randrange(9)
        if kind == 0:
            return "", r.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16), "", "aws_access_key"
        if kind == 1:
            return "", "gh" + r.choice("pousr") + "_" + pick(alnum, 36), "", "github_token"
        if kind == 2:
            return "", r.choice(["xoxb-", "xoxp-"]) + pick(string.digits, 11) + "-" + pick(alnum, 24), "", "slack_token"
        if kind == 3:
            return "", "sk_live_" + pick(alnum, 24), "", "stripe_key"
        if kind == 4:
            return "", "AIza" + pick(alnum + "_-", 35), "", "google_key"
        if kind == 5:
            return "", ".".join(("eyJ" + pick(alnum, 17), "eyJ" + pick(alnum, 40), pick(alnum + "_-", 43))), "", "jwt"
        quote = r.choice(['"', "'", ""])
        value = r.choice([lambda: pick(hexes, r.choice([16, 18, 20, 24, 32, 40, 64])), lambda: pick(b64, r.choice([20, 32, 40, 44])), lambda: pick(alnum + "!#%&*", r.randint(10, 24))])()
        return f"{name()}{r.choice([' = ', '=', ': ', ' := '])}{quote}", value, quote, "assigned"

    def other() -> tuple[str, str, str, str]:
        kind = r.randrange(11)
        if kind == 0:
            return f"{r.choice(alike)}{r.choice([' ', ': ', '='])}", pick(hexes, r.choice([32, 40, 64])), "", "run"
        if kind == 1:
            return "", pick("456", 1) + pick(string.digits, 15), "", "run"
        if kind == 2:
            return r.choice(["", "uuid ", "id="]), "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), "", "run"
        if kind == 3:
            return f"{name()}{r.choice([' = ', '=', ': '])}", r.choice(stand_ins), "", "assigned"
        if kind == 4:
            return "", "/".join(r.choices(plain, k=4)) + "/" + pick(string.digits, 4), "", "run"
        if kind == 5:
            return "", "".join(w.capitalize() for w in r.choices(plain, k=3)) + pick(string.digits, 2) + "Handler", "", "run"
        if kind == 6:
            return r.choice(["", "version ", "build "]), f"{r.randint(2000, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}-{pick(string.digits, 6)}", "", "run"
        if kind == 7:
            return f"{name()}{r.choice([' = ', ': '])}", r.choice(calls), "", "assigned"
        if kind == 8:
            return r.choice([f"{x} " for x in counted] + ["", ""]), pick(string.digits, r.randint(16, 20)), "", "run"
        if kind == 9:
            return "", "_".join(r.choices(plain, k=4)) + "_" + pick(string.digits, 2), "", "run"
        return r.choice(["", "commit ", "rev "]), pick(hexes, r.choice([32, 40])), "", "run"

    out = []
    for i in range(n):
        label = i % 2
        lead, value, tail, rule = secret() if label else other()
        before = f"{words(r.randint(0, 6))} {lead}"
        path = "/".join(r.choices(["src", "app", "lib", "config", "deploy", "tests", "docs", "examples"], k=r.randint(1, 3))) if r.random() < 0.5 else r.choice([f"src{r.randrange(40)}", "", "x"])
        if label and r.random() < 0.8:
            path = re.sub("tests|docs|examples", "main", path)
        out.append((before + value + tail + (" " + words(r.randint(1, 4)) if r.random() < 0.8 else ""), len(before), len(before) + len(value), rule, path, label))
    return out


def training_rows(findings: list[tuple[str, int, int, str, str, int]], vocab_path: str) -> tuple[list[list[float]], list[tuple[dict[str, list[str]], float]]]:
    lang = language(vocab_path)
    return [numbers(t, a, b, rule, path, lang) for t, a, b, rule, path, _ in findings], [(words_by(t, a, b, path), float(label)) for t, a, b, _, path, label in findings]


def fit(spark: SparkSession, findings: list[tuple[str, int, int, str, str, int]], vocab_path: str, trees: int = 40, depth: int = 8, seed: int = 11) -> Model:
    """A forest and its evidence from labelled findings (text, start, end, rule, path, label); they are as many as people can label."""
    if len({f[5] for f in findings}) < 2:
        raise ValueError("findings of both kinds are needed")
    own, words = training_rows(findings, vocab_path)
    rows = []
    for fold in range(FOLDS):  # evidence for a finding is learned from others
        rest = Evidence([w for i, w in enumerate(words) if i % FOLDS != fold])
        rows += [(own[i] + rest.of(words[i][0]), words[i][1]) for i in range(fold, len(words), FOLDS)]
    data = spark.createDataFrame(rows, "features array<double>, label double").select(array_to_vector("features").alias("features"), "label")
    return Model(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(data.coalesce(1)), Evidence(words))


def judged(spark: SparkSession, model: Model, findings: list[tuple[str, int, int, str, str, int]], vocab_path: str, threshold: float = 0.5) -> dict[str, float]:
    """precision and recall on labelled findings that the model hasn't seen."""
    own, words = training_rows(findings, vocab_path)
    rows = [(x + model.evidence.of(w), label) for x, (w, label) in zip(own, words, strict=True)]
    data = spark.createDataFrame(rows, "features array<double>, label double").select(array_to_vector("features").alias("features"), "label")
    said = model.forest.transform(data).select((vector_to_array("probability")[1] >= threshold).alias("said"), (F.col("label") > 0).alias("is"))
    hit, said_n, is_n = said.agg(F.count_if(F.col("said") & F.col("is")), F.count_if("said"), F.count_if("is")).first()
    return {"precision": hit / max(1, said_n), "recall": hit / max(1, is_n)}


def scan(docs: DataFrame, model: Model, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """A row a candidate: doc_id, print (the text's hash), start, end, rule, value_sha256, score, is_secret."""

    evidence = model.evidence

    def run(batches):
        lang = language(vocab_path)
        for batch in batches:
            for some in by_size(batch, "text"):
                out = []
                for doc, print_, text, path in zip(*(some.column(c).to_pylist() for c in ("doc_id", "print", "text", "path")), strict=True):
                    for a, b, rule in candidates(text):
                        out.append((doc, print_, a, b, rule, hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest(), numbers(text, a, b, rule, path, lang) + evidence.of(words_by(text, a, b, path))))
                cols = list(zip(*out, strict=True)) if out else [[]] * 7
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "print", "start", "end", "rule", "value_sha256", "numbers"])

    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"), path.alias("path"))
    found = rows.mapInArrow(run, "doc_id long, print long, start long, end long, rule string, value_sha256 string, numbers array<double>")
    scored = model.forest.transform(found.withColumn("features", array_to_vector("numbers")))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "print", "start", "end", "rule", "value_sha256", score.alias("score"), (score >= threshold).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """docs with the findings' secrets in the text replaced by the mark; a text without any stays as it is, also null."""
    secrets = written(findings.filter("is_secret").select(F.col("doc_id").alias("__secret_id"), F.col("print").alias("__secret_print"), "start", "end"), "secrets")
    by_text = secrets.groupBy("__secret_id", "__secret_print").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__secret_spans"))  # one text's own
    joined = docs.join(by_text, F.col(id_col).cast("long").eqNullSafe(F.col("__secret_id")) & (F.xxhash64(whole_text(text_col)) == F.col("__secret_print")), "left")
    pieces = F.aggregate(
        "__secret_spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.struct(F.concat(s["out"], F.substring(F.col(text_col), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark)).alias("out"), x["end"].alias("at")),
        lambda s: F.concat(s["out"], F.substring(F.col(text_col), (s["at"] + 1).cast("int"), F.length(text_col))),
    )
    return joined.withColumn(text_col, F.when(F.col("__secret_spans").isNull(), F.col(text_col)).otherwise(pieces)).select(*docs.columns)
