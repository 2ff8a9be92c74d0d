"""Speech made ready to hear, and its words found in it.

A stage takes samples and gives new ones with a map from old frames to new: a rising line through (old, new) points. A chain
of stages has the chain of their maps, so a word's time follows it through all of them. The stages, in their order: silence
at the ends goes, the pace changes with the pitch kept, gaps come between words, pauses after marks and after the sentence, the level is set.

Words without timings are found by their pauses: a text says where a voice should pause, a signal where it does, and
the cheapest matching of both in order, by dynamic programming, fixes the words beside them; the words between two
pauses share their stretch by their lengths.

Defined results: no samples stay none; a text without words has none; a clip without any sound is shared out as a whole; what
isn't a WAV file gives nulls and an `error`; null texts are empty; further columns don't matter, no clips give no rows.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .audio import block_levels, levelled, read_wav, silences, write_wav

#: WSOLA: seconds of a window, and how far it may move to fit.
WINDOW_S, REACH_S = 0.030, 0.010
# Pauses that are looked for in a signal, in seconds and in decibels under its peak.
LEAST_PAUSE_S, PAUSE_DB = 0.07, -40.0
#: Costs of a matching: a pause that is at no word's end, a mark without a pause, a pause where there is no mark.
NO_WORD, NO_PAUSE, NO_MARK = 4.0, 1.5, 1.0
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
MARKS = ",.;:!?…—–"

Map = tuple[np.ndarray, np.ndarray]


# ---- maps of frames


def same(n: int) -> Map:
    return np.array([0.0, n]), np.array([0.0, n])


def mapped(m: Map, frames) -> np.ndarray:
    return np.interp(frames, m[0], m[1])


def then(first: Map, second: Map) -> Map:
    """The map of a stage after another: straight between the points of either."""
    x0, y0 = first
    back = np.interp(second[0], y0, x0)
    x = np.unique(np.concatenate([x0, back[(second[0] >= y0[0]) & (second[0] <= y0[-1])]]))
    return x, mapped(second, mapped(first, x))


# ---- stages


def edges(x: np.ndarray, rate: int, keep_s: float = 0.02) -> tuple[np.ndarray, Map]:
    """Without the silence at both ends but for a little."""
    quiet = silences(x, rate)
    n, keep = len(x), round(keep_s * rate)
    a = max(0, round(quiet[0][1] * rate) - keep) if quiet and quiet[0][0] == 0 else 0
    b = min(n, round(quiet[-1][0] * rate) + keep) if quiet and round(quiet[-1][1] * rate) == n else n
    if b <= a:
        return x, same(n)
    return x[a:b], (np.unique([0.0, a, b, n]), np.clip(np.unique([0.0, a, b, n]) - a, 0, b - a))


def stretched(x: np.ndarray, rate: int, speed: float) -> tuple[np.ndarray, Map]:
    """speed times as fast with the pitch kept: windows are laid over each other at the new pace, each taken from where it
    carries on best what went before (the highest correlation for its own energy)."""
    n = len(x)
    length = round(n / speed) if speed > 0 else n
    half = max(2, round(rate * WINDOW_S / 2))
    if not n or abs(speed - 1) < 1e-3 or speed <= 0:
        return x, same(n)
    line = (np.array([0.0, n]), np.array([0.0, length]))
    if n < 4 * half or length < 2 * half:
        return np.interp(np.arange(length) * speed, np.arange(n), x), line
    reach, shape = max(1, round(rate * REACH_S)), np.hanning(2 * half + 1)[:-1]
    src = np.concatenate([x, x[::-1][: 2 * half + 2 * reach + half]])
    src = np.concatenate([src, np.zeros(max(0, n + 4 * half + 2 * reach - len(src)))])
    out, at = np.zeros(length + 2 * half), 0
    square, sums, first = src * src, np.zeros(2 * reach + half + 2), np.where(np.arange(2 * half) < half, 1.0, shape)
    for k in range(-(-length // half)):
        if k:
            ideal = round(k * half * speed)
            low, high = max(0, ideal - reach), min(n - 1, ideal + reach)
            if low <= high:
                aim, near = src[at + half : at + 2 * half], src[low : high + half]
                power = sums[: len(near) + 1]
                square[low : high + half].cumsum(out=power[1:])
                energy = power[half:] - power[:-half]
                match = np.correlate(near, aim, "valid") / np.sqrt(np.maximum(energy, 1e-9))
                at = low + int(match[: high - low + 1].argmax())
            else:
                at = min(ideal, n - 1)
        out[k * half : k * half + 2 * half] += src[at : at + 2 * half] * (shape if k else first)
    return out[:length], line


def with_silence(x: np.ndarray, rate: int, at: list[tuple[int, float]]) -> tuple[np.ndarray, Map, list[int | None]]:
    """Silence of so many seconds put in at rising frames, each moved to the quietest block within 10 ms; and where each went, None for none."""
    parts, xs, ys, done, added, went = [], [0.0], [0.0], 0, 0, []
    block = max(1, round(rate * 0.002))
    for frame, seconds in at:
        gap = round(seconds * rate)
        low, high = max(done, frame - round(rate * 0.01)), min(len(x), frame + round(rate * 0.01))
        if gap <= 0:
            went.append(None)
            continue
        levels = block_levels(np.abs(x[low:high]), block)
        if len(levels) > 1:
            best = np.flatnonzero(levels == levels.min())
            frame = min(high, low + block * int(best[np.argmin(np.abs(low + block * best - frame))])) if levels.min() < levels.max() else frame
        frame = min(max(frame, done), len(x))
        parts += [x[done:frame], np.zeros(gap)]
        xs += [frame, frame + 1e-6]
        ys += [frame + added, frame + added + gap]
        done, added = frame, added + gap
        went.append(frame)
    return (np.concatenate([*parts, x[done:]]) if parts else x), (np.array([*xs, max(len(x), xs[-1] + 1e-6)]), np.array([*ys, len(x) + added])), went


def made_ready(x: np.ndarray, rate: int, words: list[tuple[float, float, str]], speed: float = 1.0, word_gap_s: float = 0.0, mark_pause_s: dict[str, float] | None = None, sentence_pause_s: float = 0.0, level_db: float | None = None) -> tuple[np.ndarray, list[tuple[float, float]], Map]:
    """All stages over one sentence; words are (begin, end, what follows the word) in seconds. The new samples, the words' new times, the map."""
    y, m = edges(x, rate)
    y, step = stretched(y, rate, speed)
    m = then(m, step)
    begins, ends = (np.array([float(mapped(m, w[k] * rate)) for w in words]) for k in (0, 1))
    pauses = mark_pause_s or {}
    follow = [max((pauses.get(c, 0.0) for c in after), default=0.0) for _, _, after in words[:-1]]
    for seconds in ([word_gap_s] * len(follow), follow):
        y, step, went = with_silence(y, rate, [(int(round(e)), s) for e, s in zip(ends[:-1], seconds, strict=True)])
        m = then(m, step)
        for i, frame in enumerate(went):  # a word ends before its silence, and the next begins behind it
            if frame is not None:
                ends[i], begins[i + 1] = min(ends[i], frame), max(begins[i + 1], frame + 1e-3)
        begins, ends = mapped(step, begins), mapped(step, ends)
    n = len(y)
    y = np.concatenate([y, np.zeros(round(sentence_pause_s * rate))])
    m = then(m, (np.array([0.0, n]), np.array([0.0, n])))
    if level_db is not None:
        y = levelled(y, rate, level_db)
    return y, [(float(a) / rate, float(e) / rate) for a, e in zip(begins, ends, strict=True)], m


# ---- words by their pauses


def words_of(text: str) -> list[tuple[int, int, float, bool]]:
    """(start, end, how long it takes to say, whether a mark follows) of each word: a letter is one, a digit four, and every word one more."""
    found = list(WORD.finditer(text))
    out = []
    for m, after in zip(found, [*found[1:], *([None] if found else [])], strict=True):
        between = text[m.end() : after.start() if after else len(text)]
        out.append((m.start(), m.end(), 1.0 + sum(4 if c.isdigit() else 1 for c in m[0] if c.isalnum()), any(c in MARKS for c in between)))
    return out


def matching_cost(pauses: list[tuple[float, float]], weights: np.ndarray, marked: np.ndarray, begin: float, end: float, chosen: list[tuple[int, int]]) -> float:
    """What a matching costs: chosen are (pause, word before it), rising in both."""
    ends = np.concatenate([[0.0], np.cumsum(weights)])
    rest = sum(b - a for a, b in pauses)
    pace = max(1e-6, (end - begin - rest) / max(1e-9, ends[-1]))
    cost, stops = 0.0, [(-1, -1), *chosen, (len(pauses), len(weights) - 1)]
    for (p, g), (q, h) in zip(stops[:-1], stops[1:], strict=True):
        skipped = pauses[p + 1 : q]
        since = begin if p < 0 else pauses[p][1]
        until = end if q == len(pauses) else pauses[q][0]
        said = until - since - sum(b - a for a, b in skipped)
        should = pace * (ends[h + 1] - ends[g + 1])
        cost += ((said - should) / (0.25 * should + 0.05)) ** 2 + NO_WORD * len(skipped) + NO_PAUSE * float(marked[g + 1 : h].sum())
        if q < len(pauses):
            cost += 0.0 if marked[h] else NO_MARK
    return float(cost)


def matched(pauses: list[tuple[float, float]], weights: np.ndarray, marked: np.ndarray, begin: float, end: float) -> list[tuple[int, int]]:
    """The cheapest matching of pauses to the words that they follow; by pause and word, from the left."""
    m, n = len(pauses), len(weights)
    if not m or n < 2:
        return []
    ends = np.concatenate([[0.0], np.cumsum(weights)])
    silent = np.concatenate([[0.0], np.cumsum([b - a for a, b in pauses])])
    pace = max(1e-6, (end - begin - silent[-1]) / max(1e-9, ends[-1]))
    marks = np.concatenate([[0], np.cumsum(marked)])
    words = np.arange(n - 1)  # a pause inside is after any word but the last

    def between(p: int, g, q: int, h):
        """Of stops (p, g) and (q, h) that follow one another; g and h may be arrays."""
        since = begin if p < 0 else pauses[p][1]
        until = end if q == m else pauses[q][0]
        said = until - since - (silent[q] - silent[p + 1])
        should = pace * (ends[h + 1] - ends[g + 1])
        should = np.maximum(should, 0.0)
        return ((said - should) / (0.25 * should + 0.05)) ** 2 + NO_WORD * (q - p - 1) + NO_PAUSE * (marks[h] - marks[g + 1])

    best = np.full((m, n - 1), np.inf)
    came: dict[tuple[int, int], tuple[int, int]] = {}
    own = np.where(marked[:-1], 0.0, NO_MARK)
    for q in range(m):
        start = between(-1, -1, q, words) + own
        best[q] = start
        for p in range(q):
            way = best[p][:, None] + between(p, words[:, None], q, words[None, :]) + own[None, :]
            way = np.where(words[:, None] < words[None, :], way, np.inf)
            from_ = way.argmin(axis=0)
            better = way[from_, words] < best[q] - 1e-12
            best[q] = np.where(better, way[from_, words], best[q])
            for h in np.flatnonzero(better).tolist():
                came[q, h] = (p, int(from_[h]))
    last = [(float(between(-1, -1, m, n - 1)), None)]
    for p in range(m):
        total = best[p] + between(p, words, m, n - 1)
        last.append((float(total.min()), (p, int(total.argmin()))))
    stop = min(last, key=lambda x: x[0])[1]
    out = []
    while stop is not None:
        out.append(stop)
        stop = came.get(stop)
    return out[::-1]


def word_times(x: np.ndarray, rate: int, text: str) -> list[tuple[int, int, float, float]]:
    """(start and end in the text, begin and end in seconds) of each word."""
    words = words_of(text)
    if not words or not len(x):
        return []
    quiet = silences(x, rate, PAUSE_DB, LEAST_PAUSE_S)
    n = len(x) / rate
    sound = not (len(quiet) == 1 and quiet[0] == (0.0, n))
    begin = quiet[0][1] if sound and quiet and quiet[0][0] == 0 else 0.0
    end = quiet[-1][0] if sound and quiet and abs(quiet[-1][1] - n) < 1e-9 else n
    inside = [s for s in quiet if s[0] > 0 and s[1] < n - 1e-9] if sound else []
    weights, marked = np.array([w for _, _, w, _ in words]), np.array([k for _, _, _, k in words])
    stops = [(begin, begin, -1), *((*inside[p], g) for p, g in matched(inside, weights, marked, begin, end)), (end, end, len(words) - 1)]
    out = []
    for (_, since, g), (until, _, h) in zip(stops[:-1], stops[1:], strict=True):
        share = weights[g + 1 : h + 1]
        at = since + (until - since) * np.concatenate([[0.0], np.cumsum(share)]) / max(1e-9, share.sum())
        out += [(words[g + 1 + i][0], words[g + 1 + i][1], float(at[i]), float(at[i + 1])) for i in range(len(share))]
    return out


# ---- tables


def timed_words(clips: DataFrame, id_col: str, content: str, text: str) -> DataFrame:
    """id, words (array of start and end in the text, begin_s and end_s), error of WAV files and what they say."""
    kind = "struct<words:array<struct<start:int,end:int,begin_s:double,end_s:double>>,error:string>"

    @F.pandas_udf(kind)
    def find(raw: pd.Series, said: pd.Series) -> pd.DataFrame:
        rows = []
        for r, t in zip(raw, said, strict=True):
            try:
                rate, x = read_wav(r or b"")
                rows.append(([{"start": a, "end": b, "begin_s": c, "end_s": d} for a, b, c, d in word_times(x, rate, t)], None))
            except (ValueError, struct.error, ZeroDivisionError) as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["words", "error"])

    # said to be nondeterministic, so that no filter on the words moves under an exchange and finds them a second time
    return clips.select(id_col, find.asNondeterministic()(F.col(content), F.coalesce(F.col(text), F.lit(""))).alias("m")).select(id_col, "m.*")


def ready_clips(clips: DataFrame, id_col: str, content: str, text: str, **settings) -> DataFrame:
    """id, content (a WAV file), seconds, words, error: the stages over WAV files, with the words' times after them."""
    kind = "struct<content:binary,seconds:double,words:array<struct<start:int,end:int,begin_s:double,end_s:double>>,error:string>"

    @F.pandas_udf(kind)
    def make(raw: pd.Series, said: pd.Series) -> pd.DataFrame:
        rows = []
        for r, t in zip(raw, said, strict=True):
            try:
                rate, x = read_wav(r or b"")
                words = word_times(x, rate, t)
                follows = [t[b : (words[i + 1][0] if i + 1 < len(words) else len(t))] for i, (_, b, _, _) in enumerate(words)]
                y, times, _ = made_ready(x, rate, [(c, d, f) for (_, _, c, d), f in zip(words, follows, strict=True)], **settings)
                rows.append((write_wav(rate, y), len(y) / rate, [{"start": a, "end": b, "begin_s": c, "end_s": d} for (a, b, _, _), (c, d) in zip(words, times, strict=True)], None))
            except (ValueError, struct.error, ZeroDivisionError) as e:
                rows.append((None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["content", "seconds", "words", "error"])

    return clips.select(id_col, make.asNondeterministic()(F.col(content), F.coalesce(F.col(text), F.lit(""))).alias("m")).select(id_col, "m.*")
