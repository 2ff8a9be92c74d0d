"""Words found by their pauses, pace with the pitch kept, and maps of frames through the stages."""

import itertools
import random

import numpy as np
import pytest

from foliant.operators import sound
from foliant.operators.audio import read_wav, write_wav

RATE = 8000
WORDS = "stone letter a river under morning it garden window".split()


def spoken(r, n, level=0.4):
    """(samples, text, bounds of words): words of a tone each, as long as they are to say, pauses at most marks and at some words without."""
    parts, text, bounds, at = [np.zeros(int(0.2 * RATE))], "", [], 0.2
    for i in range(n):
        w = r.choice(WORDS)
        s = (1 + len(w)) * 0.04
        parts.append(level * np.sin(np.arange(round(s * RATE)) * 2 * np.pi * 180 / RATE + 0.5))
        bounds.append((at, at + s))
        at += s
        mark = r.choice(["", "", "", ",", ".", ";"]) if i < n - 1 else "."
        text += w + mark + " "
        if i < n - 1 and (mark and r.random() < 0.9):
            gap = round(r.uniform(0.15, 0.4), 2)
            parts.append(np.zeros(round(gap * RATE)))
            at += gap
    return np.concatenate([*parts, np.zeros(int(0.3 * RATE))]), text, bounds


@pytest.mark.parametrize("level", [0.9, 0.02])
def test_all_bounds_of_generated_clips(level):
    r = random.Random(3)
    for _ in range(40):
        x, text, bounds = spoken(r, r.randint(1, 25), level)
        got = sound.word_times(x, RATE, text)
        assert len(got) == len(bounds)
        worst = max(max(abs(a - c), abs(b - d)) for (_, _, a, b), (c, d) in zip(got, bounds, strict=True))
        assert worst <= 0.02, (text, worst)


def test_the_matching_is_the_cheapest():
    r = random.Random(4)
    for _ in range(120):
        n, m = r.randint(2, 6), r.randint(0, 4)
        weights, marked = np.array([r.uniform(1, 8) for _ in range(n)]), np.array([r.random() < 0.4 for _ in range(n)])
        cuts = sorted(r.uniform(0.1, 4.9) for _ in range(2 * m))
        pauses = list(zip(cuts[::2], cuts[1::2], strict=True))
        every = (list(zip(ps, gs, strict=True)) for k in range(min(m, n - 1) + 1) for ps in itertools.combinations(range(m), k) for gs in itertools.combinations(range(n - 1), k))
        least = min(sound.matching_cost(pauses, weights, marked, 0.0, 5.0, c) for c in every)
        mine = sound.matching_cost(pauses, weights, marked, 0.0, 5.0, sound.matched(pauses, weights, marked, 0.0, 5.0))
        assert mine == pytest.approx(least, abs=1e-9)


@pytest.mark.parametrize("speed", [0.5, 0.8, 1.25, 2.0, 3.0])
@pytest.mark.parametrize("pitch", [110.0, 220.0, 400.0])
def test_pace_changes_and_pitch_stays(speed, pitch):
    rate = 16000
    x = 0.5 * np.sin(np.arange(2 * rate) * 2 * np.pi * pitch / rate)
    y, (old, new) = sound.stretched(x, rate, speed)
    assert len(y) == round(len(x) / speed) and list(new) == [0.0, len(y)] and list(old) == [0.0, len(x)]
    spectrum = np.abs(np.fft.rfft(y * np.hanning(len(y)), 16 * len(y)))
    found = np.argmax(spectrum) * rate / (16 * len(y))
    assert abs(found - pitch) <= 0.01 * pitch
    assert 0.8 < np.sqrt((y[800:-800] ** 2).mean()) / np.sqrt((x**2).mean()) < 1.2


def test_maps_rise_and_chain_exactly():
    r = random.Random(5)
    for _ in range(50):
        n = r.randint(100, 5000)

        def some(size):
            xs = np.unique([0.0, *(float(r.randrange(size)) for _ in range(4)), size])
            return xs, np.cumsum([0.0, *(d * r.choice([0.0, 0.5, 1.0, 2.0]) for d in np.diff(xs))])

        a = some(n)
        b = some(int(np.ceil(a[1][-1])) + 1)
        c = sound.then(a, b)
        at = np.array([r.uniform(0, n) for _ in range(200)])
        assert np.allclose(sound.mapped(c, at), sound.mapped(b, sound.mapped(a, at)), atol=1e-6) or (np.diff(a[1]) == 0).any()
        assert (np.diff(c[1]) >= -1e-9).all()


def test_words_follow_through_all_stages():
    r = random.Random(6)
    x, text, bounds = spoken(r, 12)
    words = [(a, b, text[e : e + 2]) for (_, e, _, _), (a, b) in zip(sound.word_times(x, RATE, text), bounds, strict=True)]
    y, times, (old, new) = sound.made_ready(x, RATE, words, 1.5, 0.05, {",": 0.2, ".": 0.3}, 0.4, -20.0)
    assert (np.diff(old) > 0).all() and (np.diff(new) >= 0).all()
    assert all(a < b for a, b in times) and all(b <= c + 1e-9 for (_, b), (c, _) in zip(times[:-1], times[1:], strict=True))
    marks = sum({",": 0.2, ".": 0.3}.get(next((c for c in f if c in ",."), ""), 0.0) for _, _, f in words[:-1])
    spoken_s = (bounds[-1][1] - bounds[0][0] + 0.04) / 1.5
    assert abs(len(y) / RATE - (spoken_s + 11 * 0.05 + marks + 0.4)) < 0.02
    gaps = [c - b for (_, b), (c, _) in zip(times[:-1], times[1:], strict=True)]
    assert min(gaps) >= 0.05 - 0.012
    # the same without any setting, but for the ends
    same, unchanged, _ = sound.made_ready(x, RATE, words)
    assert np.array_equal(same, sound.edges(x, RATE)[0]) and np.allclose([b - a for a, b in unchanged], [b - a for a, b in bounds], atol=1e-6)


def test_edges_of_clips(spark):
    assert sound.word_times(np.zeros(0), RATE, "a b") == [] and sound.word_times(np.ones(100), RATE, " .,") == []
    silent = sound.word_times(np.zeros(RATE), RATE, "aaa b")
    assert [(round(a, 3), round(b, 3)) for _, _, a, b in silent] == [(0.0, 0.667), (0.667, 1.0)]
    for speed in (1.0, 0.0, -1.0):
        assert np.array_equal(sound.stretched(np.arange(9.0), RATE, speed)[0], np.arange(9.0))
    assert len(sound.stretched(np.arange(50.0), RATE, 2.0)[0]) == 25 and len(sound.stretched(np.zeros(0), RATE, 2.0)[0]) == 0
    r = random.Random(7)
    x, text, bounds = spoken(r, 6)
    rows = [(1, bytearray(write_wav(RATE, x)), text, "k"), (2, bytearray(b"no"), text, "k"), (3, None, None, "k"), (4, bytearray(write_wav(RATE, x)), None, "k")]
    clips = spark.createDataFrame(rows, "id int, c binary, t string, words string")
    got = {g["id"]: g for g in sound.timed_words(clips, "id", "c", "t").collect()}
    assert len(got[1]["words"]) == 6 and abs(got[1]["words"][5]["end_s"] - bounds[5][1]) < 0.02 and got[2]["error"] and got[3]["error"] and got[4]["words"] == []
    made = {g["id"]: g for g in sound.ready_clips(clips, "id", "c", "t", speed=2.0, sentence_pause_s=0.5).collect()}
    rate, y = read_wav(bytes(made[1]["content"]))
    assert rate == RATE and len(y) / rate == made[1]["seconds"] and len(made[1]["words"]) == 6 and made[2]["error"] and made[4]["words"] == []
    assert sound.timed_words(clips.limit(0), "id", "c", "t").count() == 0


def test_clips_of_one_file_are_more_than_one_task(spark):
    from foliant.plans import sounds

    for query in (sounds.q1_ready_clips, sounds.q6_word_bounds):
        assert query(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_words_of_a_clip_are_found_once(spark):
    from foliant.plans import sounds

    plan = sounds.q6_word_bounds(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
