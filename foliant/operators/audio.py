"""Sound as arrays: reading and writing WAV, what a signal holds, and its levels and pauses. A clip is a row; numpy works on each."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 20 ms blocks, a floor of -60 dBFS, and a gate 20 dB under the level so far.
BLOCK_S, FLOOR_DB, GATE_DB = 0.02, -60.0, 20.0


def read_wav(raw: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples from -1 to 1 of PCM of 8, 16, 24 or 32 bits, or floats; channels are averaged."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, channels, rate, bits, data = 12, 1, 1, 0, 16, b""
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == 0xFFFE and len(body) >= 26:
                kind = struct.unpack("<H", body[24:26])[0]
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    data = data[: len(data) - len(data) % max(1, channels * bits // 8)]
    if kind == 3:
        x = np.frombuffer(data, "<f4" if bits == 32 else "<f8").astype(np.float64)
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
    else:
        x = np.frombuffer(data, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    return rate, x.reshape(-1, max(1, channels)).mean(axis=1)


def write_wav(rate: int, x: np.ndarray) -> bytes:
    """16-bit mono."""
    data = np.clip(np.rint(x * 32768), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def block_levels(x: np.ndarray, size: int) -> np.ndarray:
    """Root mean square of each whole or begun block."""
    if not len(x):
        return np.zeros(0)
    padded = np.concatenate([x, np.zeros(-len(x) % size)]).reshape(-1, size)
    counts = np.full(len(padded), size)
    counts[-1] = len(x) - size * (len(padded) - 1)
    return np.sqrt((padded**2).sum(axis=1) / counts)


def decibels(level: np.ndarray | float) -> np.ndarray:
    return 20 * np.log10(np.maximum(level, 1e-10))


# How far under a clip's peak silence is, how long a run of it, and the blocks it is looked for in.
QUIET_DB, LEAST_QUIET_S, QUIET_BLOCK_S = -50.0, 0.02, 0.005


def silences(x: np.ndarray, rate: int, under_peak_db: float = QUIET_DB, least_s: float = LEAST_QUIET_S, inside: bool = False) -> list[tuple[float, float]]:
    """(begin, end) in seconds of runs of blocks that lie so far under the clip's own peak, of least_s or longer.

    Voices differ in level, so nothing fixed tells silence; a clip without any sound is one run. inside leaves
    out the runs at the clip's begin and end.
    """
    peak = float(np.abs(x).max(initial=0.0))
    if not len(x):
        return []
    size, least = max(1, round(rate * QUIET_BLOCK_S)), round(rate * least_s)
    quiet = block_levels(x, size) < peak * 10 ** (under_peak_db / 20) if peak > 0 else np.ones(-(-len(x) // size), bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], quiet.astype(np.int8), [0]])))
    spans = [(a * size, min(b * size, len(x))) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    return [(a / rate, b / rate) for a, b in spans if b - a >= least and not (inside and (a == 0 or b == len(x)))]


def speech_level(x: np.ndarray, rate: int) -> float:
    """dBFS of the blocks that are speech: over the floor, and no more than the gate under the mean of those."""
    levels = block_levels(x, max(1, round(rate * BLOCK_S)))
    loud = levels[decibels(levels) > FLOOR_DB]
    if not len(loud):
        return FLOOR_DB
    mean = float(decibels(np.sqrt((loud**2).mean())))
    kept = loud[decibels(loud) > mean - GATE_DB]
    return float(decibels(np.sqrt((kept**2).mean())))


def levelled(x: np.ndarray, rate: int, target_db: float = -20.0, most_peak: float = 0.89) -> np.ndarray:
    """Gain to a speech level, as far as the peak allows."""
    peak = float(np.abs(x).max()) if len(x) else 0.0
    gain = 10 ** ((target_db - speech_level(x, rate)) / 20)
    return x * min(gain, most_peak / peak) if peak else x


def trimmed(x: np.ndarray, rate: int, keep_s: float = 0.05, floor_db: float = -45.0) -> tuple[np.ndarray, int]:
    """The signal without silence at its ends but for keep_s, and how many frames went at the begin."""
    levels = decibels(block_levels(x, max(1, round(rate * 0.01))))
    loud, size = np.flatnonzero(levels >= floor_db), max(1, round(rate * 0.01))
    if not len(loud):
        return x[:0], 0
    keep = round(keep_s * rate)
    a, b = max(0, int(loud[0]) * size - keep), min(len(x), (int(loud[-1]) + 1) * size + keep)
    return x[a:b], a


def with_pauses(x: np.ndarray, rate: int, at_s: list[float], pause_s: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The signal with silence put in at times, and (old frame, frames more from there on) for timings to follow."""
    parts, done, shift, moves = [], 0, 0, []
    gap = np.zeros(round(pause_s * rate))
    for t in sorted(at_s):
        a = min(len(x), max(done, round(t * rate)))
        parts += [x[done:a], gap]
        done, shift = a, shift + len(gap)
        moves.append((a, shift))
    return np.concatenate([*parts, x[done:]]) if parts else x, moves


def resampled(x: np.ndarray, rate: int, to: int, taps: int = 16) -> np.ndarray:
    """A windowed-sinc resample; its cut is the lower of the two rates'."""
    if rate == to or not len(x):
        return x
    n, cut = round(len(x) * to / rate), min(1.0, to / rate)
    where = np.arange(n) * rate / to
    near = np.floor(where).astype(int)[:, None] + np.arange(-taps + 1, taps + 1)
    away = where[:, None] - near
    weight = cut * np.sinc(cut * away) * (0.5 + 0.5 * np.cos(np.pi * np.clip(away / taps, -1, 1)))
    inside = (near >= 0) & (near < len(x))
    got = np.where(inside, x[np.clip(near, 0, len(x) - 1)], 0.0)
    return (got * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)


def measured(clips: DataFrame, id_col: str, content: str) -> DataFrame:
    """id, rate, seconds, peak, rms, largest_step, speech_db, silences (seconds) of WAV files; nulls and `error` for what isn't one."""
    kinds = "struct<rate:int,seconds:double,peak:double,rms:double,largest_step:double,speech_db:double,silences:array<struct<start:double,end:double>>,error:string>"

    @F.pandas_udf(kinds)
    def read(b: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in b:
            try:
                rate, x = read_wav(raw or b"")
                rms = float(np.sqrt((x**2).mean())) if len(x) else 0.0
                rows.append((rate, len(x) / rate, float(np.abs(x).max(initial=0)), rms, float(np.abs(np.diff(x)).max(initial=0)), speech_level(x, rate), [{"start": s, "end": e} for s, e in silences(x, rate)], None))
            except (ValueError, struct.error, ZeroDivisionError) as e:
                rows.append((None, None, None, None, None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["rate", "seconds", "peak", "rms", "largest_step", "speech_db", "silences", "error"])

    return clips.select(id_col, read(F.col(content)).alias("m")).select(id_col, "m.*")
