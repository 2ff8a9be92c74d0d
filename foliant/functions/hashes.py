"""Hashes of words and runs of words in whole numbers that never leave 64 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF


def times32(a: Column, m: int) -> Column:
    """a * m modulo 2**32, in halves of 16 bits so that ANSI arithmetic can't overflow."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * F.lit(m)
    high = (F.shiftright(a, 16) * F.lit(m)).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)
    return (low + high).bitwiseAND(F.lit(_MASK))


def fnv_step(h: Column, x: Column) -> Column:
    return (h.bitwiseXOR(x) * F.lit(0x01000193)).bitwiseAND(F.lit(_MASK))


def fnv1a(word: Column) -> Column:
    """FNV-1a, 32 bits, over a word's UTF-16 units; a code point above U+FFFF is two."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(word, "UTF-16BE")), F.lit("(.{4})"), 1), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(units, F.lit(0x811C9DC5).cast("long"), fnv_step)


def murmur_final(h: Column) -> Column:
    h = times32(h.bitwiseXOR(F.shiftright(h, 16)), 0x85EBCA6B)
    h = times32(h.bitwiseXOR(F.shiftright(h, 13)), 0xC2B2AE35)
    return h.bitwiseXOR(F.shiftright(h, 16))
