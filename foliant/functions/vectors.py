"""Dense vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either is zero."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length)


def packed(v: Column) -> Column:
    """scale and int8 codes of a vector: its largest component becomes 127."""
    top = F.aggregate(v, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / F.lit(127.0)).otherwise(F.lit(1.0))
    return F.struct(scale.alias("scale"), F.transform(v, lambda x: F.round(x.cast("double") / scale).cast("int")).alias("codes"))


def unpacked(p: Column) -> Column:
    return F.transform(p["codes"], lambda c: c * p["scale"])
