"""Vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_normalize(v: Column) -> Column:
    """Doubles of norm 1; a zero vector stays zero."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.arrays_zip(d.alias("x"), F.array_repeat(norm, F.size(d)).alias("n")), lambda e: F.when(e["n"] == 0, F.lit(0.0)).otherwise(e["x"] / e["n"]))


def quantize_int8(v: Column) -> Column:
    """round(127 x), halves away from zero, within ±127."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x * 127))).cast("tinyint"))


def dot_int8(a: Column, b: Column) -> Column:
    """The integer dot product; null where the lengths differ, as nothing is padded."""
    products = F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0), lambda s, x: s + x))


def squared_l2(dot: Column, norm_a: Column, norm_b: Column) -> Column:
    """From the dot product and both squared norms: one pass over a pair of vectors serves distance and cosine."""
    return norm_a + norm_b - 2 * dot


def cosine_int8(dot: Column) -> Column:
    """Of unit vectors, from their int8 dot product; a missing vector counts as 0."""
    return F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / 16129.0)).cast("float"), F.lit(0.0).cast("float"))
