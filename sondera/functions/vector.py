"""Vector functions over ARRAY<FLOAT> columns, from higher-order functions; sums are in DOUBLE.

A null vector, or two of different lengths, gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, b: Column) -> Column:
    product = F.aggregate(F.zip_with(a, b, lambda x, y: _double(x) * _double(y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def magnitude(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + _double(x) * _double(x)))


def is_zero(a: Column) -> Column:
    """Whether all components are 0; so is an empty vector."""
    return F.forall(a, lambda x: x == 0)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    return F.when(is_zero(a) | is_zero(b), F.lit(0.0)).otherwise(dot(a, b) / (magnitude(a) * magnitude(b)))


def normalize(a: Column) -> Column:
    """Unit vector; null for a zero vector, which has none (a NaN would sort before every similarity)."""
    return F.when(~is_zero(a), F.transform(a, lambda x: (_double(x) / magnitude(a)).cast("float")))


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of the vectors in ``tokens`` (an array of arrays) where ``mask`` is not 0; null if none is."""
    kept = F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda t: t["m"] != 0)
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.transform(F.get(kept, 0)["v"], _double), lambda s, t: F.zip_with(s, t["v"], lambda x, y: x + _double(y)))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def dimension(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))
