"""Vector arithmetic on float arrays, summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for different lengths or a zero vector."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector over its length, as doubles; a zero vector stays."""
    # Bound to the lambda's n, the length is summed once for a vector and not once for each of its numbers.
    over = lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))
    return F.get(F.transform(F.array(norm(a)), over), 0)


def running_mean(mean: Column, new: Column, n: Column) -> Column:
    """Mean after the n-th vector."""
    return F.zip_with(mean, new, lambda m, x: m * ((n - 1) / n) + x * (F.lit(1.0) / n))


def quantize(a: Column) -> Column:
    """Scalar quantization to signed bytes by the largest magnitude: struct(codes, scale)."""
    top = F.aggregate(a, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(1.0)
    return F.struct(F.transform(a, lambda x: F.round(x.cast("double") / scale).cast("tinyint")).alias("codes"), scale.alias("scale"))
