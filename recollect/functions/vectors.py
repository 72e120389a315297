"""Vector column functions on array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions.text import _c


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product; 0 for vectors of different lengths or without components."""
    a, b = _c(a), _c(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total).otherwise(F.lit(0.0))


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalized(a: Column | str) -> Column:
    """Unit length; a zero vector is unchanged."""
    n = norm(a)
    return F.when(n == 0, _c(a)).otherwise(F.transform(_c(a), lambda x: x / n))


def cosine(a: Column | str, b: Column | str) -> Column:
    """True cosine; 0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
