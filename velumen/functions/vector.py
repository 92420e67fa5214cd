"""Vector expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector]).cast("array<double>")


def checked(a: Column, dim: int) -> Column:
    """a, or an error where it has another length."""
    return F.when(a.isNull() | (F.size(a) == dim), a).otherwise(F.raise_error(F.lit(f"expected {dim} dimensions")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in [0, 2]; null if a side is null, NaN for a zero vector, an error for unequal lengths."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    size = norm(a) * norm(b)
    # Null is tested outside the bounds: greatest and least skip it.
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) / F.when(size != 0, size)))
    fits = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("different vector dimensions"))).when(size == 0, F.lit(float("nan"))).otherwise(bounded)
    return F.when(a.isNotNull() & b.isNotNull(), fits)


def l2_normalize(a: Column) -> Column:
    """a by its norm; a zero vector becomes NaN throughout."""
    n = norm(a.cast("array<double>"))
    return F.transform(a.cast("array<double>"), lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(x / F.when(n != 0, n)))


def parse(text: Column, dim: int | None = None) -> Column:
    """A vector from its JSON text; null where the text is no list of numbers."""
    v = F.from_json(text, "array<double>")
    return checked(v, dim) if dim else v
