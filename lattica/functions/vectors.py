"""Vectors as array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def to_vector(df: DataFrame, columns: list[str], out: str = "vec") -> DataFrame:
    """Wide number columns as one array; the columns go."""
    return df.withColumn(out, F.array(*(F.col(c).cast("double") for c in columns))).drop(*columns)


def to_wide(df: DataFrame, vec: str, width: int, prefix: str = "e_") -> DataFrame:
    return df.select("*", *(F.get(vec, F.lit(i)).alias(f"{prefix}{i:04d}") for i in range(width))).drop(vec)


def total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))


def normalise(vec: Column, reject_zero: bool = False) -> Column:
    """The vector at length 1; a zero vector stays zero, or becomes null."""
    n = norm(vec)
    scaled = F.transform(vec, lambda x: x / n)
    return F.when(n > 0, scaled).otherwise(F.lit(None) if reject_zero else vec)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def argmax(vec: Column) -> Column:
    """Place of the largest entry, from 0; the first of equals."""
    return (F.array_position(vec, F.array_max(vec)) - 1).cast("int")


def all_finite(vec: Column) -> Column:
    return F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def sparsify(vec: Column, below: float = 0.01) -> Column:
    return F.transform(vec, lambda x: F.when(F.abs(x) < below, 0.0).otherwise(x))


def probabilities(vec: Column) -> Column:
    """Exponentials that sum to one."""
    e = F.transform(vec, F.exp)
    s = total(e)
    return F.transform(e, lambda x: x / s)


def _entropy_part(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)


def js_distance(a: Column, b: Column) -> Column:
    """Root of the Jensen-Shannon divergence in bits, of two histograms that sum to one."""
    parts = F.zip_with(a, b, lambda x, y: (_entropy_part(x, (x + y) / 2) + _entropy_part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(total(parts), F.lit(0.0)))


def project(vec: Column, out: int, seed: int = 0) -> Column:
    """Random projection by a seeded matrix of signs, scaled to keep lengths in expectation."""
    return F.array(*(_projected(vec, k, seed) * out**-0.5 for k in range(out)))


def _projected(vec: Column, k: int, seed: int) -> Column:
    return total(F.transform(vec, lambda x, i: F.when(F.xxhash64(i, F.lit(k), F.lit(seed)) % 2 == 0, x).otherwise(-x)))
