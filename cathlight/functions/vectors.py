"""Numeric arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = lambda: F.lit(0.0)


def total(v: Column) -> Column:
    return F.aggregate(v, ZERO(), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    n = norm(v)
    return F.transform(v.cast("array<double>"), lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def interaction(a: Column, b: Column) -> Column:
    """a, b, their products and absolute differences, and their cosine, end to end."""
    both = lambda f: F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f)
    return F.concat(a.cast("array<double>"), b.cast("array<double>"), both(lambda x, y: x * y), both(lambda x, y: F.abs(x - y)), F.array(cosine(a, b)))


def position_code(position: Column, size: int) -> Column:
    """Sines and cosines of a position, interleaved."""
    angle = lambda i: position * F.exp(-(i - i % 2) * F.lit(9.210340371976184 / size))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))


def log_sum_exp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.log(F.aggregate(v, ZERO(), lambda a, x: a + F.exp(x - top)))


def entropy(counts: Column) -> Column:
    """Bits of a histogram."""
    n = total(counts.cast("array<double>"))
    return total(F.transform(counts, lambda c: F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0)))
