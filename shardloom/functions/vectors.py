"""Column expressions over ``ARRAY<DOUBLE>`` vectors; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where a lambda inside uses it."""
    return F.transform(F.array(value), body)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def l1_unit(v: Column) -> Column:
    """``v`` over the sum of its absolute values; the zero vector is an error."""
    size = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + F.abs(y))
    return let(size(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.raise_error(F.lit("vector without mass")))))


def unit(v: Column) -> Column:
    """``v`` scaled to length 1; the zero vector stays."""
    return let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n)))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def softmax(v: Column) -> Column:
    """Shifted by the largest entry."""
    e = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(e, lambda w: let(total(w), lambda t: F.transform(w, lambda x: x / t)))


def entropy_confidence(p: Column) -> Column:
    """``1 - H(p) / ln(size)``; 1 for at most one class."""
    h = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return F.when(F.size(p) <= 1, F.lit(1.0)).otherwise(1 - h / F.ln(F.size(p).cast("double")))


def l1_normalised(v: Column) -> Column:
    return let(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x)), lambda s: F.when(s == 0, v).otherwise(F.transform(v, lambda x: x / s)))


def argmax(v: Column) -> Column:
    """Position (from 0) of the first largest entry."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("long")


def count_nan(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: F.isnan(x))).cast("long")


def count_inf(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: F.abs(x) == float("inf"))).cast("long")
