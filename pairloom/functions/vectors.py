"""Vector expressions on array<double> columns; JVM-side, any dimension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The smallest norm that a vector is divided by.
EPS = 1e-10


def doubles(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, then) -> Column:
    """then(value), with value computed once: an expression inside a lambda would be computed for each element."""
    return F.transform(F.array(value), then)[0]


def unit(v: Column) -> Column:
    """v over its length, which counts as EPS at least."""
    return let(v, lambda a: let(F.greatest(norm(a), F.lit(EPS)), lambda n: F.transform(a, lambda x: x / n)))


def mean2(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def unit_pair(a: Column, b: Column) -> Column:
    """The unit vector of the mean of two unit vectors."""
    return unit(mean2(unit(a), unit(b)))


def cosine(a: Column, b: Column) -> Column:
    both = F.struct(a.alias("a"), b.alias("b"))
    return let(both, lambda p: dot(p["a"], p["b"]) / (F.greatest(norm(p["a"]), F.lit(EPS)) * F.greatest(norm(p["b"]), F.lit(EPS))))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def mixed(a: Column, b: Column, share: Column) -> Column:
    """share of a and the rest of b: how an encoding and that of its augmented text are joined."""
    return F.zip_with(a, b, lambda x, y: x * share + y * (1 - share))


def over(v: Column, n: Column) -> Column:
    return F.transform(v, lambda x: x / n)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
