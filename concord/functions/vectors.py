"""Vectors as ARRAY<DOUBLE> columns, and means of their extremes, all in Spark SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0).cast("double"), lambda s, x: s + x)


def dot(left: Column, right: Column) -> Column:
    """Sum of products, in the order of the elements."""
    return _sum(F.zip_with(left, right, lambda a, b: a * b))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(left: Column, right: Column, eps: float = 1e-12) -> Column:
    """Cosine; 0 where the product of the norms is not above ``eps``."""
    if not eps > 0:
        raise ValueError("eps must be positive")
    size = norm(left) * norm(right)
    return F.when(size > eps, dot(left, right) / size).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector divided by its norm; a zero vector is an error."""
    n = norm(v)
    sure = F.when(n == 0, F.raise_error(F.lit("the encoder returned a zero vector")).cast("double")).otherwise(n)
    return F.zip_with(v, F.array_repeat(sure, F.size(v)), lambda x, s: x / s)


def mean(array: Column) -> Column:
    """Mean; null of an empty array."""
    return F.try_divide(_sum(array), F.size(array))


def mean_extreme(array: Column, k: int, largest: bool) -> Column:
    """Mean of the k smallest or largest elements, of all where there are fewer."""
    if k < 1:
        raise ValueError("k must be positive")
    ordered = F.sort_array(array, asc=not largest)
    return mean(F.slice(ordered, 1, k))


def mean_extreme_strict(array: Column, k: int, largest: bool, what: str) -> Column:
    """The same, but fewer than k elements are an error."""
    value = mean_extreme(array, k, largest)
    short = F.raise_error(F.concat(F.lit(f"k must be from 1 to the number of {what}, "), F.size(array).cast("string"))).cast("double")
    return F.when(F.size(array) < k, short).otherwise(value)


def logsumexp(array: Column) -> Column:
    """log of the sum of exponentials, safe for large values."""
    top = F.array_max(array)
    return top + F.log(_sum(F.zip_with(array, F.array_repeat(top, F.size(array)), lambda x, t: F.exp(x - t))))
