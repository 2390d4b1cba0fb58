"""Scalar functions over columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_of(v: Column) -> Column:
    """Mean of an array of doubles; null for an empty one."""
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))


def rising(v: Column) -> Column:
    """Whether the second half's mean is above the first half's; false for fewer than 2 values."""
    half = F.floor(F.size(v) / 2).cast("int")
    return F.coalesce(mean_of(F.slice(v, half + 1, F.size(v) - half)) > mean_of(F.slice(v, F.lit(1), half)), F.lit(False))


def crosses_above(a: Column, b: Column) -> Column:
    """Whether a ends at or above b after being below it one value before."""
    return F.coalesce((F.try_element_at(a, F.lit(-2)) < F.try_element_at(b, F.lit(-2))) & (F.try_element_at(a, F.lit(-1)) >= F.try_element_at(b, F.lit(-1))), F.lit(False))


def majority_positive(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: x > 0)) * 2 > F.size(v)


def trigrams(s: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3))))


def trigram_distance(a: Column, b: Column) -> Column:
    """1 - Jaccard similarity of the character trigrams of two strings."""
    x, y = trigrams(a), trigrams(b)
    return 1 - F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def falling(v: Column) -> Column:
    """Whether the second half's mean is below the first half's; false for fewer than 2 values."""
    half = F.floor(F.size(v) / 2).cast("int")
    return F.coalesce(mean_of(F.slice(v, half + 1, F.size(v) - half)) < mean_of(F.slice(v, F.lit(1), half)), F.lit(False))


def crosses_below(a: Column, b: Column) -> Column:
    """Whether a ends at or below b after being above it one value before."""
    return crosses_above(F.transform(a, lambda x: -x), F.transform(b, lambda x: -x))


def padded(v: Column, n: int, default: float) -> Column:
    """The last n values of an array, with defaults in front where there are fewer."""
    some = F.slice(v, F.greatest(F.size(v) - n + 1, F.lit(1)), F.lit(n))
    return F.concat(F.array_repeat(F.lit(default), n - F.size(some)), some)


#: The rational approximation 26.2.17 of the normal distribution in Abramowitz and Stegun (error under 1e-7).
_TAIL, _SERIES = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def bound(x: Column, of) -> Column:  # noqa: ANN001
    """of(x) with x worked out once, however often ``of`` names it."""
    return F.element_at(F.transform(F.array(x), of), 1)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function, to seven places; null for null."""

    def of(v: Column) -> Column:
        tail = bound(1 / (1 + _TAIL * F.abs(v)), lambda t: F.exp(-v * v / 2) / math.sqrt(2 * math.pi) * sum((F.lit(c) * F.pow(t, F.lit(k + 1.0)) for k, c in enumerate(_SERIES)), F.lit(0.0)))
        return bound(tail, lambda y: F.when(v >= 0, 1 - y).otherwise(y))

    return bound(x, of)


#: The rational approximation 26.2.23 of the normal quantile there (error under 5e-4), then two Newton steps.
_ABOVE, _BELOW = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)


def normal_ppf(p: Column) -> Column:
    """The standard normal quantile of p in (0, 1); null outside."""

    def first(t: Column) -> Column:
        return t - (_ABOVE[0] + _ABOVE[1] * t + _ABOVE[2] * t * t) / (1 + _BELOW[0] * t + _BELOW[1] * t * t + _BELOW[2] * t * t * t)

    def better(x: Column, q: Column) -> Column:
        return bound(x, lambda v: v - (normal_cdf(v) - q) * math.sqrt(2 * math.pi) * F.exp(v * v / 2))

    def of(q: Column) -> Column:
        far = bound(F.sqrt(-2 * F.log(F.least(q, 1 - q))), first)
        return F.when((q > 0) & (q < 1), better(better(bound(far, lambda x: F.when(q < 0.5, -x).otherwise(x)), q), q))

    return bound(p, of)
