"""Similarity expressions over array and number columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def set_jaccard(left: Column, right: Column) -> Column:
    """Shared over all distinct elements; 0 where both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(0.0)


def coverage(left: Column, right: Column) -> Column:
    """The share of the left set that the right one holds; 0 of an empty set."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(left, right)), F.size(F.array_distinct(left))), F.lit(0.0))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two number arrays; 0 where one has no length."""
    dot = total(F.zip_with(left, right, lambda a, b: a * b))
    length = F.sqrt(total(F.transform(left, lambda x: x * x))) * F.sqrt(total(F.transform(right, lambda x: x * x)))
    return F.coalesce(F.try_divide(dot, length), F.lit(0.0))


def log_cosine(left: Column, right: Column) -> Column:
    """Cosine of log1p of the values, negative ones as 0."""
    logs = lambda xs: F.transform(xs, lambda x: F.log1p(F.greatest(x, F.lit(0.0))))
    return cosine(logs(left), logs(right))


def ratio_similarity(left: Column, right: Column) -> Column:
    """Mean of smaller over larger, leaving out places where both are 0; 1 if none is left."""
    ratios = F.array_compact(F.zip_with(left, right, lambda a, b: F.when((a != 0) | (b != 0), F.least(a, b) / F.greatest(a, b))))
    return F.coalesce(F.try_divide(total(ratios), F.size(ratios)), F.lit(1.0))


def shares(values: Column) -> Column:
    """Each value over the sum; zeros where the sum is 0."""
    return F.transform(values, lambda x: F.coalesce(F.try_divide(x, total(values)), F.lit(0.0)))


def composition_similarity(left: Column, right: Column) -> Column:
    """Sum of the smaller shares (the arrays are shares already)."""
    return total(F.zip_with(left, right, lambda a, b: F.least(a, b)))


def number_ratio(left: Column, right: Column) -> Column:
    """Smaller over larger; 1 where both are 0."""
    return F.when(F.greatest(left, right) > 0, F.least(left, right) / F.greatest(left, right)).otherwise(1.0)


def weighted(parts: list[tuple[Column, float]]) -> Column:
    out = parts[0][0] * parts[0][1]
    for value, weight in parts[1:]:
        out = out + value * weight
    return out


def weighted_applicable(parts: list[tuple[Column, Column, float]]) -> tuple[Column, Column]:
    """Of (value, applies, weight): the mean weighted over what applies (0 if nothing does), and the weight that applies."""
    weight = weighted([(F.when(ok, 1.0).otherwise(0.0), w) for _, ok, w in parts])
    value = weighted([(F.when(ok, v).otherwise(0.0), w) for v, ok, w in parts])
    return F.coalesce(F.try_divide(value, weight), F.lit(0.0)), weight


def z_distance(left: Column, right: Column, deviations: Column) -> Column:
    """Root mean square of the differences in standard deviations, over places where both are known; null without any."""
    terms = F.zip_with(F.zip_with(left, right, lambda a, b: a - b), deviations, lambda d, s: d / s)
    known = F.array_compact(F.transform(terms, lambda x: x * x))
    return F.sqrt(F.try_divide(total(known), F.size(known)))


def z_distance_of(lefts: list[Column], rights: list[Column], deviations: list[Column]) -> Column:
    """z_distance() of columns in place of arrays, which are compiled with the rest of a stage."""
    sums, known = F.lit(0.0), F.lit(0)
    for left, right, deviation in zip(lefts, rights, deviations, strict=True):
        term = (left - right) / deviation
        sums, known = sums + F.coalesce(term * term, F.lit(0.0)), known + F.when(term.isNotNull(), 1).otherwise(0)
    return F.sqrt(F.try_divide(sums, known))
