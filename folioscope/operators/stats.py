"""Correlations of ranks, their p values, quartiles, summaries and bands. Ranks and quantiles are those of ordered.py."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import ordered as O


def spearman(rows: DataFrame, by: list[str], x: str, y: str, control: str | None = None, least: int = 4) -> DataFrame:
    """n, spearman, direction and p of each group; with a control also the partial correlation of ranks.

    Rows with a null in any used column are left out first. Groups of fewer than ``least`` rows or without variance
    give no row; a partial correlation needs 4 rows and a control that is not collinear with either side, else null.
    """
    used = [x, y] + ([control] if control else [])
    rows = rows.dropna(subset=used)
    ranked = stored(rows, "ranked")
    for k, c in enumerate(used):
        ranked = O.with_places(ranked, by, c, **{f"_r{k}": O.AVERAGE_RANK})
    pairs = [("xy", 0, 1)] + ([("xz", 0, 2), ("yz", 1, 2)] if control else [])
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), *[_correlation(f"_r{a}", f"_r{b}").alias(name) for name, a, b in pairs])
    out = out.where((F.col("n") >= least) & F.col("xy").isNotNull())
    columns = [*by, "n", F.round("xy", 4).alias("spearman"), direction(F.col("xy")).alias("direction"), p_value(F.col("xy"), F.col("n")).alias("p")]
    if control:
        free = (F.abs("xz") < 1 - 1e-12) & (F.abs("yz") < 1 - 1e-12) & (F.col("n") >= 4)
        partial = F.when(free, (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2)))
        columns += [F.round(partial, 4).alias("partial"), direction(partial).alias("partial_direction")]
    return out.select(*columns)


def _correlation(x: str, y: str) -> Column:
    """corr(), but null where a side doesn't vary, which corr() divides by."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def direction(value: Column) -> Column:
    close = F.round(value, 12)
    return F.when(close > 0, "positive").when(close < 0, "negative").when(close == 0, "zero")


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, to 15 digits after the point, by its series of positive terms."""
    start = F.struct(x.alias("term"), x.alias("total"))
    step = lambda a, k: a["term"] * 2 * x * x / (2 * k + 1)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, lambda a, k: F.struct(step(a, k).alias("term"), (a["total"] + step(a, k)).alias("total")))["total"]
    return F.when(x > 6, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series))


def p_value(r: Column, n: Column) -> Column:
    """Two-sided normal approximation of a rank correlation's p value, rounded to 6; null of fewer than 4, 0 of a perfect one."""
    size = F.abs(r)
    p = erfc(size * F.sqrt(n - 1) / math.sqrt(2))
    return F.when(n < 4, None).when(size >= 1 - 1e-12, 0.0).otherwise(F.round(p, 6))


def order_quartiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """q1 and q3 of each group: the elements at places n div 4 and 3n div 4 of the sorted values (no interpolation)."""
    placed = O.histogram(rows, by, value)
    at = lambda part: F.min(F.when(F.col("before") + F.col("n") > F.floor(F.col("total") * part / 4), F.col(value)))
    return placed.groupBy(*by).agg(at(1).alias("q1"), at(3).alias("q3"))


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, p10, median, p90 (interpolated), min and max of each group, rounded to 4."""
    plain = rows.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.min(value), 4).alias("min"), F.round(F.max(value), 4).alias("max"))
    inner = O.quantiles(rows, by, value, {"p10": 0.1, "median": 0.5, "p90": 0.9})
    return plain.join(inner.select(*by, *[F.round(c, 4).alias(c) for c in ("p10", "median", "p90")]), by, "left")


def entropy(parts: list[Column]) -> Column:
    """Normalised entropy of the parts' shares: 0 if one holds all or there is nothing, 1 if all are equal."""
    total = sum(parts[1:], parts[0])
    terms = [F.when(c > 0, -(c / total) * F.log(c / total)).otherwise(0.0) for c in parts]
    return F.when(total > 0, sum(terms[1:], terms[0]) / math.log(len(parts))).otherwise(0.0)


def band(value: Column) -> Column:
    """Thirds of a percentile."""
    return F.when(value < 1 / 3, "low").when(value < 2 / 3, "medium").otherwise("high")
