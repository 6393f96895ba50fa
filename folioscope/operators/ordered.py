"""Order statistics of groups of any size: value histograms, dealt out by ranges, with prefix sums over the ranges.

Equal values are counted first. The histogram is range-partitioned by group and value and stored; a range's place follows
from the counts of the ranges before it, a value's from the values before it in its range. So no task sees a whole group, only a
range of its distinct values; the windows below are over a range of one group, or over the ranges that a group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def histogram(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n, before, total, range: each distinct value of a group, how often it is there and how many rows are smaller.

    Null values are left out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    counts = stored(counts.repartitionByRange(ranges(rows), *by, value).withColumn("range", F.spark_partition_id()), "histogram")
    sums = counts.groupBy(*by, "range").agg(F.sum("n").alias("held"))
    of_group = Window.partitionBy(*by)
    sums = sums.withColumns({"earlier": F.coalesce(F.sum("held").over(of_group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("held").over(of_group)})
    inside = F.sum("n").over(Window.partitionBy(*by, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    placed = counts.withColumn("inside", inside).join(sums, [*by, "range"])
    return placed.select(*by, value, "n", (F.col("earlier") + F.col("inside")).alias("before"), "total", "range")


def with_places(rows: DataFrame, by: list[str], value: str, **columns: str) -> DataFrame:
    """rows with columns made of n, before and total of their value in their group (SQL expressions); null where the value is null."""
    placed = histogram(rows, by, value).select(*by, value, *[F.expr(made).alias(name) for name, made in columns.items()])
    return rows.join(placed, [*by, value], "left").select(*rows.columns, *columns)


#: Of n, before and total: the rank that ties share, the percentile of it (0.5 of a group of one), the share of rows up to the value.
AVERAGE_RANK = "before + (n + 1) / 2"
MIDRANK = "case when total > 1 then (before + (n + 1) / 2 - 1) / (total - 1) else 0.5D end"
UP_TO = "(before + n) / total"


def quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """by and the interpolated quantiles of each group that has a value, by name."""
    placed = histogram(rows, by, value)
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col(value)))
    ends = []
    for name, q in wanted.items():
        place = F.lit(q) * (F.col("total") - 1)
        ends += [at(F.floor(place)).alias(f"{name}_low"), at(F.ceil(place)).alias(f"{name}_high")]
    found = placed.groupBy(*by).agg(*ends, F.max("total").alias("total"))
    out = []
    for name, q in wanted.items():
        place = F.lit(q) * (F.col("total") - 1)
        low, part = F.col(f"{name}_low"), place - F.floor(place)
        out.append((low + (F.col(f"{name}_high") - low) * part).alias(name))
    return found.select(*by, *out)


def false_discovery(rows: DataFrame, by: list[str], p: str, rate: float = 0.10) -> DataFrame:
    """rows with q and significant: p * n / rank of each group, made monotone from the largest p down, at most 1; null of a null p.

    Equal values of p have the q of the last of them, so the histogram of p is enough.
    """
    raw = histogram(rows, by, p).withColumn("raw", F.col(p) * F.col("total") / (F.col("before") + F.col("n")))
    raw = stored(raw, "false-discovery")
    later = raw.groupBy(*by, "range").agg(F.min("raw").alias("least"))
    later = later.withColumn("later", F.min("least").over(Window.partitionBy(*by).orderBy("range").rowsBetween(1, Window.unboundedFollowing))).drop("least")
    inside = F.min("raw").over(Window.partitionBy(*by, "range").orderBy(p).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    q = F.round(F.least(F.lit(1.0), "inside", "later"), 6)
    made = raw.withColumn("inside", inside).join(later, [*by, "range"]).select(*by, p, q.alias("q"), (q <= rate).alias("significant"))
    return rows.join(made, [*by, p], "left").select(*rows.columns, "q", "significant")


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place (from 1) in one complete order of all of them: numbers inside sorted ranges plus the rows of the ranges before.

    The window at the end is over one row a range.
    """
    ordered = rows.repartitionByRange(ranges(rows), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ordered = stored(ordered.withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), "ordered")
    sizes = ordered.groupBy("_range").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    return ordered.join(F.broadcast(sizes), "_range").select(*rows.columns, (F.col("_earlier") + F.col("_at") + 1).alias(name))
