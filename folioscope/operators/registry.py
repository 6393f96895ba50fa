"""Linkage of two registers, priority picks, aliases, cells of comparable objects, label stores, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linkage(sources: DataFrame, exports: DataFrame, key: str) -> DataFrame:
    """Full outer, many to many, on a content key: link_status and how often either side holds the key."""
    l = sources.withColumn("source_match_count", F.count("*").over(Window.partitionBy(key)))
    r = exports.withColumn("export_match_count", F.count("*").over(Window.partitionBy(key)))
    out = l.join(r, key, "full_outer")
    status = F.when(F.col("source_match_count").isNull(), "export_only").when(F.col("export_match_count").isNull(), "source_only").otherwise("matched")
    return out.withColumns(
        {
            "link_status": status,
            "source_match_count": F.coalesce("source_match_count", F.lit(0)),
            "export_match_count": F.coalesce("export_match_count", F.lit(0)),
        }
    )


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a complete order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def resolve_alias(rows: DataFrame, aliases: DataFrame, fields: list[str], out: str = "canonical") -> DataFrame:
    """The canonical name of the first of the fields that the alias table (alias, canonical) knows; the alias table is broadcast
    when Spark finds it small."""
    for k, field in enumerate(fields):
        rows = rows.join(aliases.select(F.col("alias").alias(field), F.col("canonical").alias(f"_c{k}")), field, "left")
    return rows.withColumn(out, F.coalesce(*[F.col(f"_c{k}") for k in range(len(fields))])).drop(*[f"_c{k}" for k in range(len(fields))])


def first_seen_mode(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The most frequent value of each key; on a tie the one seen first."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(position).alias("seen"))
    return first_by(counts, keys, [F.desc("n"), F.col("seen")]).select(*keys, value, "n")


def most_common(rows: DataFrame, keys: list[str], value: str, position: str, most: int) -> DataFrame:
    """The ``most`` most frequent values of each key as one text (value:count, commonest first, the first seen on a tie)."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(position).alias("seen"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "seen"))
    top = counts.withColumn("place", place).where(F.col("place") <= most)
    entry = F.struct("place", F.concat_ws(":", F.col(value).cast("string"), F.col("n").cast("string")).alias("t"))
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), "|").alias("most_common"))


def numeric_prefix(text: Column) -> Column:
    """The number that a name begins with, for sorting; names without one come last."""
    return F.coalesce(F.regexp_extract(text, r"^(\d+)", 1).try_cast("bigint"), F.lit(2**62))


#: The order of sections in reports; others come after, as 999.
SECTION_ORDER = {"АР": 10, "КР": 20, "ПОКР": 30}


def ordered_place(section: Column, order: dict[str, int]) -> Column:
    """A section's place by a fixed map, 999 where it isn't listed."""
    table = F.create_map(*[F.lit(v) for pair in order.items() for v in pair])
    return F.coalesce(F.try_element_at(table, section), F.lit(999))


def eligible_cells(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Per cell: leads, organisations and objects, and whether it suits either design.

    h1 (leads compared) needs 2 leads and 3 objects; h2 (organisations compared) 2 organisations and 2 objects.
    """
    out = rows.groupBy(*cell).agg(F.countDistinct("lead").alias("leads"), F.countDistinct("organization").alias("organizations"), F.countDistinct("object_id").alias("objects"))
    return out.withColumns({"h1": (F.col("leads") >= 2) & (F.col("objects") >= 3), "h2": (F.col("organizations") >= 2) & (F.col("objects") >= 2)})


def upsert_labels(store: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The store with the given columns replaced where the new labels have a value; rows of the store only."""
    other = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    merged = store.join(other, key, "left")
    return merged.withColumns({c: F.coalesce(F.nullif(F.col(f"_new_{c}"), F.lit("")), F.col(c)) for c in columns}).select(*store.columns)


def reconcile(planned: Column, extracted: Column) -> Column:
    """How an extracted name compares with the planned one: the same, a letter off, part of it, missing, or another."""
    return (
        F.when(extracted.isNull() | (extracted == ""), "missing")
        .when(planned == extracted, "match")
        .when(F.levenshtein(planned, extracted) <= 1, "near_match")
        .when(F.contains(planned, extracted) | F.contains(extracted, planned), "contained")
        .otherwise("mismatch")
    )


def classify(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first rule whose pattern is found; rules are (name, pattern) in order."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in rules:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(other)


def classify_all(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The names of all rules whose patterns are found, in order; [other] if there is none."""
    found = F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in rules]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(other)))


def require(rows: DataFrame, bad: Column, message: str) -> DataFrame:
    """The rows, failing with the message when one is bad."""
    return rows.where(F.assert_true(~F.coalesce(bad, F.lit(False)), message).isNull())
