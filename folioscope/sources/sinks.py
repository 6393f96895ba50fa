"""Sinks: projected CSV, JSON lines, a one-row summary, and the object/bundle view."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """Arrays and maps as pipe-joined text, for CSV."""
    def text(name: str, kind: str) -> Column:
        if kind.startswith("array"):
            return F.array_join(F.col(name).cast("array<string>"), "|").alias(name)
        if kind.startswith("map"):
            pairs = F.transform(F.map_entries(F.col(name)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
            return F.array_join(F.array_sort(pairs), "|").alias(name)
        return F.col(name)

    return df.select(*[text(n, k) for n, k in df.dtypes])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mark: bool = False) -> None:
    """The given columns as CSV files with headers; with ``mark`` each begins with a byte order mark, for spreadsheets."""
    rows = flat(df.select(*(columns or df.columns)))
    if mark:
        first = rows.columns[0]
        rows = rows.withColumnRenamed(first, "\ufeff" + first)
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_details(compared: DataFrame, path: str, by: list[str]) -> None:
    """One nested row of each pair, its kinds' figures as an array in order of kind, in place of a file for each pair."""
    rest = [c for c in compared.columns if c not in by]
    ordered = sorted(rest, key=lambda c: c != "entity_kind")
    nested = compared.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*ordered))).alias("axes"))
    nested.write.mode("overwrite").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_summary(df: DataFrame, path: str) -> dict:
    """The single row of an aggregate as a JSON file on the driver; returned as well."""
    row = df.first().asDict(recursive=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(row, out, ensure_ascii=False, indent=2, default=str)
    return row


def write_object_view(df: DataFrame, path: str) -> None:
    """Rows laid out by object and bundle, so that a selection of objects reads its own files only."""
    df.write.mode("overwrite").partitionBy("object_id", "bundle_id").parquet(path)
