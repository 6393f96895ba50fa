"""How hard reviewed documents are: percentiles in their section, the reviews of them, and what sessions and roles met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import ordered as O
from . import stats as A

#: What a document's difficulty is matched by, and what makes a session.
KEY = ["object_id", "organization", "work_type", "section"]
SESSION = ["expert", "organization", "work_type", "session_date"]


def _round4(value: Column) -> Column:
    return F.round(value + 1e-9, 4)


def percentiles(documents: DataFrame, axes: list[str], section: str = "section") -> DataFrame:
    """documents with a midrank percentile of each axis in its section (``<axis>_percentile``), their mean (difficulty) and its band."""
    out = stored(documents, "difficulty-axes")
    for axis in axes:
        out = O.with_places(out, [section], axis, **{f"{axis}_percentile": f"round({O.MIDRANK} + 1e-9D, 4)"})
    total = F.col(f"{axes[0]}_percentile")
    for axis in axes[1:]:
        total = total + F.col(f"{axis}_percentile")
    return out.withColumn("difficulty", _round4(total / len(axes))).withColumn("band", A.band(F.col("difficulty")))


def merge_reviews(rows: DataFrame) -> DataFrame:
    """Registry rows (expert, organization, work_type, session_date, object_id, section, role, remark, clean) that repeat are one review.

    Its roles are joined; it has a remark, or passed clean, where any of the rows did.
    """
    keys = [*SESSION, "object_id", "section"]
    roles = F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") != "", F.col("role")))), "|")
    return rows.groupBy(*keys).agg(roles.alias("role"), F.bool_or("remark").alias("remark"), F.bool_or("clean").alias("clean"), F.count("*").alias("source_rows"))


def last_of_key(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row of each key that comes last by position; of rows at one position the largest."""
    others = [c for c in rows.columns if c not in keys]
    last = F.max(F.struct(position, *[c for c in others if c != position])).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])


def join_reviews(reviews: DataFrame, documents: DataFrame, measures: list[str], position: str = "position") -> DataFrame:
    """All reviews with the measures of the document they are of, matched by KEY; of several documents of a key the last by position counts.

    Reviews without a document keep their row, with null measures, as unmatched_document.
    """
    known = last_of_key(documents.select(*KEY, position, *measures), KEY, position).drop(position)
    out = reviews.join(known.withColumn("_known", F.lit(True)), KEY, "left")
    return out.withColumn("match_status", F.when(F.col("_known"), "matched").otherwise("unmatched_document")).drop("_known")


def sessions(joined: DataFrame, totals: list[str]) -> DataFrame:
    """Sessions of the matched rows of join_reviews(): documents, mean and median difficulty, totals, and outcomes as shares of all."""
    rows = stored(joined.where("match_status = 'matched'"), "matched-reviews")
    middle = O.quantiles(rows, SESSION, "difficulty", {"difficulty_median": 0.5})
    roles = F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") != "", F.col("role")))), "|")
    out = rows.groupBy(*SESSION).agg(
        roles.alias("role"), F.count("*").alias("documents"), _round4(F.avg("difficulty")).alias("difficulty_mean"), *[F.sum(c).alias(f"{c}_total") for c in totals],
        F.count_if("clean").alias("clean"), F.count_if("remark").alias("remarks"),
    )
    out = out.join(middle.withColumn("difficulty_median", _round4(F.col("difficulty_median"))), SESSION)
    return out.withColumns({"clean_share": _round4(F.col("clean") / F.col("documents")), "remark_share": _round4(F.col("remarks") / F.col("documents"))})


def roles(sessions_: DataFrame) -> DataFrame:
    """Per labelled role: its sessions, mean and median of their difficulty, its rank correlation with clean shares, and both by band.

    Three sessions at least are correlated; null without them or without variance.
    """
    rows = stored(sessions_.where("role <> '' and role <> 'unlabeled'").select("role", "difficulty_mean", "clean_share"), "role-sessions")
    band = A.band(F.col("difficulty_mean"))
    by_band = []
    for name in ("low", "medium", "high"):
        by_band += [F.count_if(band == name).alias(f"{name}_sessions"), _round4(F.avg(F.when(band == name, F.col("clean_share")))).alias(f"{name}_clean_share")]
    out = rows.groupBy("role").agg(F.count("*").alias("sessions"), _round4(F.avg("difficulty_mean")).alias("mean"), *by_band)
    middle = O.quantiles(rows, ["role"], "difficulty_mean", {"median": 0.5})
    linked = A.spearman(rows, ["role"], "difficulty_mean", "clean_share", least=3).select("role", "spearman")
    return out.join(middle.withColumn("median", _round4(F.col("median"))), "role").join(linked, "role", "left")
