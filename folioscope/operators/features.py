"""Feature vectors of documents: log and centred cosines by subvector, relative differences, style and distance scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S


def spectrum(rows: DataFrame, features: list[str]) -> DataFrame:
    """The rows with ``v`` (features as doubles) and ``z`` (centred and scaled by the population's deviation, 1 for a constant).

    Means and deviations are one aggregated row, so its join is a broadcast of fixed size.
    """
    sums = rows.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(features)])
    out = rows.crossJoin(F.broadcast(sums))
    z = [(F.col(c) - F.col(f"m{k}")) / F.when(F.col(f"s{k}") > 0, F.col(f"s{k}")).otherwise(1.0) for k, c in enumerate(features)]
    return out.select(*rows.columns, F.array(*[F.col(c).cast("double") for c in features]).alias("v"), F.array(*z).alias("z"))


def part_of(vector: Column, places: list[int]) -> Column:
    return F.array(*[vector[k] for k in places])


def sides(pairs: DataFrame, rows: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """The pairs with the given columns of their left and right documents, as left_<column> and right_<column>."""
    for x in ("left", "right"):
        pairs = pairs.join(rows.select(F.col(key).alias(f"{x}_doc"), *[F.col(c).alias(f"{x}_{c}") for c in columns]), f"{x}_doc")
    return pairs


def relative_deltas(left: Column, right: Column) -> Column:
    """Absolute differences over the larger value, which counts as 1 at least."""
    return F.zip_with(left, right, lambda a, b: F.abs(b - a) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))


def cosines(pairs: DataFrame, subvectors: dict[str, list[int]], whole: list[int] | None = None) -> DataFrame:
    """Of pairs with left_v, right_v, left_z, right_z: feature_cosine, and of each subvector the cosine of logarithms, the
    centred cosine, and the mean and largest relative difference."""
    lv, rv, lz, rz = (F.col(c) for c in ("left_v", "right_v", "left_z", "right_z"))
    at = lambda v, places: v if places is None else part_of(v, places)
    out = {"feature_cosine": F.round(S.log_cosine(at(lv, whole), at(rv, whole)) + 1e-9, 4)}
    for name, places in subvectors.items():
        delta = relative_deltas(part_of(lv, places), part_of(rv, places))
        out[f"{name}_cosine"] = F.round(S.log_cosine(part_of(lv, places), part_of(rv, places)) + 1e-9, 4)
        out[f"{name}_centered"] = F.round(S.cosine(part_of(lz, places), part_of(rz, places)) + 1e-9, 4)
        out[f"{name}_mean_delta"] = F.round(S.total(delta) / len(places) + 1e-9, 4)
        out[f"{name}_max_delta"] = F.round(F.array_max(delta) + 1e-9, 4)
    return pairs.withColumns(out)


def style_score(left: Column, right: Column, left_shares: Column, right_shares: Column) -> tuple[Column, Column, Column]:
    """0.7 ratio similarity and 0.3 composition similarity, and the two of them."""
    ratio, composition = S.ratio_similarity(left, right), S.composition_similarity(left_shares, right_shares)
    return S.weighted([(ratio, 0.7), (composition, 0.3)]), ratio, composition
