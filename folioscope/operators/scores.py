"""Weighted pair scores. Weights are fixed values; kinds that apply to neither side don't count where the score says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import weighted, weighted_applicable

#: Fixed values.
FAST = {"cosine": 0.55, "page": 0.20, "layout": 0.15, "content": 0.10}
SIGNATURE = {"page": 0.40, "layout": 0.35, "content": 0.25}
TEXT = {"segment": 0.35, "shingle": 0.65}
COMBINED = {"signature": 0.5, "text": 0.5}
DETAILED = {"cosine": 0.35, "page": 0.20, "layout": 0.15, "content": 0.15, "text": 0.15}
TITLE = {"ratio": 0.6, "composition": 0.3, "size": 0.1}
#: Weights of the content score's kinds.
CONTENT = {"text_segment": 0.30, "text_word_shingle": 0.25, "table_cell_text": 0.20, "table_layout_signature": 0.10, "table_content_signature": 0.15}


def fixed(weights: dict[str, float], values: dict[str, Column]) -> Column:
    """The plain weighted sum."""
    return weighted([(values[k], w) for k, w in weights.items()])


def applicable(weights: dict[str, float], values: dict[str, Column], present: dict[str, Column]) -> tuple[Column, Column]:
    """The weighted mean of the kinds that are present on either side, and their weight."""
    return weighted_applicable([(values[k], present[k], w) for k, w in weights.items()])


def title_scores(ratio: Column, composition: Column, size: Column) -> tuple[Column, Column]:
    """With and without the page size."""
    with_size = fixed(TITLE, {"ratio": ratio, "composition": composition, "size": size})
    return with_size, (ratio * TITLE["ratio"] + composition * TITLE["composition"]) / (TITLE["ratio"] + TITLE["composition"])


def multiset_jaccard(left: Column, right: Column) -> Column:
    """Of two maps from key to count: the sum of the smaller counts over that of the larger; 0 where both are empty."""
    keys = F.array_union(F.map_keys(left), F.map_keys(right))
    n = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    total = lambda pick: F.aggregate(keys, F.lit(0).cast("bigint"), lambda a, k: a + pick(n(left, k), n(right, k)))
    return F.coalesce(F.try_divide(total(F.least), total(F.greatest)), F.lit(0.0))


def composition_cosine(left: Column, right: Column) -> Column:
    """Cosine of two arrays of shares; 0 where one is empty."""
    from ..functions.similarity import cosine

    return cosine(left, right)
