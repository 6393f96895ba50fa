"""Title zones: profiles of a document's title, cover and body pages, their likeness, who signs them, what section they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from . import scores as W

SCOPES = ("title_anchor", "cover_zone", "body")


def scope_pages(pages: DataFrame, title: list[int], cover: list[int]) -> DataFrame:
    """The pages (page_no from 0) once for each scope they belong to: title pages, cover pages, and all but the cover."""
    inside = F.array_compact(F.array(
        F.when(F.col("page_no").isin(title), "title_anchor"), F.when(F.col("page_no").isin(cover), "cover_zone"), F.when(~F.col("page_no").isin(cover), "body")
    ))
    return pages.withColumn("scope", F.explode(inside))


def profiles(pages: DataFrame, counts: list[str], keys: list[str]) -> DataFrame:
    """Per scope and document: mean counts a page (ratios), shares of the counts, and how often each page size and signature occurs.

    pages: scope, the keys, the count columns, size, signature. Sizes and signatures are counted before they are
    gathered into maps, which grow with the distinct ones of a document.
    """
    by = ["scope", *keys]
    sums = pages.groupBy(*by).agg(F.count("*").alias("pages"), *[F.sum(c).cast("double").alias(c) for c in counts])
    total = F.col(counts[0])
    for c in counts[1:]:
        total = total + F.col(c)
    sums = sums.select(
        *by, "pages", F.array(*[F.col(c) / F.col("pages") for c in counts]).alias("ratios"), F.array(*[F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)) for c in counts]).alias("shares")
    )
    for column, name in (("size", "sizes"), ("signature", "signatures")):
        counted = pages.groupBy(*by, column).agg(F.count("*").alias("n"))
        maps = counted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(column, "n"))).alias(name))
        sums = sums.join(maps, by)
    return sums


def pair_scores(pairs: DataFrame) -> DataFrame:
    """Of pairs with left_/right_ ratios, shares, sizes and signatures: the four likenesses and the two combined scores."""
    ratio = S.ratio_similarity(F.col("left_ratios"), F.col("right_ratios"))
    composition = S.composition_similarity(F.col("left_shares"), F.col("right_shares"))
    rows = pairs.withColumns({
        "ratio": ratio, "composition": composition, "page_size": W.multiset_jaccard(F.col("left_sizes"), F.col("right_sizes")),
        "exact_page": W.multiset_jaccard(F.col("left_signatures"), F.col("right_signatures")),
    })
    whole, without = W.title_scores(F.col("ratio"), F.col("composition"), F.col("page_size"))
    rounded = {c: F.round(F.col(c) + 1e-9, 4) for c in ("ratio", "composition", "page_size", "exact_page")}
    return rows.withColumns({"with_size": F.round(whole + 1e-9, 4), "no_size": F.round(without + 1e-9, 4)}).withColumns(rounded)


def all_pairs(rows: DataFrame, directed: bool = False) -> DataFrame:
    """Pairs of profiles of a scope (doc_id, section, org, content): unordered, or, directed, all whose contents differ.

    For profiles of canonical documents, whose number follows the objects, not the documents.
    """
    side = lambda x: rows.select("scope", *[F.col(c).alias(f"{x}_{c}") for c in rows.columns if c != "scope"])
    apart = F.col("left_content") != F.col("right_content") if directed else F.col("left_doc_id") < F.col("right_doc_id")
    out = side("left").join(side("right"), "scope").where(apart)
    kind = F.when(F.col("left_org") == F.col("right_org"), "within_org").otherwise("cross_org")
    relation = F.when(F.col("left_section") == F.col("right_section"), "same_section").otherwise("different_section")
    return out.withColumns({"pair_type": kind, "section_relation": relation})


def nearest(pairs: DataFrame) -> DataFrame:
    """Of directed scored pairs: the nearest profile of each profile by either score, on a tie the lowest content, then id."""
    long = pairs.select("scope", "left_doc_id", "right_doc_id", "right_content", "pair_type", "section_relation", F.explode(F.array(
        F.struct(F.lit("with_size").alias("metric"), F.col("with_size").alias("score")), F.struct(F.lit("no_size").alias("metric"), F.col("no_size").alias("score"))
    )).alias("m")).select("*", "m.metric", "m.score")
    place = F.row_number().over(Window.partitionBy("scope", "metric", "left_doc_id").orderBy(F.desc("score"), "right_content", "right_doc_id"))
    return long.withColumn("place", place).where("place = 1").select("scope", "metric", F.col("left_doc_id").alias("doc_id"), F.col("right_doc_id").alias("nearest"), "pair_type", "section_relation", "score")


def section_status(title: Column, selected: Column) -> Column:
    """Whether the section that a title names agrees with the selected one; without one the selection stands."""
    named = F.coalesce(title, F.lit("")) != ""
    return F.when(named & (title == selected), "title_matches_selection").when(named, "title_overrides_selection").otherwise("selection_fallback")


def structure_status(groups: Column, pages: Column) -> Column:
    """What parties a title zone of so many groups and pages should show."""
    return (
        F.when((groups == 1) & (pages == 2), "single_party_expected")
        .when((groups == 2) & (pages == 4), "lead_and_subcontractor_expected")
        .otherwise("manual_review_title_structure")
    )


def party_role(index: Column, groups: Column) -> Column:
    """A party by its place (from 1): the first leads, the second of two is its subcontractor."""
    return F.when(index == 1, "lead_designer").when((index == 2) & (groups == 2), "subcontractor").otherwise("unresolved")


def effective_author(index: Column, groups: Column) -> tuple[Column, Column]:
    """Whether the party is the author, and by what rule: a subcontractor is, else a lead designer who stands alone."""
    role = party_role(index, groups)
    author = (role == "subcontractor") | ((role == "lead_designer") & (groups == 1))
    rule = F.when(role == "subcontractor", "subcontractor_actual_author").when(groups == 1, "sole_designer_author").otherwise("lead_contractual_not_effective_author")
    return author, rule
