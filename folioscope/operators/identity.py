"""Organisations that may be one: matrix of organisation pairs, activity over time, typed edges, components and attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components

#: Handoff score from which a shared lead speaks for a rename; retention that links by style and by content.
RENAME, STYLE, CONTENT = 0.40, 0.75, 0.40
CORE = ("rename_candidate", "disclosed_subcontract_network")
EDGE_TYPES = ("rename_candidate", "disclosed_subcontract_network", "shared_gip_handwriting", "owner_or_template_candidate")


def self_baselines(rows: DataFrame, channels: list[str]) -> DataFrame:
    """Rows of (cell, left_org, right_org) with a median of each channel: how many of the two organisations have a row of
    their own in the cell, the mean of these rows' medians, and the row's median over it (null over 0 or none)."""
    own = rows.where("left_org = right_org").select("cell", F.col("left_org").alias("org"), *channels)
    out = rows
    for x in ("left", "right"):
        out = out.join(own.select("cell", F.col("org").alias(f"{x}_org"), F.lit(1).alias(f"_{x}"), *[F.col(c).alias(f"_{x}_{c}") for c in channels]), ["cell", f"{x}_org"], "left")
    found = F.coalesce("_left", F.lit(0)) + F.coalesce("_right", F.lit(0))
    more = {"baselines": found}
    for c in channels:
        known = F.array_compact(F.array(f"_left_{c}", f"_right_{c}"))
        mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
        more[f"{c}_reference"] = F.round(mean + 1e-9, 4)
        more[f"{c}_retention"] = F.round(F.when(mean != 0, F.col(c) / mean) + 1e-9, 4)
    return out.withColumns(more).select(*rows.columns, *more)


def link_class(style: Column, content: Column) -> Column:
    """Which of the two channels a pair of organisations keeps; a missing one isn't kept."""
    s, c = F.coalesce(style >= STYLE, F.lit(False)), F.coalesce(content >= CONTENT, F.lit(False))
    return F.when(s & c, "handwriting_transfer_both").when(s, "handwriting_structure_led").when(c, "handwriting_content_led").otherwise("no_transfer_at_v0_thresholds")


def activity(counts: DataFrame) -> DataFrame:
    """Per pair (a, b): quarters with any activity, correlation of the two, and the handoff from one to the other.

    ``counts`` has a, b, quarter, na, nb. At a boundary before a quarter, the earlier share of one times the later share
    of the other is the strength of a handoff, taken in the stronger direction (a to b on a tie); the earliest boundary
    of the largest strength counts, by its first quarter after. Without any, score 0 and no direction or boundary.
    """
    rows = counts.where(F.col("na") + F.col("nb") > 0)
    by = Window.partitionBy("a", "b")
    earlier = by.orderBy("quarter").rowsBetween(Window.unboundedPreceding, -1)
    part = {}
    for x in ("a", "b"):
        before = F.coalesce(F.try_divide(F.sum(f"n{x}").over(earlier), F.sum(f"n{x}").over(by)), F.lit(0.0))
        part[f"before_{x}"] = before
        part[f"after_{x}"] = F.when(F.sum(f"n{x}").over(by) > 0, 1 - before).otherwise(0.0)
    rows = rows.withColumns({**part, "place": F.row_number().over(by.orderBy("quarter"))})
    rows = rows.withColumns({"forward": F.col("before_a") * F.col("after_b"), "backward": F.col("before_b") * F.col("after_a")})
    strength = F.when(F.col("place") > 1, F.round(F.greatest("forward", "backward"), 12)).otherwise(0.0)
    best = F.max(F.struct(strength.alias("score"), (-F.col("place")).alias("earliest"), (F.col("forward") >= F.col("backward")).alias("ahead"), F.col("quarter").alias("quarter")))
    spread = F.stddev_pop("na") * F.stddev_pop("nb")
    out = rows.groupBy("a", "b").agg(F.count("*").alias("quarters"), F.try_divide(F.covar_pop("na", "nb"), spread).alias("r"), best.alias("best"))
    any_ = F.col("best.score") > 0
    arrow = F.when(F.col("best.ahead"), F.concat_ws(" -> ", "a", "b")).otherwise(F.concat_ws(" -> ", "b", "a"))
    return out.select(
        "a", "b", "quarters", F.round("r", 4).alias("correlation"), F.round("best.score", 4).alias("handoff_score"),
        F.when(any_, arrow).otherwise("").alias("direction"), F.when(any_, F.col("best.quarter")).otherwise("").alias("boundary"),
    )


def edge_type(handwriting: Column, shared: Column, disclosed: Column, handoff: Column) -> Column:
    """What an edge between two organisations is: disclosed evidence first, then a likely rename, a shared lead, a likeness alone."""
    return (
        F.when(disclosed > 0, "disclosed_subcontract_network")
        .when(handwriting & (shared > 0) & (handoff >= RENAME), "rename_candidate")
        .when(handwriting & (shared > 0), "shared_gip_handwriting")
        .when(handwriting, "owner_or_template_candidate")
        .otherwise("not_in_identity_graph")
    )


#: What each type of edge rests on.
BASIS = {
    "disclosed_subcontract_network": "explicit_four_title_evidence",
    "rename_candidate": "handwriting_shared_gip_temporal_handoff",
    "shared_gip_handwriting": "handwriting_shared_gip_without_rename_handoff",
    "owner_or_template_candidate": "rare_handwriting_without_independent_identity_evidence",
}


def typed_edges(matrix: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges (a, b) of the matrix that are of a type, with its basis, both sizes, and whether a large organisation's template may be behind it.

    matrix: a, b, handwriting, shared_gips, disclosed, handoff_score. objects: org, n. Large are organisations from the
    90th percentile of n on.
    """
    limit = objects.agg(F.percentile("n", 0.9).alias("limit"))
    rows = matrix.withColumn("edge_type", edge_type(F.col("handwriting"), F.col("shared_gips"), F.col("disclosed"), F.col("handoff_score"))).where("edge_type <> 'not_in_identity_graph'")
    for x in ("a", "b"):
        rows = rows.join(objects.select(F.col("org").alias(x), F.col("n").alias(f"{x}_objects")), x, "left").withColumn(f"{x}_objects", F.coalesce(f"{x}_objects", F.lit(0)))
    rows = rows.crossJoin(F.broadcast(limit))  # one row
    large = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"{x}_objects") >= F.col("limit"), F.col(x)) for x in ("a", "b")])), "|")
    basis = F.create_map(*[F.lit(v) for pair in BASIS.items() for v in pair])
    policy = F.when(F.col("edge_type").isin(*CORE), "core_identity_component").otherwise("separate_research_component")
    return rows.withColumns(
        {"basis": F.try_element_at(basis, F.col("edge_type")), "large_orgs": large, "template_risk": (F.col("edge_type") == "owner_or_template_candidate") & (large != ""), "policy": policy}
    ).drop("limit")


def typed_components(edges: DataFrame, types: tuple[str, ...] = EDGE_TYPES) -> DataFrame:
    """edge_type, member, component_id: the components that the edges of each type form by themselves."""
    out = None
    for kind in types:
        part = components(edges.where(F.col("edge_type") == kind).select("a", "b")).select(F.lit(kind).alias("edge_type"), "member", "component_id")
        out = part if out is None else out.unionByName(part)
    return out


def attachments(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges of the other types that touch a core component: both ends' core components, and whether they only support one core."""
    name = F.concat_ws(":", "edge_type", F.col("component_id").cast("string"))
    core = parts.where(F.col("edge_type").isin(*CORE)).groupBy("member").agg(F.array_sort(F.collect_set(name)).alias("core"))
    rows = edges.where(~F.col("edge_type").isin(*CORE))
    for x in ("a", "b"):
        rows = rows.join(core.select(F.col("member").alias(x), F.array_join("core", "|").alias(f"{x}_core")), x, "left").withColumn(f"{x}_core", F.coalesce(f"{x}_core", F.lit("")))
    inside = (F.col("a_core") != "") & (F.col("a_core") == F.col("b_core"))
    rows = rows.where("a_core <> '' or b_core <> ''")
    return rows.withColumn("attachment_status", F.when(inside, "secondary_support_inside_core").otherwise("unvalidated_attachment_to_core"))
