"""Pair generation and pair scores over entity multisets, driven by a table of pairs.

sum(max) = total_left + total_right - sum(min): so only hashes that two documents of a pair share take part in the
self-join, and totals come from one aggregation by document. Every pair gives a row for each kind, with its status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import weighted_applicable

#: Weights of the kinds in the IDF pair score; page signatures are shown, but don't score.
IDF_WEIGHTS = {
    "text_segment": 0.25,
    "text_word_shingle": 0.35,
    "table_cell_text": 0.15,
    "table_layout_signature": 0.15,
    "table_content_signature": 0.10,
}
DIAGNOSTIC = ("page_signature",)
KINDS = (*IDF_WEIGHTS, *DIAGNOSTIC)


def canonical_documents(docs: DataFrame) -> DataFrame:
    """section, object_id, doc_id (and org, where there is one): of each object and section the document with the lowest id."""
    more = [F.min_by("org", "doc_id").alias("org")] if "org" in docs.columns else []
    return docs.groupBy("section", "object_id").agg(F.min("doc_id").alias("doc_id"), *more)


def comparison_pairs(canonical: DataFrame) -> DataFrame:
    """pair_id, section, left and right object, document (and org) of all canonical documents of a section, lower object on the left.

    Their number follows the objects of a section, not the documents.
    """
    names = {"object_id": "object", "doc_id": "doc", "org": "org"}
    side = lambda x: canonical.select("section", *[F.col(c).alias(f"{x}_{n}") for c, n in names.items() if c in canonical.columns])
    pairs = side("left").join(side("right"), "section").where("left_object < right_object")
    pair_id = F.concat_ws("__", "section", F.col("left_doc").cast("string"), F.col("right_doc").cast("string"))
    return pairs.withColumn("pair_id", pair_id)


def compare(pairs: DataFrame, entities: DataFrame, frequency: DataFrame | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The pairs, a row for each kind, with raw and IDF-weighted Jaccard values, status, and what they share.

    status is not_present where neither document has the kind, measured_no_overlap where they share nothing of it.
    The join key is (section, kind, hash), so a hash of one document makes no row; the adaptive planner splits what is
    skewed. Without ``frequency`` every hash weighs 1, as does one that the frequency table lacks.
    """
    named = pairs.select(F.explode(F.array("left_doc", "right_doc")).alias("doc_id")).distinct()
    rows = entities.join(named, "doc_id", "left_semi").select("doc_id", "section", "object_id", "entity_kind", "entity_hash", "n")
    if frequency is None:
        rows = rows.withColumn("idf", F.lit(1.0))
    else:
        weights = frequency.select("section", "entity_kind", "entity_hash", F.col("section_idf").alias("idf"))
        rows = rows.join(weights, ["section", "entity_kind", "entity_hash"], "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    totals = rows.groupBy("doc_id", "entity_kind").agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.col("idf")).alias("total_idf"), F.count("*").alias("unique"), F.sum("idf").alias("unique_idf")
    )
    side = lambda x, *more: rows.select("section", "entity_kind", "entity_hash", *more, F.col("doc_id").alias(f"{x}_doc"), F.col("object_id").alias(f"{x}_object"), F.col("n").alias(f"{x}_n"))
    least = F.least("left_n", "right_n")
    shared = side("left", "idf").join(side("right"), ["section", "entity_kind", "entity_hash"]).where("left_object < right_object")
    shared = shared.groupBy("left_doc", "right_doc", "entity_kind").agg(
        F.sum(least).alias("shared"), F.sum(least * F.col("idf")).alias("shared_weight"), F.count("*").alias("shared_unique"), F.sum("idf").alias("shared_idf")
    )
    out = pairs.withColumn("entity_kind", F.explode(F.array(*map(F.lit, kinds)))).join(shared, ["left_doc", "right_doc", "entity_kind"], "left")
    for x in ("left", "right"):
        own = totals.select(F.col("doc_id").alias(f"{x}_doc"), "entity_kind", *[F.col(c).alias(f"{x}_{c}") for c in ("total", "total_idf", "unique", "unique_idf")])
        out = out.join(own, [f"{x}_doc", "entity_kind"], "left")
    numbers = ["shared", "shared_unique", "left_total", "right_total", "left_unique", "right_unique"]
    floats = ["shared_weight", "shared_idf", "left_total_idf", "right_total_idf", "left_unique_idf", "right_unique_idf"]
    out = out.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in numbers}, **{c: F.coalesce(c, F.lit(0.0)) for c in floats}})
    over = lambda a, l, r: F.coalesce(F.try_divide(F.col(a), F.col(l) + F.col(r) - F.col(a)), F.lit(0.0))
    status = F.when((F.col("left_total") + F.col("right_total")) == 0, "not_present").when(F.col("shared") == 0, "measured_no_overlap").otherwise("measured")
    return out.withColumns(
        {
            "raw_value": over("shared", "left_total", "right_total"),
            "idf_value": over("shared_weight", "left_total_idf", "right_total_idf"),
            "union_idf": F.col("left_unique_idf") + F.col("right_unique_idf") - F.col("shared_idf"),
            "status": status,
        }
    )


def wide(compared: DataFrame, by: list[str], kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """One row of each pair: raw_<kind>, idf_<kind>, has_<kind> (on either side) and the number of shared entities."""
    of = lambda k, c: F.max(F.when(F.col("entity_kind") == k, F.col(c)))
    return compared.groupBy(*by).agg(
        *[of(k, c).alias(f"{p}_{k}") for k in kinds for p, c in (("raw", "raw_value"), ("idf", "idf_value"))],
        *[F.max(F.when(F.col("entity_kind") == k, F.col("status") != "not_present")).alias(f"has_{k}") for k in kinds],
        F.sum("shared_unique").alias("shared_unique"),
    )


def scored(weights: dict[str, float], prefix: str = "raw") -> tuple[Column, Column]:
    """The weighted mean of the kinds that a pair has on either side, and their weight, over the columns of wide()."""
    return weighted_applicable([(F.col(f"{prefix}_{k}"), F.col(f"has_{k}"), w) for k, w in weights.items()])


def status_of(score: Column, weight: Column, without: str = "not_present") -> Column:
    return F.when(weight == 0, without).when(score == 0, "measured_no_overlap").otherwise("measured")


def idf_pair_similarity(pairs: DataFrame, entities: DataFrame, frequency: DataFrame) -> DataFrame:
    """Per pair: the weighted mean of its kinds' IDF values over the kinds that either document has, and all axes."""
    by = [c for c in pairs.columns]
    rows = wide(compare(pairs, entities, frequency), by)
    score, weight = scored(IDF_WEIGHTS, "idf")
    return rows.select(
        *by,
        F.round(score + 1e-9, 4).alias("idf_similarity"),
        status_of(score, weight).alias("idf_status"),
        F.round(weight, 4).alias("applicable_weight"),
        *[F.round(F.col(f"{p}_{k}") + 1e-9, 4).alias(f"{k}_{p}") for k in KINDS for p in ("idf", "raw")],
        "shared_unique",
    )


def top_shared(pairs: DataFrame, entities: DataFrame, frequency: DataFrame, most: int = 10) -> DataFrame:
    """The ``most`` shared entities of each pair and kind, by the IDF weight of what is shared (largest first), then by hash."""
    rows = entities.select("doc_id", "section", "entity_kind", "entity_hash", "n")
    side = lambda x: rows.select("section", "entity_kind", "entity_hash", F.col("doc_id").alias(f"{x}_doc"), F.col("n").alias(f"{x}_n"))
    shared = pairs.select("left_doc", "right_doc").join(side("left"), "left_doc").join(side("right"), ["right_doc", "section", "entity_kind", "entity_hash"])
    idf = frequency.select("section", "entity_kind", "entity_hash", "section_idf")
    shared = shared.join(idf, ["section", "entity_kind", "entity_hash"], "left").withColumn("section_idf", F.coalesce("section_idf", F.lit(1.0)))
    shared = shared.withColumn("shared_weight", F.round(F.least("left_n", "right_n") * F.col("section_idf") + 1e-9, 4))
    place = F.row_number().over(Window.partitionBy("left_doc", "right_doc", "entity_kind").orderBy(F.desc("shared_weight"), "entity_hash"))
    return shared.withColumn("place", place.cast("bigint")).where(F.col("place") <= most).select(
        "left_doc", "right_doc", "entity_kind", "place", "entity_hash", "left_n", "right_n", "section_idf", "shared_weight"
    )
