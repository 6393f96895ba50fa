"""Document frequency, inverse document frequency, frequency buckets, typicality of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import by_key

#: Share of a section's documents from which an entity is typical.
TYPICAL = 0.5
BUCKETS = ("typical", "shared_rare", "original", "low_population")


def idf(df: Column, n: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def bucket(df: Column, n: Column, typical: float = TYPICAL) -> Column:
    return F.when(n < 2, "low_population").when(df <= 1, "original").when(df / n >= typical, "typical").otherwise("shared_rare")


def document_frequency(entities: DataFrame, documents: DataFrame | None = None, fold: bool = False) -> DataFrame:
    """Per section, kind and hash: section and global document frequency, their ratios and IDFs, occurrences, bucket.

    Entities are a row per document and hash already, so frequencies are plain counts; the global ones add up the
    section ones, and document totals (a row a section) join by broadcast. Entities are shuffled once, by kind and hash.
    documents: section, doc_id of those that have entities, where that is known without them. fold: the hashes are few, so
    each task counts its own before anything is shuffled.
    """
    docs = (entities if documents is None else documents).select("section", "doc_id").distinct().groupBy("section").agg(F.count("*").alias("section_document_count"))
    docs = docs.select("*", F.sum("section_document_count").over(_all()).alias("global_document_count"))
    slim = entities.select("section", "entity_kind", "entity_hash", "n")
    dealt = slim if fold else by_key(slim, "entity_kind", "entity_hash", times=4)
    local = dealt.groupBy("section", "entity_kind", "entity_hash").agg(F.count("*").alias("section_df"), F.sum("n").alias("occurrence_count"))
    rows = local.withColumn("global_df", F.sum("section_df").over(Window.partitionBy("entity_kind", "entity_hash"))).join(F.broadcast(docs), "section")
    return rows.select(
        "section",
        "entity_kind",
        "entity_hash",
        "section_df",
        "section_document_count",
        F.round(F.col("section_df") / F.col("section_document_count"), 4).alias("section_df_ratio"),
        F.round(idf(F.col("section_df"), F.col("section_document_count")), 4).alias("section_idf"),
        "global_df",
        F.round(F.col("global_df") / F.col("global_document_count"), 4).alias("global_df_ratio"),
        F.round(idf(F.col("global_df"), F.col("global_document_count")), 4).alias("global_idf"),
        "occurrence_count",
        bucket(F.col("section_df"), F.col("section_document_count")).alias("frequency_bucket"),
    )


def _all():
    return Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def typicality(entities: DataFrame, frequency: DataFrame) -> DataFrame:
    """Per document and kind: occurrences by bucket, their shares, and the mean section IDF (weighted by occurrence)."""
    rows = entities.join(frequency.select("section", "entity_kind", "entity_hash", "frequency_bucket", "section_idf"), ["section", "entity_kind", "entity_hash"])
    counts = [F.sum(F.when(F.col("frequency_bucket") == b, F.col("n")).otherwise(0)).alias(f"{b}_count") for b in BUCKETS]
    out = rows.groupBy("doc_id", "section", "entity_kind").agg(
        F.sum("n").alias("occurrence_count"),
        F.count("*").alias("unique_entity_count"),
        *counts,
        F.round(F.sum(F.col("n") * F.col("section_idf")) / F.sum("n") + 1e-9, 4).alias("mean_section_idf"),
    )
    return out.withColumns({f"{b}_share": F.round(F.col(f"{b}_count") / F.col("occurrence_count"), 4) for b in BUCKETS})
