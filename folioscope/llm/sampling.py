"""Bounded training samples of labelled documents, chosen by a hash of the id, alike on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; null for a null id."""
    return F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """doc_id, text, y of at most ``most`` labelled documents outside the held-out fold: those with the least id hash.

    Only ids and labels take part in the choice (a top-k without a full sort); texts join it by broadcast, as the
    choice is bounded. Of repeated ids the largest label and the least text count; null ids, labels and texts don't.
    """
    chosen = (
        labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels[label].cast("int").alias("y"))
        .where("doc_id is not null and y is not null")
        .where(remainder(F.col("doc_id"), folds) != held_out)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    slim = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text is not null")
    return slim.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
