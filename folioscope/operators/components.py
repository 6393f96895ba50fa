"""Connected components by least-label propagation with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, stored


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """member, component_id (the least member reachable) of edges (a, b); of ``nodes`` (member) those without an edge stand alone."""
    both = edges.select("a", "b").unionByName(edges.selectExpr("b as a", "a as b")).where("a <> b").distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy(F.col("a").alias("member")).agg(F.least(F.col("member"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("member").alias("b"), "comp"), "b").groupBy(F.col("a").alias("member")).agg(F.min("comp").alias("near"))
        new = labels.join(near, "member").select("member", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        up = labels.select(F.col("member").alias("comp"), F.col("comp").alias("up"))
        new = stored(new.join(up, "comp").select("member", F.least("comp", "up").alias("comp"), "old"), "labels")
        drop(labels)
        if new.where("comp <> old").isEmpty():
            drop(both)
            break
        labels = new.select("member", "comp")
    out = new.select("member", F.col("comp").alias("component_id"))
    if nodes is not None:
        out = nodes.select("member").distinct().join(out, "member", "left").select("member", F.coalesce("component_id", "member").alias("component_id"))
    return out
