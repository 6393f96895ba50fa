"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_stored, stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, comp (the least node reachable) of the nodes of edges (a, b); nodes without an edge are not listed.

    Each round takes the least label among a node's neighbours and then its label's label (pointer jumping), so the
    number of rounds follows the logarithm of the longest path; each round's labels are written to the shared folder.
    """
    both = stored(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").selectExpr("b as a", "a as b")).distinct(), name)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), name)
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        above = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = stored(nearer.join(above, "comp").select("node", F.least("comp", "up").alias("comp"), "old"), name)
        drop_stored(labels)
        if new.where("comp <> old").isEmpty():
            drop_stored(both)
            return new.select("node", "comp")
        labels = new.select("node", "comp")
