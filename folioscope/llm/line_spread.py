"""Cross-site boilerplate: lines that stand on many distinct sites, found with HyperLogLog sketches.

Each map task folds the lines it sees into one sketch of sites per line hash; the shuffle merges sketches, so a line
that every document holds costs one row a task. Only lines whose estimate is near the threshold are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_or_shuffled, stored

#: Distinct sites from which a line counts as boilerplate.
MIN_SITES = 8
#: log2 of a sketch's registers, and the relative distance from the threshold (over 10 standard errors) counted exactly.
LG_K, NEAR = 12, 0.2


def _line(raw: Column) -> Column:
    return F.trim(raw)


def line_sites(docs: DataFrame, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """line_hash and site hash of every line that is not blank, from texts with a site."""
    lines = F.split(docs[text_col].cast("string"), "\n")
    return (
        docs.where(docs[site_col].isNotNull())
        .select(F.xxhash64(docs[site_col].cast("string")).alias("site"), F.explode(F.transform(lines, _line)).alias("line"))
        .where("line <> ''")
        .select(F.xxhash64("line").alias("line_hash"), "site")
    )


def spread(docs: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """line_hash and n_sites of the lines on at least ``min_sites`` distinct sites.

    n_sites is exact for lines near the threshold, else the sketch's estimate, rounded.
    """
    pairs = line_sites(docs, site_col, text_col)
    sketched = stored(
        pairs.groupBy("line_hash")
        .agg(F.min("site").alias("least"), F.max("site").alias("most"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
        .where("least <> most")  # on one site only: no need to estimate
        .select("line_hash", F.hll_sketch_estimate("sketch").alias("estimate")),
        "spread",
    )
    low, high = min_sites * (1 - NEAR), min_sites * (1 + NEAR)
    sure = sketched.where(F.col("estimate") > high).select("line_hash", F.col("estimate").cast("bigint").alias("n_sites"))
    near = sketched.where(F.col("estimate").between(low, high)).select("line_hash")
    exact = (
        pairs.distinct()  # a line that is everywhere is down to a row for each site and task before it is dealt out
        .join(small_or_shuffled(near), "line_hash", "left_semi")
        .groupBy("line_hash")
        .agg(F.count("*").alias("n_sites"))
        .where(F.col("n_sites") >= min_sites)
    )
    return sure.unionByName(exact)


def cleaned(
    docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES
) -> DataFrame:
    """doc (all columns of a row), text (without common lines), n_lines (before) and n_removed, one row for each row."""
    common = small_or_shuffled(stored(spread(docs, site_col, text_col, min_sites), "boilerplate"))
    lines = F.split(F.col("text"), "\n")
    keyed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
        docs[id_col].cast("string").alias("id"),
        docs[text_col].cast("string").alias("text"),
        F.xxhash64(docs[text_col].cast("string")).alias("text_hash"),
    )
    hashes = F.array_distinct(F.transform(lines, lambda x: F.xxhash64(_line(x))))
    found = (
        keyed.where(F.col("text").isNotNull())
        .select("id", "text_hash", F.explode(hashes).alias("line_hash"))
        .join(common, "line_hash", "left_semi")
        .groupBy("id", "text_hash")
        .agg(F.collect_set("line_hash").alias("gone"))
    )
    same = keyed["id"].eqNullSafe(found["id"]) & (keyed["text_hash"] == found["text_hash"])
    kept = F.filter(lines, lambda x: (_line(x) == "") | ~F.array_contains("gone", F.xxhash64(_line(x))))
    out = keyed.join(found, same, "left").select("doc", "text", "gone")
    out = out.withColumn("kept", F.when(F.col("gone").isNull(), lines).otherwise(kept))
    new_text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    return out.select(
        "doc",
        new_text.alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size("kept"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def remove_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES
) -> DataFrame:
    """The same rows and columns, with every line that stands on ``min_sites`` or more distinct sites taken out of the text.

    Lines are compared after trimming spaces; blank lines stay. Texts without a site don't add to a line's sites but
    lose its places too. Null texts and null ids stay null; repeated rows are kept and treated alike; other columns,
    whatever their names, stay as they are; an empty table gives an empty result.
    """
    out = cleaned(docs, id_col, site_col, text_col, min_sites)
    return out.select(*[(F.col("text") if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Per document row: doc_id, n_lines, n_removed, and the SHA-256 of the text that stays (null for a null text)."""
    return cleaned(docs.select("doc_id", "source", "text"), min_sites=min_sites).select(
        F.col("doc.doc_id").cast("bigint").alias("doc_id"),
        "n_lines",
        "n_removed",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
