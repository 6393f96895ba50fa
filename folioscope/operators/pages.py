"""Page profiles, near-match scores and their classes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..storage import by_key

#: Weights of the near-match score's parts, and the least scores of its classes.
NEAR_WEIGHTS = {"count_ratio": 0.30, "count_composition": 0.20, "area_ratio": 0.25, "area_composition": 0.15, "element_ratio": 0.10}
NEAR_CLASSES = {"near_exact": 0.95, "strong_near_match": 0.85, "moderate_near_match": 0.70}
STRONG = 0.85


def group_counts(html: Column, groups: list[str]) -> Column:
    """How often each tag opens in a page, and how many others do, as doubles in the order given."""
    names = F.regexp_extract_all(html, F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    known = [F.size(names) - F.size(F.array_remove(names, g)) for g in groups]
    return F.transform(F.array(*known, F.size(names) - sum(known[1:], known[0])), lambda x: x.cast("double"))


def group_areas(html: Column, groups: list[str]) -> Column:
    """The characters of text that directly follow each tag, and 0 for the others, as doubles in the order given."""
    inner = lambda g: F.regexp_extract_all(html, F.lit(rf"<{g}(?:\s[^>]*)?>([^<]*)"), F.lit(1))
    chars = [F.aggregate(inner(g), F.lit(0), lambda a, x: a + F.length(x)).cast("double") for g in groups]
    return F.array(*chars, F.lit(0.0))


def shortlist_vector(pages: DataFrame) -> DataFrame:
    """The pages (columns counts, areas, elements) with ``vector``: logarithms and shares of counts and areas and the
    logarithm of the elements, each over the largest of all pages, of length one.

    The largest values are one aggregated row, so its join is a broadcast of fixed size.
    """
    logs = lambda c: F.transform(c, F.log1p)
    parts = F.concat(logs("counts"), S.shares(F.col("counts")), logs("areas"), S.shares(F.col("areas")), F.array(F.log1p("elements")))
    rows = pages.withColumn("_raw", parts)
    width = len(rows.select("_raw").limit(1).collect()[0][0]) if not rows.isEmpty() else 1
    largest = rows.agg(F.array(*[F.greatest(F.max(F.col("_raw")[k]), F.lit(1e-6)) for k in range(width)]).alias("_most"))
    rows = rows.crossJoin(F.broadcast(largest)).withColumn("_raw", F.zip_with("_raw", "_most", lambda a, m: a / m))
    length = F.greatest(F.sqrt(S.total(F.transform("_raw", lambda x: x * x))), F.lit(1e-8))
    return rows.withColumn("_length", length).withColumn("vector", F.transform("_raw", lambda x: x / F.col("_length"))).drop("_raw", "_most", "_length")


def near_match(pairs: DataFrame) -> DataFrame:
    """Scores of pairs with lc, rc (counts), la, ra (areas), le, re (element counts)."""
    l, r = [F.col(c) for c in ("lc", "la")], [F.col(c) for c in ("rc", "ra")]
    parts = {
        "count_ratio": S.ratio_similarity(l[0], r[0]),
        "count_composition": S.composition_similarity(S.shares(l[0]), S.shares(r[0])),
        "area_ratio": S.ratio_similarity(l[1], r[1]),
        "area_composition": S.composition_similarity(S.shares(l[1]), S.shares(r[1])),
        "element_ratio": S.number_ratio(F.col("le"), F.col("re")),
    }
    out = pairs.withColumns(parts)
    return out.withColumn("near_match_similarity", S.weighted([(F.col(k), w) for k, w in NEAR_WEIGHTS.items()]))


def _side(pages: DataFrame, name: str, x: str) -> DataFrame:
    """A page's columns as one side of a pair."""
    short = {"counts": "c", "areas": "a", "elements": "e", "signature": "s"}
    return pages.select(F.col("page_id").alias(name), F.col("document").alias(f"{name}_document"), F.col("cohort").alias(f"{name}_cohort"), *[F.col(c).alias(x + k) for c, k in short.items()])


def neighbors(pages: DataFrame, mode: str, shortlist: int = 40, top: int = 5) -> DataFrame:
    """query, neighbor, rank and scores of the ``top`` pages most like each page, of other documents (mode any) or cohorts (cross_org).

    Candidates are the ``shortlist`` pages of the largest vector product and all pages of the same signature; they are
    ranked by the near-match score, exact matches first, then by id. pages: page_id, document, cohort, counts, areas,
    elements, signature.
    """
    from .neighbors import nearest

    vectors = shortlist_vector(pages)
    cross = mode == "cross_org"
    listed = nearest(vectors, shortlist, "page_id", "vector", "cohort", cross, "document").select("query", "neighbor")
    own = pages.select("signature", F.col("page_id").alias("query"), F.col("document").alias("d"), F.col("cohort").alias("c"))
    other = pages.select("signature", F.col("page_id").alias("neighbor"), F.col("document").alias("od"), F.col("cohort").alias("oc"))
    same = own.join(other, "signature").where("query <> neighbor and d <> od" + (" and c <> oc" if cross else "")).select("query", "neighbor")
    pairs = listed.unionByName(same).distinct().join(_side(pages, "query", "l"), "query").join(_side(pages, "neighbor", "r"), "neighbor")
    rows = near_match(pairs).withColumn("exact", F.col("ls") == F.col("rs")).withColumn("score", F.round("near_match_similarity", 9))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("exact"), "neighbor"))
    return rows.withColumns({"rank": place.cast("bigint"), "mode": F.lit(mode)}).where(F.col("rank") <= top)


def set_evidence(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The page pairs (query, neighbor) with shared, rare and Jaccard of their text segments (sets: page_id, hash, rare)."""
    sizes = sets.groupBy("page_id").agg(F.count("*").alias("n"))
    q, r = sets.select(F.col("page_id").alias("query"), "hash", "rare"), sets.select(F.col("page_id").alias("neighbor"), "hash")
    keys = pairs.select("query", "neighbor").distinct()
    shared = keys.join(q, "query").join(r, ["neighbor", "hash"]).groupBy("query", "neighbor").agg(F.count("*").alias("shared"), F.count_if("rare").alias("rare"))
    out = pairs.join(shared, ["query", "neighbor"], "left")
    for side in ("query", "neighbor"):
        out = out.join(sizes.select(F.col("page_id").alias(side), F.col("n").alias(f"_{side}")), side, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    jaccard = F.coalesce(F.try_divide(zero("shared"), zero("_query") + zero("_neighbor") - zero("shared")), F.lit(0.0))
    return out.withColumns({"jaccard": jaccard, "shared": zero("shared"), "rare": zero("rare")}).drop("_query", "_neighbor")


#: Pages of a block of a document; scores so near the largest may round to it.
BLOCK, NEARLY = 1024, 2e-9


#: Pairs of pages whose numbers are compared at a time: what fits into a core's cache.
STRIP = 1 << 14


def _likeness(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """near_match_similarity of all pages of the left against all of the right, added up in the order of near_match()."""
    numbers = [[np.array(x[c].tolist(), np.float64).reshape(len(x), -1) for c in ("counts", "areas", "elements")] for x in (left, right)]
    if not all((n >= 0).all() for side in numbers for n in side):
        return _likeness_of_any(left, right)
    wholes = [[np.cumsum(n, axis=1)[:, -1:] for n in side[:2]] for side in numbers]
    shares = [[np.divide(n, w, out=np.zeros_like(n), where=w != 0) for n, w in zip(side, whole, strict=False)] for side, whole in zip(numbers, wholes, strict=True)]
    out = np.empty((len(left), len(right)))
    step = max(1, STRIP // len(right))
    for begin in range(0, len(left), step):
        part = slice(begin, begin + step)
        shape = out[part].shape
        most, less = np.empty(shape), np.empty(shape)
        parts = {}
        for k, name in enumerate(("count", "area")):
            a, b = numbers[0][k][part], numbers[1][k]
            ratio, composition = np.zeros(shape), np.zeros(shape)
            for j in range(a.shape[1]):
                np.maximum(a[:, j, None], b[None, :, j], out=most)
                np.minimum(a[:, j, None], b[None, :, j], out=less)
                np.add(most, most == 0, out=most)  # nothing over nothing adds nothing
                ratio += np.divide(less, most, out=less)
                composition += np.minimum(shares[0][k][part][:, j, None], shares[1][k][None, :, j], out=less)
            known = a.shape[1] - (a == 0).astype(np.float64) @ (b == 0).astype(np.float64).T
            parts[f"{name}_ratio"] = np.divide(ratio, known, out=np.ones(shape), where=known > 0)
            parts[f"{name}_composition"] = composition
        a, b = numbers[0][2][part], numbers[1][2].T
        np.maximum(a, b, out=most)
        parts["element_ratio"] = np.divide(np.minimum(a, b), most, out=np.ones(shape), where=most > 0)
        total = None
        for name, weight in NEAR_WEIGHTS.items():
            total = parts[name] * weight if total is None else total + parts[name] * weight
        out[part] = total
    return out


def _likeness_of_any(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """_likeness() of pages with numbers that are unknown or below 0."""
    def ratio(column: str) -> np.ndarray:
        l, r = (np.array(x[column].tolist(), np.float64) for x in (left, right))
        sums, known = np.zeros((len(l), len(r))), np.zeros((len(l), len(r)))
        for k in range(l.shape[1]):
            a, b = l[:, k, None], r[None, :, k]
            most = np.fmax(a, b)
            used = np.nan_to_num(most) != 0
            sums += np.divide(np.fmin(a, b), most, out=np.zeros_like(most), where=used)
            known += used
        return np.divide(sums, known, out=np.ones_like(sums), where=known > 0)

    def composition(column: str) -> np.ndarray:
        shares = []
        for x in (left, right):
            values = np.nan_to_num(np.array(x[column].tolist(), np.float64))
            whole = np.cumsum(values, axis=1)[:, -1:]
            shares.append(np.divide(values, whole, out=np.zeros_like(values), where=whole != 0))
        sums = np.zeros((len(left), len(right)))
        for k in range(shares[0].shape[1]):
            sums += np.minimum(shares[0][:, k, None], shares[1][None, :, k])
        return sums

    a, b = left["elements"].to_numpy(np.float64)[:, None], right["elements"].to_numpy(np.float64)[None, :]
    most = np.fmax(a, b)
    used = np.nan_to_num(most) > 0
    parts = {
        "count_ratio": ratio("counts"), "count_composition": composition("counts"), "area_ratio": ratio("areas"), "area_composition": composition("areas"),
        "element_ratio": np.divide(np.fmin(a, b), most, out=np.ones_like(most), where=used),
    }
    out = None
    for name, weight in NEAR_WEIGHTS.items():
        out = parts[name] * weight if out is None else out + parts[name] * weight
    return out


def _likest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Of two blocks of a pair of documents, in both directions: the pages of the other block that may be the likest of each page."""
    columns = ["pair_id", "direction", "query", "neighbor", "near_match_similarity", "exact"]
    if not len(left) or not len(right):
        return pd.DataFrame({c: [] for c in columns})
    scores = _likeness(left, right)
    ids, signs = [x["page_id"].to_numpy() for x in (left, right)], [x["signature"].to_numpy() for x in (left, right)]
    found = []
    for direction, axis in (("left_to_right", 1), ("right_to_left", 0)):
        i, j = np.nonzero(scores >= scores.max(axis=axis, keepdims=True) - NEARLY)
        q, n = (ids[0][i], ids[1][j]) if axis else (ids[1][j], ids[0][i])
        found.append(pd.DataFrame({"pair_id": left["pair_id"].iloc[0], "direction": direction, "query": q, "neighbor": n, "near_match_similarity": scores[i, j], "exact": signs[0][i] == signs[1][j]}))
    return pd.concat(found)[columns]


def best_in_pairs(document_pairs: DataFrame, pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Of each pair of documents (pair_id, left_document, right_document): the best page of the other one for each page of either.

    The best has the largest structural score, then shingle and segment Jaccard, then an equal signature, then the
    lowest id. Only pages that tie in structure are compared by text. texts: page_id, segments, shingles (hash arrays).
    Documents are cut into blocks of about BLOCK pages; two blocks meet at a time, in one pass for both directions. They are dealt out
    by a fixed number: the planner would join tasks by the size of the pages, not of their pairs.
    """
    slim = pages.select("page_id", "document", "counts", "areas", "elements", "signature")
    cuts = slim.groupBy("document").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts"))
    cut = slim.join(cuts, "document").withColumn("own", F.pmod(F.xxhash64("page_id"), "cuts").cast("int")).drop("cuts")
    many = lambda x: cuts.select(F.col("document").alias(f"{x}_document"), F.col("cuts").alias(f"{x}_cuts"))
    named = document_pairs.select("pair_id", "left_document", "right_document").join(many("left"), "left_document").join(many("right"), "right_document")
    by = ["pair_id", "left_block", "right_block"]

    def dealt(x: str, other: str) -> DataFrame:
        rows = named.select("pair_id", F.col(f"{x}_document").alias("document"), F.col(f"{other}_cuts").alias("cuts")).join(cut, "document")
        rows = rows.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumnRenamed("own", f"{x}_block")
        return by_key(rows.select(*[F.col(c).alias(c) for c in by], "page_id", "counts", "areas", "elements", "signature"), *by)  # columns of its own

    kinds = f"pair_id string, direction string, query {dict(pages.dtypes)['page_id']}, neighbor {dict(pages.dtypes)['page_id']}, near_match_similarity double, exact boolean"
    rows = dealt("left", "right").groupBy(*by).cogroup(dealt("right", "left").groupBy(*by)).applyInPandas(_likest, kinds)
    rows = rows.withColumn("structural", F.round("near_match_similarity", 9)).drop("near_match_similarity")
    keys = ["pair_id", "direction", "query"]
    rows = rows.withColumn("_most", F.max("structural").over(Window.partitionBy(*keys))).where("structural = _most").drop("_most")
    for side in ("query", "neighbor"):
        rows = rows.join(texts.select(F.col("page_id").alias(side), F.col("segments").alias(f"{side}_segments"), F.col("shingles").alias(f"{side}_shingles")), side, "left")
    none = F.array().cast("array<bigint>")
    for kind in ("shingles", "segments"):
        rows = rows.withColumn(kind, F.round(S.set_jaccard(F.coalesce(f"query_{kind}", none), F.coalesce(f"neighbor_{kind}", none)), 9))
    return best_match(rows.drop(*[f"{s}_{k}" for s in ("query", "neighbor") for k in ("segments", "shingles")]), keys, [F.desc("shingles"), F.desc("segments"), F.desc("exact"), F.col("neighbor")])


def match_summary(matches: DataFrame) -> DataFrame:
    """Per pair of documents, over both directions: means, medians and shares of the best matches."""
    share = lambda c: F.round(F.avg(c.cast("double")) + 1e-9, 4)
    return matches.groupBy("pair_id").agg(
        F.count("*").alias("matches"), F.round(F.avg("structural") + 1e-9, 4).alias("structural_mean"), F.round(F.median("structural") + 1e-9, 4).alias("structural_median"),
        F.round(F.avg("shingles") + 1e-9, 4).alias("shingle_mean"), F.round(F.avg("segments") + 1e-9, 4).alias("segment_mean"),
        share(F.col("exact")).alias("exact_share"), share(F.col("structural") >= 0.85).alias("strong_share"), share(F.col("structural") >= 0.70).alias("moderate_share"),
    )


def near_match_class(score: Column, exact: Column) -> Column:
    out = F.when(exact, "exact_match")
    for name, least in NEAR_CLASSES.items():
        out = out.when(score >= least, name)
    return out.otherwise("weak_match")


def evidence_class(structural: Column, tables: Column, segments: Column, rare: Column, jaccard: Column, layouts: Column) -> Column:
    """What beside structure supports a match: shared table contents, segments, rare segments, layouts; first that holds."""
    return (
        F.when(structural < STRONG, "below_strong_structural")
        .when((tables > 0) & (segments > 0), "structure_text_table_content")
        .when(tables > 0, "structure_table_content")
        .when((rare > 0) & (jaccard >= 0.2), "structure_rare_text_review")
        .when(jaccard >= 0.5, "structure_strong_text")
        .when(segments > 0, "structure_text_bridge")
        .when(layouts > 0, "structure_table_layout")
        .otherwise("structural_only")
    )


def review_strength(score: Column, tables: Column, rare: Column, jaccard: Column) -> Column:
    """Why a match is worth a look; null if it isn't."""
    return (
        F.when(score < STRONG, None)
        .when(tables > 0, "table_content_overlap")
        .when((rare > 0) & (jaccard >= 0.5), "rare_text_high_overlap")
        .when((rare > 0) & (jaccard >= 0.2), "rare_text_partial_overlap")
    )


def best_match(pairs: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the given order."""
    return pairs.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def stratified(rows: DataFrame, strata: list[str], score: str, key: str, target: float, most: int) -> DataFrame:
    """At most ``most`` rows of each stratum, those nearest the target score first, then by key; ``place`` from 1."""
    order = Window.partitionBy(*strata).orderBy(F.abs(F.col(score) - target), key)
    return rows.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= most)


def canonical_pairs(rows: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """One row of each unordered pair: the one with the largest score, then the lower left side."""
    out = rows.withColumns({"pair_low": F.least(left, right), "pair_high": F.greatest(left, right)})
    return best_match(out, ["pair_low", "pair_high"], [F.desc(score), F.col(left)])
