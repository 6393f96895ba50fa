"""Best pages inside document pairs, in blocks: the scores of near_match() to the last bit, whatever the blocks."""

import random

from pyspark.sql import functions as F

from folioscope.operators import library as L
from folioscope.operators import pages as G

SCHEMA = "page_id bigint, document string, cohort string, counts array<double>, areas array<double>, elements double, signature string"


def _rows(n):
    random.seed(5)
    out = []
    for k in range(n):
        c, a = [[float(random.choice([0, 0, 1, 2, 7, 31])) for _ in range(7)] for _ in range(2)]
        c = [None] * 7 if k == 3 else [0.0] * 7 if k == 4 else c
        out.append((k, f"d{k % 3}", "c", c, a, None if k == 3 else sum(c), f"s{k % 5}"))
    return out


def test_blocks_find_what_all_pairs_find(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 4)
    pages = spark.createDataFrame(_rows(40), SCHEMA)
    pairs = spark.createDataFrame([(f"d{a}__d{b}", f"d{a}", f"d{b}") for a in range(3) for b in range(a + 1, 3)], "pair_id string, left_document string, right_document string")
    texts = pages.select("page_id", F.array(F.col("page_id") % 4).alias("segments"), F.array(F.col("page_id") % 2).alias("shingles"))
    found = G.best_in_pairs(pairs, pages, texts)
    got = {(r["pair_id"], r["direction"], r["query"]): r["structural"] for r in found.collect()}
    sides = pairs.join(G._side(pages, "query", "l"), F.col("left_document") == F.col("query_document")).join(G._side(pages, "neighbor", "r"), F.col("right_document") == F.col("neighbor_document"))
    scored = G.near_match(sides).withColumn("s", F.round("near_match_similarity", 9))
    want = {}
    for name, page in (("left_to_right", "query"), ("right_to_left", "neighbor")):
        want |= {(r["pair_id"], name, r[page]): r["s"] for r in scored.groupBy("pair_id", page).agg(F.max("s").alias("s")).collect()}
    assert got == want


def test_page_pairs_are_dealt_out_whatever_their_size(spark):
    pages = spark.createDataFrame(_rows(12), SCHEMA)
    pairs = spark.createDataFrame([("d0__d1", "d0", "d1")], "pair_id string, left_document string, right_document string")
    texts = pages.select("page_id", F.array(F.lit(1)).cast("array<bigint>").alias("segments"), F.array(F.lit(1)).cast("array<bigint>").alias("shingles"))
    plan = G.best_in_pairs(pairs, pages, texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and "FlatMapCoGroupsInPandas" in plan


def test_library_entities_are_shuffled_once(spark):
    rows = spark.createDataFrame([(k, "en", f"o{k}", "s", "text_segment", bytearray([7] * 20), 1, 4, 20) for k in range(4)], "doc_id bigint, section string, object_id string, org string, entity_kind string, entity_hash binary, n bigint, tokens int, chars int")
    found = L.candidates(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.split("Exchange hashpartitioning(")[1:] if "entity_hash" in x.split(")")[0]]) == 1
    text = L.candidates(rows.withColumn("entity_hash", F.lower(F.hex("entity_hash"))))
    assert [r[0] for r in found.select("candidate_id").collect()] == [r[0] for r in text.select("candidate_id").collect()]


def test_likeness_in_strips_is_that_of_any_numbers():
    """Strips of any height give the same doubles as whole matrices; unknown and negative numbers go the other way."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)

    def pages(n):
        counts = rng.integers(0, 4, (n, 7)).astype(float)
        areas = rng.integers(0, 60, (n, 7)) * (counts > 0) * 1.0
        counts[:1], areas[:1] = 0.0, 0.0
        return pd.DataFrame({"counts": list(counts), "areas": list(areas), "elements": counts.sum(axis=1)})

    for n, m in ((1, 1), (70, 500), (5, 20000)):
        l, r = pages(n), pages(m)
        assert np.array_equal(G._likeness(l, r), G._likeness_of_any(l, r))
    l.at[2, "counts"] = [np.nan, -1.0, *l.at[2, "counts"][2:]]
    assert np.array_equal(G._likeness(l, r), G._likeness_of_any(l, r))


def test_review_queue_searches_once(spark, tmp_path, monkeypatch):
    from folioscope.plans import page_queries as Q

    pages = [(k, f"https://h{k % 6}.example.com/{('en', 'fr')[k % 2]}/p{k}", "<p>some text</p>" * (k % 5 + 1) + f"<li>item {k % 3}</li>") for k in range(40)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    calls = []
    search = Q.G.neighbors
    monkeypatch.setattr(Q.G, "neighbors", lambda *x: calls.append(x[1]) or search(*x))
    Q.review_queue(spark, str(tmp_path)).collect()
    assert calls == ["cross_org"]
