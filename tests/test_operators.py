"""Functions and operators on hand-made rows, edge rows included."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.functions import similarity as S
from folioscope.functions import text as T
from folioscope.operators import components as C
from folioscope.operators import entities as E
from folioscope.operators import frequency as Q
from folioscope.operators import golden as G
from folioscope.operators import library as L
from folioscope.operators import neighbors as N
from folioscope.operators import ordered as O
from folioscope.operators import pages as P
from folioscope.operators import registry as R
from folioscope.operators import review as V
from folioscope.operators import stats as A


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict(recursive=True)


def test_normalize_text(spark):
    out = one(spark, a=T.normalize_text(F.lit(" Ðð  Öö\tÞþ Ёё ")), b=T.normalize_text(F.lit(" \n ")), c=T.normalize_text(F.lit(None).cast("string")))
    assert out == {"a": "рр цц юю ее", "b": "", "c": None}


def test_tokens_and_shingles(spark):
    words = T.tokens(F.lit("Ab, c de_f 12 gé h1"))
    out = one(spark, t=words, s=T.word_shingles(words, 3), none=T.word_shingles(words, 6))
    assert out == {"t": ["ab", "de_f", "12", "gé", "h1"], "s": ["ab de_f 12", "de_f 12 gé", "12 gé h1"], "none": []}


def test_tolerant_numbers(spark):
    out = one(spark, a=T.safe_double(F.lit("1,5")), b=T.safe_int(F.lit("-2,9")), c=T.safe_double(F.lit("x"), None), d=T.safe_double(F.lit("inf")), e=T.is_true(F.lit(" TRUE ")), f=T.page_ranges(F.lit("7;3-5;9-8;x;4")))
    assert out == {"a": 1.5, "b": -2, "c": None, "d": 0.0, "e": True, "f": [3, 4, 5, 7]}


def test_dates_and_names(spark):
    out = one(spark, d=T.excel_date(F.lit(45292)).cast("string"), q=T.quarter_label(F.lit("2024-05-01").cast("date")), n=T.quoted_name(F.lit("firm «A b» x")))
    assert out == {"d": "2024-01-01", "q": "2024-Q2", "n": "A b"}


def test_set_and_vector_similarities(spark):
    a = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    empty = F.array().cast("array<string>")
    out = one(
        spark,
        jac=S.set_jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))),
        none=S.set_jaccard(empty, empty),
        zero=S.cosine(a(0, 0), a(1, 2)),
        cos=F.round(S.cosine(a(1, 0), a(1, 1)), 6),
        ratio=S.ratio_similarity(a(0, 2, 4), a(0, 1, 4)),
        skipped=S.ratio_similarity(a(0, 0), a(0, 0)),
        comp=S.composition_similarity(S.shares(a(1, 3)), S.shares(a(2, 2))),
        z=S.z_distance(a(1, 2), a(2, 4), a(1, 2)),
    )
    assert out == {"jac": pytest.approx(1 / 3), "none": 0.0, "zero": 0.0, "cos": 0.707107, "ratio": 0.75, "skipped": 1.0, "comp": 0.75, "z": 1.0}


def test_weighted_applicable(spark):
    value, weight = S.weighted_applicable([(F.lit(0.5), F.lit(True), 0.4), (F.lit(1.0), F.lit(False), 0.6)])
    assert one(spark, v=value, w=weight) == {"v": 0.5, "w": 0.4}
    value, weight = S.weighted_applicable([(F.lit(0.5), F.lit(False), 0.4)])
    assert one(spark, v=value, w=weight) == {"v": 0.0, "w": 0.0}


def test_frequency_buckets(spark):
    b = lambda df, n: Q.bucket(F.lit(df), F.lit(n))
    assert one(spark, a=b(1, 1), b=b(1, 4), c=b(2, 4), d=b(2, 5)) == {"a": "low_population", "b": "original", "c": "typical", "d": "shared_rare"}


def test_entities_of_edge_rows(spark):
    docs = spark.createDataFrame([(1, "s", "o", None), (2, "s", "o", ""), (3, "s", "o", " \n\t"), (4, "s", "o", "a bb cc dd ee ff"), (5, "s", "o", "x\nX ")], "doc_id int, section string, object_id string, text string")
    rows = E.text_entities(E.segments(docs)).groupBy("doc_id", "entity_kind").agg(F.sum("n").alias("n")).collect()
    assert {(r["doc_id"], r["entity_kind"], r["n"]) for r in rows} == {(4, "text_segment", 1), (4, "text_word_shingle", 1), (5, "text_segment", 2)}


def test_ranks_with_ties(spark):
    rows = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", 4.0), ("h", 7.0)], "g string, x double")
    out = O.with_places(rows, ["g"], "x", r=O.AVERAGE_RANK, p=O.MIDRANK).collect()
    assert sorted((r["g"], r["r"], round(r["p"], 4)) for r in out) == [("g", 1.0, 0.0), ("g", 2.5, 0.5), ("g", 2.5, 0.5), ("g", 4.0, 1.0), ("h", 1.0, 0.5)]


def test_spearman_guards(spark):
    rows = spark.createDataFrame([("two", 1.0, 1.0, 1.0), ("two", 2.0, 2.0, 2.0)] + [("flat", 1.0, float(k), 1.0) for k in range(4)] + [("ok", float(k), float(-k), float(k % 2)) for k in range(5)] + [("ok", None, 1.0, 1.0)], "g string, x double, y double, z double")
    out = {r["g"]: r for r in A.spearman(rows, ["g"], "x", "y", "z").collect()}
    assert set(out) == {"ok"} and out["ok"]["spearman"] == -1.0 and out["ok"]["direction"] == "negative" and out["ok"]["n"] == 5 and out["ok"]["p"] == 0.0


def test_p_values_are_tail_probabilities(spark):
    import math

    cases = [(r / 20, n) for r in range(-20, 21, 3) for n in (3, 4, 9, 60, 1000)]
    rows = spark.createDataFrame(cases, "r double, n int").withColumn("p", A.p_value(F.col("r"), F.col("n"))).collect()
    for x in rows:
        want = None if x["n"] < 4 else 0.0 if abs(x["r"]) >= 1 else round(math.erfc(abs(x["r"]) * math.sqrt(x["n"] - 1) / math.sqrt(2)), 6)
        assert x["p"] == (want if want is None else pytest.approx(want, abs=1.01e-6))
    tails = spark.createDataFrame([(k / 10,) for k in range(0, 70)], "x double").withColumn("e", A.erfc(F.col("x"))).collect()
    assert all(abs(r["e"] - math.erfc(r["x"])) < 1e-14 for r in tails)


def test_order_quartiles(spark):
    values = [5.0, 1.0, 3.0, 3.0, 9.0, None, 2.0, 7.0, 8.0, 3.0]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 4.0)], "g string, x double")
    known = sorted(v for v in values if v is not None)
    out = {r["g"]: (r["q1"], r["q3"]) for r in A.order_quartiles(rows, ["g"], "x").collect()}
    assert out == {"a": (known[len(known) // 4], known[3 * len(known) // 4]), "b": (4.0, 4.0)}


def test_benjamini_hochberg(spark):
    rows = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5)], "k int, p double").withColumn("g", F.lit(1))
    out = {r["k"]: r["q"] for r in O.false_discovery(rows, ["g"], "p").collect()}
    assert out == {1: 0.04, 3: pytest.approx(0.053333), 2: pytest.approx(0.053333), 4: 0.5}


def test_components(spark):
    edges = spark.createDataFrame([(2, 1), (2, 3), (9, 8)] + [(k, k + 1) for k in range(20, 40)], "a int, b int")
    nodes = spark.createDataFrame([(1,), (2,), (3,), (5,), (8,), (9,)] + [(k,) for k in range(20, 41)], "member int")
    out = {r["member"]: r["component_id"] for r in C.components(edges, nodes).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 5: 5, 8: 8, 9: 8} | {k: 20 for k in range(20, 41)}


def test_near_match_classes(spark):
    c = lambda s, e=False: P.near_match_class(F.lit(s), F.lit(e))
    assert one(spark, a=c(0.1, True), b=c(0.95), c=c(0.85), d=c(0.7), e=c(0.69)) == {"a": "exact_match", "b": "near_exact", "c": "strong_near_match", "d": "moderate_near_match", "e": "weak_match"}


def test_neighbors_ties_and_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [1.0, 0.0] if k % 2 else [0.0, 1.0], k % 3) for k in range(12)] + [(None, [1.0, 0.0], 1), (99, None, 1), (50, [0.0, 0.0], 1)], "id bigint, v array<double>, c int")
    whole = {tuple(r) for r in N.top_k(rows, rows.where("id in (1, 2)"), 3, "id", "v", "c").collect()}
    monkeypatch.setattr(N, "BLOCK", 1)
    assert whole == {tuple(r) for r in N.top_k(rows, rows.where("id in (1, 2)"), 3, "id", "v", "c").collect()}
    assert {(q, n, r) for q, n, _, r in whole} == {(1, 3, 1), (1, 5, 2), (1, 7, 3), (2, 0, 1), (2, 4, 2), (2, 6, 3)}
    assert N.top_k(rows, rows.where("false"), 3, "id", "v", "c").count() == 0


LIBRARY = "doc_id int, section string, object_id string, org string, entity_kind string, entity_hash string, n int, tokens int, chars int"


def library_rows(spark):
    """Each document is an object of its own; x has objects 1 to 3, y has 4 to 7."""
    held = {"one": [1, 2, 3], "both": [1, 2, 4, 5], "led": [1, 2, 3, 4], "short": [1, 2, 4, 5], "two": [1, 4]}
    rows = [(d, "s", f"o{d}", "x" if d < 4 else "y", "text_segment", h, 2, 2 if h == "short" else 5, 30) for h, docs in held.items() for d in docs]
    rows += [(d, "s", f"o{d}", "y", "text_segment", "other", 1, 5, 30) for d in (6, 7)]
    return spark.createDataFrame(rows, LIBRARY)


def test_organisation_classes(spark):
    found = {r["entity_hash"]: r for r in L.candidates(library_rows(spark)).collect()}
    assert {h: (r["org_class"], r["dominant_org"], r["candidate_class"], r["candidate_status"]) for h, r in found.items()} == {
        "one": ("org_specific", "x", "org_text_pattern", "candidate"), "both": ("cross_org_common", "x", "normative_text", "candidate"),
        "led": ("org_distinctive", "x", "normative_text", "candidate"), "short": ("cross_org_common", "x", "normative_text", "diagnostic_trivial"),
    }
    assert found["led"]["org_object_counts"] == "x:3|y:1" and found["led"]["delta"] == 0.75 and found["short"]["triviality_reason"] == "token_count<3"
    rare = {r["entity_hash"]: (r["candidate_class"], r["signal"]) for r in L.candidates(library_rows(spark), bridge=0.6).collect()}
    assert rare["led"] == ("cross_org_text_bridge", "copy_review_needed") and rare["both"][0] == "normative_text"


def test_objects_are_not_documents(spark):
    """Three documents of one object don't make a candidate."""
    rows = [(d, "s", "o1" if d < 4 else "o2", "x", "text_segment", "h", 1, 5, 30) for d in range(1, 6)]
    assert L.candidates(spark.createDataFrame(rows, LIBRARY)).count() == 0


def test_coverage_counts_expected_and_foreign(spark):
    rows = library_rows(spark)
    docs = rows.select("doc_id", "section", "org").distinct().unionByName(spark.createDataFrame([(99, "s", "x")], "doc_id int, section string, org string"))
    out = {r["doc_id"]: r for r in L.coverage(docs, rows, L.candidates(rows), {"text_segment": "segment"}).collect()}
    first, fourth, none = out[1], out[4], out[99]
    # document 1 of x: one, both, led match (2 each), short and two don't; all matched is expected
    assert (first["all_total"], first["all_matched"], first["expected"], first["foreign"], first["conformance"]) == (10, 6, 6, 0, 1.0)
    # document 4 of y: both is common, led is x's
    assert (fourth["all_matched"], fourth["expected"], fourth["foreign"], fourth["foreign_ratio"]) == (4, 2, 2, 0.5)
    assert none["coverage_status"] == "no_text" and none["conformance"] == 0.0 and first["segment_residual"] == 4


@pytest.mark.parametrize(("foreign", "copy", "tables", "want"), [(0.0, 0.0, 1, "review_high"), (0.0, 0.05, 0, "review_high"), (0.05, 0.0, 0, "review_watch"), (0.0, 0.005, 0, "review_watch"), (0.04, 0.004, 0, "review_clear")])
def test_review_priority(spark, foreign, copy, tables, want):
    assert one(spark, p=L.review_priority(F.lit(foreign), F.lit(copy), F.lit(tables))) == {"p": want}


def test_linkage_is_many_to_many(spark):
    s = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, s int")
    e = spark.createDataFrame([("a", 7), ("a", 8), ("c", 9)], "k string, e int")
    out = R.linkage(s, e, "k").groupBy("link_status").count().collect()
    assert {(r[0], r[1]) for r in out} == {("matched", 4), ("source_only", 1), ("export_only", 1)}


def test_labels_keep_what_is_not_replaced(spark):
    store = spark.createDataFrame([(1, "x", "n"), (2, "y", None)], "id int, label string, note string")
    new = spark.createDataFrame([(1, "", "m"), (2, "z", None), (3, "q", "q")], "id int, label string, note string")
    assert {tuple(r) for r in R.upsert_labels(store, new, "id", ["label", "note"]).collect()} == {(1, "x", "m"), (2, "z", None)}


def test_guard_fails(spark):
    with pytest.raises(Exception, match="no such row"):
        R.require(spark.range(3), F.col("id") == 2, "no such row").collect()


def test_remark_depth(spark):
    rows = spark.createDataFrame([("Исправить оформление", ), ("Узел не соответствует разрезу",), (None,), ("согласно ГОСТ",)], "text string")
    out = [(r["primary_category"], r["depth_class"]) for r in V.remark_features(rows).collect()]
    assert out == [("formatting", "simple_candidate"), ("graphics", "substantial_candidate"), (None, None), ("regulatory", "simple_candidate")] or out[:2] == [("formatting", "simple_candidate"), ("graphics", "substantial_candidate")]


def golden(spark, payload, anchors):
    """Statuses by anchor of a JSON summary, read as Spark reads it."""
    rows = spark.read.json(spark.sparkContext.parallelize([json.dumps(payload)]))
    named = [{"artifact": "summary", **a, "anchor_id": str(k)} for k, a in enumerate(anchors)]
    got = {r["anchor_id"]: r for r in G.run(spark, named, {"summary": rows}).collect()}
    return [got[a["anchor_id"]]["status"] for a in named], [got[a["anchor_id"]]["found"] for a in named]


def test_golden_anchors(spark):
    payload = {"a": {"n": 1, "x": 2.5}, "s": "x", "t": True, "big": 2**60 + 1}
    statuses, found = golden(spark, payload, [
        {"operator": "equal", "json_path": "a.n", "expected": 1}, {"operator": "equal", "json_path": "a.n", "expected": 1.0}, {"operator": "approx", "json_path": ["a", "x"], "expected": 2.4, "tolerance": 0.2},
        {"operator": "between", "json_path": "a.x", "minimum": 3, "maximum": 4}, {"operator": "at_least", "json_path": "t", "minimum": 0}, {"operator": "sum_equal", "operands": ["a.n", "a.x"], "expected": 3.5},
        {"operator": "difference_at_least", "operands": ["a.x", "a.n"], "minimum_difference": 2}, {"operator": "equal", "json_path": "a.c", "expected": 1}, {"operator": "equal", "json_path": "s", "expected": "x"},
        {"operator": "equal", "json_path": "t", "expected": True}, {"operator": "equal", "json_path": "t", "expected": "true"}, {"operator": "equal", "json_path": "big", "expected": 2**60}, {"operator": "nearly", "json_path": "a.n", "expected": 1},
        {"operator": "at_least", "json_path": "a.n", "minimum": 1, "artifact": "other"}, {"operator": "at_least", "json_path": "a.n"},
    ])
    assert statuses == ["pass", "fail", "pass", "fail", "error", "pass", "fail", "error", "pass", "pass", "fail", "fail", "error", "error", "error"]
    assert found[5] == "3.5" and found[6] == "1.5" and found[11] == str(2**60 + 1)


def test_golden_filters_and_named_operands(spark):
    payload = {"rows": [{"k": "a", "n": 3, "v": {"x": 1}}, {"k": "b", "n": 3, "v": {"x": 5}}, {"k": "b", "n": 4, "v": {"x": 9}}], "total": 7}
    pick = lambda **where: {"filter": {"list_path": ["rows"], "where": where, "value_path": ["v", "x"]}}
    statuses, _ = golden(spark, payload, [
        {"operator": "equal", "expected": 5, **pick(k="b", n=3)}, {"operator": "equal", "expected": 5, **pick(k="b")}, {"operator": "equal", "expected": 5, **pick(k="z")},
        {"operator": "sum_equal", "expected": 8, "operands": [{"name": "a", **pick(k="a")}, {"name": "t", "json_path": ["total"]}]}, {"operator": "sum_equal", "expected": 8.0, "operands": [{"name": "a", **pick(k="a")}, {"name": "t", "json_path": ["total"]}]},
        {"operator": "difference_at_least", "minimum_difference": 6, "left_operand": "t", "right_operand": "a", "operands": [{"name": "a", **pick(k="a")}, {"name": "t", "json_path": "total"}]},
        {"operator": "sum_equal", "expected": 2, "operands": [{"name": "a", **pick(k="a")}, {"name": "a", **pick(k="a")}]}, {"operator": "equal", "expected": 1}, {"operator": "equal", "expected": 1, **pick(k="a", n="3")},
        {"operator": "equal", "expected": 1, "filter": {"list_path": ["total"], "where": {}, "value_path": ["x"]}},
    ])
    assert statuses == ["pass", "error", "error", "pass", "fail", "pass", "error", "error", "error", "error"]
