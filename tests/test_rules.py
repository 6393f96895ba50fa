"""Cells, identity of organisations, titles, page search and pair comparison on hand-made rows."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import cells as L
from folioscope.operators import entities as E
from folioscope.operators import identity as D
from folioscope.operators import pages as G
from folioscope.operators import pairs as P
from folioscope.operators import registry as R
from folioscope.operators import scores as W
from folioscope.operators import title_blocks as B
from folioscope.operators import titles as Z


def test_handoff_of_even_quarters(spark):
    rows = [("a", "b", f"2020-Q{k}", 1, 1) for k in (1, 2)]
    out = D.activity(spark.createDataFrame(rows, "a string, b string, quarter string, na int, nb int")).first()
    # half before times half after, whichever way; the boundary is the first quarter after
    assert (out["handoff_score"], out["direction"], out["boundary"], out["correlation"], out["quarters"]) == (0.25, "a -> b", "2020-Q2", None, 2)


def test_handoff_takes_the_earliest_best_boundary(spark):
    schema = "a string, b string, quarter string, na int, nb int"
    rows = [("a", "b", f"2020-Q{k}", na, nb) for k, (na, nb) in enumerate([(5, 0), (5, 0), (0, 0), (0, 4)], 1)]
    rows += [("a", "c", f"2020-Q{k}", na, nb) for k, (na, nb) in enumerate([(0, 3), (1, 1), (4, 0)], 1)]
    rows += [("a", "d", "2020-Q1", 3, 0), ("a", "e", "2020-Q1", 3, 0), ("a", "e", "2020-Q2", 3, 0)]
    out = {r["b"]: r for r in D.activity(spark.createDataFrame(rows, schema)).collect()}
    assert (out["b"]["handoff_score"], out["b"]["direction"], out["b"]["boundary"], out["b"]["quarters"]) == (1.0, "a -> b", "2020-Q4", 3)
    assert (out["c"]["handoff_score"], out["c"]["direction"], out["c"]["boundary"]) == (0.8, "c -> a", "2020-Q3") and out["c"]["correlation"] < 0
    assert (out["d"]["handoff_score"], out["d"]["direction"], out["d"]["boundary"]) == (0.0, "", "") and out["e"]["handoff_score"] == 0.0


def test_baselines_of_either_organisation(spark):
    rows = [("c", "x", "x", 0.8), ("c", "x", "y", 0.4), ("c", "y", "z", 0.5), ("c", "z", "z", 0.0), ("c", "x", "z", 0.2), ("d", "x", "y", 0.3)]
    out = {(r["cell"], r["left_org"], r["right_org"]): r for r in D.self_baselines(spark.createDataFrame(rows, "cell string, left_org string, right_org string, style double"), ["style"]).collect()}
    assert (out["c", "x", "y"]["baselines"], out["c", "x", "y"]["style_reference"], out["c", "x", "y"]["style_retention"]) == (1, 0.8, 0.5)
    assert (out["c", "x", "z"]["baselines"], out["c", "x", "z"]["style_reference"], out["c", "x", "z"]["style_retention"]) == (2, 0.4, 0.5)
    assert (out["c", "y", "z"]["baselines"], out["c", "y", "z"]["style_retention"]) == (1, None) and out["d", "x", "y"]["baselines"] == 0
    assert out["c", "x", "x"]["style_retention"] == 1.0


def test_edge_types(spark):
    t = lambda *x: D.edge_type(*[F.lit(v) for v in x])
    row = spark.range(1).select(t(True, 1, 1, 1.0), t(True, 1, 0, 0.4), t(True, 1, 0, 0.39), t(True, 0, 0, 1.0), t(False, 3, 0, 1.0)).first()
    assert list(row) == ["disclosed_subcontract_network", "rename_candidate", "shared_gip_handwriting", "owner_or_template_candidate", "not_in_identity_graph"]


def test_components_and_attachments(spark):
    matrix = [("a", "b", True, 1, 0, 0.5), ("b", "c", True, 1, 0, 0.1), ("a", "c", True, 0, 0, 0.0), ("d", "e", False, 0, 2, 0.0), ("a", "d", True, 0, 0, 0.0), ("f", "g", True, 0, 0, 0.0), ("a", "b2", False, 9, 0, 1.0)]
    objects = spark.createDataFrame([(o, n) for n, o in enumerate("abcdefg", 1)], "org string, n int")
    edges = D.typed_edges(spark.createDataFrame(matrix, "a string, b string, handwriting boolean, shared_gips int, disclosed int, handoff_score double"), objects).cache()
    kinds = {(r["a"], r["b"]): r for r in edges.collect()}
    assert len(kinds) == 6 and kinds["f", "g"]["template_risk"] and kinds["f", "g"]["large_orgs"] == "g" and not kinds["a", "c"]["template_risk"]
    assert kinds["a", "b"]["policy"] == "core_identity_component" and kinds["b", "c"]["policy"] == "separate_research_component"
    parts = D.typed_components(edges)
    got = Counter((r["edge_type"], r["component_id"]) for r in parts.collect())
    assert got == {("rename_candidate", "a"): 2, ("disclosed_subcontract_network", "d"): 2, ("shared_gip_handwriting", "b"): 2, ("owner_or_template_candidate", "a"): 3, ("owner_or_template_candidate", "f"): 2}
    found = {(r["a"], r["b"]): (r["a_core"], r["b_core"], r["attachment_status"]) for r in D.attachments(edges, parts).collect()}
    assert found == {
        ("b", "c"): ("rename_candidate:a", "", "unvalidated_attachment_to_core"), ("a", "c"): ("rename_candidate:a", "", "unvalidated_attachment_to_core"),
        ("a", "d"): ("rename_candidate:a", "disclosed_subcontract_network:d", "unvalidated_attachment_to_core"),
    }
    inside = spark.createDataFrame([("a", "b", "owner_or_template_candidate")], "a string, b string, edge_type string")
    assert D.attachments(inside, parts).first()["attachment_status"] == "secondary_support_inside_core"


def test_cells(spark):
    rows = [("m", "same_org", v, 0.5) for v in (0.2, 0.4, 0.6)] + [("m", "cross_org", v, 0.4) for v in (0.3, 0.3, 0.5)] + [("x", "cross_org", 0.9, 0.1), ("s", "same_org", 0.0, 0.0), ("z", "same_org", 0.0, 0.5), ("z", "cross_org", 0.4, 0.5)]
    cells = L.cell_medians(spark.createDataFrame(rows, "cell string, relation string, a double, b double"), ["a", "b"])
    out = {r["cell"]: r for r in cells.collect()}
    assert (out["m"]["same_org_a"], out["m"]["cross_org_a"], out["m"]["cross_minus_same_a"], out["m"]["cross_to_same_a"]) == (0.4, 0.3, -0.1, 0.75)
    assert out["x"]["comparison_status"] == "cross_only_no_same_org_baseline" and out["s"]["comparison_status"] == "same_only_no_cross_org_test" and out["z"]["cross_to_same_a"] is None
    assessed = {r["cell"]: (r["structural_transfer"], r["content_transfer"], r["transfer"]) for r in L.assess(cells, ["a"], ["b"]).collect()}
    assert assessed == {"m": ("transfer", "transfer", "transfer_both"), "z": ("org_bound", "transfer", "insufficient")}
    middle = L.median_of_medians(cells, ["a", "b"]).first()
    assert (middle["cells"], middle["same_org_a"], middle["cross_org_a"], middle["cross_minus_same_a"]) == (2, 0.2, 0.35, 0.15)
    old = spark.createDataFrame([("m", "org_bound"), ("z", "transfer_both")], "cell string, transfer string")
    assert {r["cell"]: r["replication"] for r in L.replication_status(L.assess(cells, ["a"], ["b"]), old).collect()} == {"m": "status_changed", "z": "support_changed"}


@pytest.mark.parametrize(("ratios", "want"), [((0.8, 0.9), "transfer"), ((0.8, 0.1), "partial"), ((0.5, 0.4), "partial"), ((0.5, 0.3), "org_bound"), ((0.8, None), "partial"), ((None, None), "org_bound")])
def test_channels(spark, ratios, want):
    assert spark.range(1).select(L.channel([F.lit(x).cast("double") for x in ratios])).first()[0] == want


def test_distance_buckets(spark):
    b = lambda same, d: L.distance_bucket(F.lit(same), F.lit(d).cast("double"), F.lit(1.0), F.lit(2.0))
    assert list(spark.range(1).select(b(True, 0.1), b(False, None), b(False, 1.0), b(False, 1.5), b(False, 2.0)).first()) == ["same_address", "tei_unknown", "near_tei_same_section", "mid_tei_same_section", "far_tei_same_section"]


def test_cluster_medians(spark):
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "member int, cluster_id int")
    pairs = spark.createDataFrame([(1, 2, 0.8), (2, 3, 0.6), (1, 4, 0.1)], '`left` int, `right` int, v double')
    out = {r["cluster_id"]: r for r in L.cluster_medians(clusters, pairs, ["v"]).collect()}
    assert (out[1]["size"], out[1]["internal_pairs"], out[1]["median_v"], out[1]["min_v"], out[1]["max_v"]) == (3, 2, 0.7, 0.6, 0.8) and (out[4]["internal_pairs"], out[4]["median_v"]) == (0, None)


def test_map_jaccard(spark):
    m = lambda d: F.create_map(*[F.lit(v) for p in d.items() for v in p]) if d else F.create_map().cast("map<string,int>")
    got = spark.range(1).select(W.multiset_jaccard(m({"a": 2, "b": 1}), m({"a": 1, "c": 3})), W.multiset_jaccard(m({}), m({})), W.multiset_jaccard(m({"a": 1}), m({}))).first()
    assert list(got) == [pytest.approx(1 / 6), 0.0, 0.0]
    shares = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    assert spark.range(1).select(F.round(W.composition_cosine(shares(0.6, 0.4, 0), shares(0.6, 0, 0.4)), 6), W.composition_cosine(shares(0, 0, 0), shares(1, 0, 0))).first()[:] == (round(0.36 / 0.52, 6), 0.0)


def test_title_profiles_and_nearest(spark):
    schema = "doc_id int, section string, org string, page_no int, a int, b int, size string, signature string"
    pages = [(d, "s", "x" if d < 3 else "y", p, 4 + d % 2, p, f"z{p % 2}", f"g{p}") for d in (1, 2, 3) for p in range(4)]
    rows = Z.profiles(Z.scope_pages(spark.createDataFrame(pages, schema), [0], [0, 1]), ["a", "b"], ["doc_id", "section", "org"]).withColumn("content", F.concat(F.lit("c"), F.col("doc_id") % 2))
    sizes = {(r["scope"], r["doc_id"]): (r["pages"], dict(r["sizes"])) for r in rows.collect()}
    assert sizes["title_anchor", 1] == (1, {"z0": 1}) and sizes["cover_zone", 2] == (2, {"z0": 1, "z1": 1}) and sizes["body", 3][0] == 2
    scored = {(r["scope"], r["left_doc_id"], r["right_doc_id"]): r for r in Z.pair_scores(Z.all_pairs(rows)).collect()}
    assert len(scored) == 9 and scored["body", 1, 3]["with_size"] == 1.0 and scored["body", 1, 3]["pair_type"] == "cross_org" and scored["title_anchor", 1, 2]["ratio"] == 0.8
    assert scored["title_anchor", 1, 2]["with_size"] == pytest.approx(0.6 * 0.8 + 0.3 + 0.1) and scored["title_anchor", 1, 2]["no_size"] == round((0.6 * 0.8 + 0.3) / 0.9, 4)
    near = {(r["scope"], r["metric"], r["doc_id"]): r["nearest"] for r in Z.nearest(Z.pair_scores(Z.all_pairs(rows, directed=True))).collect()}
    # 1 and 3 have equal content and don't count for each other; 2 is near to both, on a tie the lowest content, then id
    assert near["body", "with_size", 1] == 2 and near["body", "no_size", 3] == 2 and near["body", "with_size", 2] == 1


def test_parties_and_sections(spark):
    status = lambda t, s: Z.section_status(F.lit(t), F.lit(s))
    assert list(spark.range(1).select(status("A", "A"), status("B", "A"), status("", "A"), status(None, "A")).first()) == ["title_matches_selection", "title_overrides_selection", "selection_fallback", "selection_fallback"]
    roles = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3)]
    rows = spark.createDataFrame(roles, "i int, n int").select("i", "n", Z.party_role(F.col("i"), F.col("n")).alias("r"), *[c.alias(k) for c, k in zip(Z.effective_author(F.col("i"), F.col("n")), ("a", "rule"), strict=True)]).collect()
    assert {(r["i"], r["n"]): (r["r"], r["a"]) for r in rows} == {(1, 1): ("lead_designer", True), (1, 2): ("lead_designer", False), (2, 2): ("subcontractor", True), (2, 3): ("unresolved", False), (3, 3): ("unresolved", False)}
    lines = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 1, 3, "c"), (1, 2, 4, "z")], "d int, page int, y int, text string")
    assert Counter((r["text"], r["y"]) for r in B.line_runs(lines, ["d"]).collect()) == Counter([("a", 1), ("b", 2), ("c", 3), ("a b", 1), ("b c", 2), ("a b c", 1), ("c b", 2), ("b a", 1), ("c b a", 1), ("z", 4)])


def brute_near(l, r):
    ratio = lambda x, y: (lambda v: sum(v) / len(v) if v else 1.0)([min(a, b) / max(a, b) for a, b in zip(x, y, strict=True) if a or b])
    share = lambda x: [a / sum(x) if sum(x) else 0.0 for a in x]
    least = lambda x, y: sum(map(min, share(x), share(y)))
    e = min(l["e"], r["e"]) / max(l["e"], r["e"]) if max(l["e"], r["e"]) else 1.0
    return 0.30 * ratio(l["c"], r["c"]) + 0.20 * least(l["c"], r["c"]) + 0.25 * ratio(l["a"], r["a"]) + 0.15 * least(l["a"], r["a"]) + 0.10 * e


@pytest.fixture(scope="module")
def some_pages(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        counts = [float(rng.choice([0, 1, 2, 3, 40])) for _ in range(4)] if k % 10 else [1.0, 2.0, 0.0, 0.0]
        areas = [c * rng.choice([1, 5]) for c in counts] if k % 10 else [1.0, 4.0, 0.0, 0.0]
        rows.append((k, f"d{k % 12}", f"c{k % 5}", counts, areas, sum(counts), f"{counts}{areas}"))
    return rows, spark.createDataFrame(rows, "page_id bigint, document string, cohort string, counts array<double>, areas array<double>, elements double, signature string")


@pytest.mark.parametrize("mode", ["any", "cross_org"])
def test_page_search_is_exact_when_the_shortlist_holds_all(some_pages, mode):
    rows, df = some_pages
    as_dict = {r[0]: {"c": r[3], "a": r[4], "e": r[5]} for r in rows}
    got = {}
    for r in G.neighbors(df, mode, shortlist=60, top=4).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbor"], r["score"], r["exact"]))
    for q in rows:
        others = [r for r in rows if r[1] != q[1] and (mode == "any" or r[2] != q[2])]
        best = sorted((-round(brute_near(as_dict[q[0]], as_dict[r[0]]), 9), not (r[6] == q[6]), r[0]) for r in others)[:4]
        assert [(n, pytest.approx(s, abs=1e-8)) for _, n, s, _ in sorted(got[q[0]])] == [(n, -s) for s, _, n in best]


def test_equal_signatures_are_always_candidates(some_pages):
    rows, df = some_pages
    found = {(r["query"], r["neighbor"]) for r in G.neighbors(df, "any", shortlist=1, top=60).collect() if r["exact"]}
    assert found == {(a[0], b[0]) for a, b in itertools.permutations(rows, 2) if a[6] == b[6] and a[1] != b[1]}


def test_best_pages_of_document_pairs(spark, some_pages):
    rows, df = some_pages
    rng = random.Random(9)
    texts = {r[0]: (set(rng.sample(range(20), 5)), set(rng.sample(range(30), 6))) for r in rows if r[0] != 7}
    table = spark.createDataFrame([(k, [int(x) for x in a], [int(x) for x in b]) for k, (a, b) in texts.items()], "page_id bigint, segments array<bigint>, shingles array<bigint>")
    pairs = spark.createDataFrame([("p", "d0", "d10"), ("q", "d7", "d3")], "pair_id string, left_document string, right_document string")
    got = {(r["pair_id"], r["direction"], r["query"]): (r["neighbor"], r["structural"], r["shingles"]) for r in G.best_in_pairs(pairs, df, table).collect()}
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    as_dict = {r[0]: {"c": r[3], "a": r[4], "e": r[5], "s": r[6]} for r in rows}
    none, want = (set(), set()), {}
    for pair, left, right in (("p", "d0", "d10"), ("q", "d7", "d3")):
        for direction, own, other in (("left_to_right", left, right), ("right_to_left", right, left)):
            for q in (r[0] for r in rows if r[1] == own):
                key = lambda n: (round(brute_near(as_dict[q], as_dict[n]), 9), round(jac(texts.get(q, none)[1], texts.get(n, none)[1]), 9), round(jac(texts.get(q, none)[0], texts.get(n, none)[0]), 9), as_dict[q]["s"] == as_dict[n]["s"], -n)  # noqa: E731, B023
                best = max((r[0] for r in rows if r[1] == other), key=key)
                want[pair, direction, q] = (best, pytest.approx(key(best)[0], abs=1e-8), pytest.approx(key(best)[1], abs=1e-8))
    assert got == want


def test_comparison_lists_pairs_that_share_nothing(spark):
    docs = spark.createDataFrame([(1, "s", "o1", "x"), (2, "s", "o2", "x"), (3, "s", "o3", "y"), (9, "s", "o1", "x")], "doc_id int, section string, object_id string, org string")
    pairs = P.comparison_pairs(P.canonical_documents(docs))
    assert sorted((r["left_doc"], r["right_doc"]) for r in pairs.collect()) == [(1, 2), (1, 3), (2, 3)]
    ents = [(1, "s", "o1", "text_segment", "h", 2), (2, "s", "o2", "text_segment", "h", 1), (2, "s", "o2", "text_segment", "g", 1), (3, "s", "o3", "table_cell_text", "h", 1), (9, "s", "o1", "text_segment", "g", 5)]
    rows = spark.createDataFrame(ents, "doc_id int, section string, object_id string, entity_kind string, entity_hash string, n int")
    idf = spark.createDataFrame([("s", "text_segment", "h", 3.0)], "section string, entity_kind string, entity_hash string, section_idf double")
    out = {(r["left_doc"], r["right_doc"], r["entity_kind"]): r for r in P.compare(pairs, rows, idf, ("text_segment", "table_cell_text", "page_signature")).collect()}
    assert len(out) == 9
    assert (out[1, 2, "text_segment"]["raw_value"], out[1, 2, "text_segment"]["idf_value"], out[1, 2, "text_segment"]["status"]) == (pytest.approx(1 / 3), pytest.approx(3 / 7), "measured")
    assert (out[1, 2, "text_segment"]["shared_idf"], out[1, 2, "text_segment"]["union_idf"]) == (3.0, 4.0)
    assert out[1, 3, "text_segment"]["status"] == "measured_no_overlap" and out[1, 2, "page_signature"]["status"] == "not_present"


def test_entities_of_tables(spark):
    text = "intro\na | B |c\nd|e\n\nx|x"
    docs = spark.createDataFrame([(1, "s", "o", text), (2, "s", "o", None)], "doc_id int, section string, object_id string, text string")
    plain = lambda c: c
    segs = E.segments(docs)
    got = {(r["entity_kind"], r["entity_hash"]): r["n"] for r in E.table_entities(segs, plain).unionByName(E.page_entities(segs, plain)).collect()}
    assert got == {
        ("table_cell_text", "a"): 1, ("table_cell_text", "b"): 1, ("table_cell_text", "c"): 1, ("table_cell_text", "d"): 1, ("table_cell_text", "e"): 1, ("table_cell_text", "x"): 2,
        ("table_layout_signature", "rows:2|cols:3|cells:5"): 1, ("table_layout_signature", "rows:1|cols:2|cells:2"): 1,
        ("table_content_signature", "0:0:a\n0:1:b\n0:2:c\n1:0:d\n1:1:e"): 1, ("table_content_signature", "0:0:x\n0:1:x"): 1, ("page_signature", "lines:5|tables:3|blank:1"): 1,
    }


def test_names_and_places(spark):
    ids = ["12345", "123_2045", "123.0", "7", "", None, "12_3", "1234521"]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "k int, x string").select("k", T.archive_id(F.col("x")).alias("a")).collect()
    assert {r["k"]: r["a"] for r in got} == {0: "0123_45", 1: "0123_45", 2: "0001_23", 3: "", 4: "", 5: "", 6: "0012_03", 7: "12345_21"}
    forms = ["ООО «Ромашка»", "Общество с ограниченной ответственностью Х", "ПАО Банк", "АО ССУ", "000 Тип", "Каопроект"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in forms], "x string").select(T.legal_form(F.col("x"))).collect()] == ["ООО", "ООО", "ПАО", "АО", "ООО", ""]
    row = spark.range(1).select(T.file_url(F.lit("C:\\a b\\ё.pdf")), T.file_url(F.lit("/x/y")), T.signature_areas(F.lit("size:1x1|groups:text:3:1,5:x;lines:1:2:y;bad:1"))).first()
    assert row[0] == "file:///C%3A/a%20b/%D1%91.pdf" and row[1] == "file:///x/y" and row[2] == {"text": 1.5, "lines": 2.0}
    places = spark.range(1).select(R.ordered_place(F.lit("КР"), R.SECTION_ORDER), R.ordered_place(F.lit("?"), R.SECTION_ORDER), R.numeric_prefix(F.lit("0042_20")), R.numeric_prefix(F.lit("x"))).first()
    assert list(places) == [20, 999, 42, 2**62]


def test_most_common_by_first_seen(spark):
    rows = spark.createDataFrame([("g", v, k) for k, v in enumerate("bbaacd")], "g string, v string, k int")
    assert R.most_common(rows, ["g"], "v", "k", 3).first()["most_common"] == "b:2|a:2|c:1"


def test_erfc_is_used_without_python(spark):
    from folioscope.operators import stats as A

    plan = spark.range(3).select(A.p_value(F.rand(), F.lit(9)))._jdf.queryExecution().toString()
    assert "Python" not in plan and math.isclose(spark.range(1).select(A.erfc(F.lit(0.5))).first()[0], math.erfc(0.5), rel_tol=1e-13)


def test_a_number_is_no_legal_form(spark):
    forms = ["АО «Проект 6000»", "«Проект 10005»", "000 «Проект 1000»", "АО1 Х"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in forms], "x string").select(T.legal_form(F.col("x"))).collect()] == ["АО", "", "ООО", ""]
