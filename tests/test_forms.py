"""The table-form library on small tables, against the rule written plainly."""

from collections import Counter, defaultdict

from folioscope.operators import table_forms as T
from folioscope.operators.library import combined_report

TABLE = "doc_id bigint, section string, object_id string, org string, table_id bigint, rows bigint, cols bigint, cells bigint, layout string, content string"
DOC = "doc_id bigint, section string, object_id string, org string"


def fixture():
    """(documents, tables): one object an id; forms that stay, mostly stay, vary, say nothing, are small, and are too rare."""
    docs = [(k, "A" if k < 20 else "B" if k < 22 else "UNKNOWN", f"o{k}", ("x", "y", "x", None, "UNKNOWN")[k % 5]) for k in range(24)]
    tables = []

    def add(doc, layout, content, size=(3, 3, 9)):
        d = docs[doc]
        tables.append((*d, len(tables), *size, layout, content))

    for k in (0, 1, 2):
        add(k, "same", "c")
    for k in range(10):
        add(k, "mostly", "c" if k < 8 else f"c{k}")
    for k in range(6):
        add(k, "varies", f"c{k}")
    for k in (0, 5, 10, 15):
        add(k, "silent", None, (2, 2, 4))
        add(k, "one_org", "c" if k < 15 else "d", (1, 8, 8))
    for k in (0, 1):
        add(k, "rare", "c")
    for k in (20, 21, 22, 23):
        add(k, "same", "c")
    for k in (0, 0, 0, 6, 6, 12, 12):
        add(k, "modes", "m", (2, 5, 7) if k == 6 else (4, 4, 9 + k))
    for k in (0, 2, 5, 7, 10, 12, 15, 17, 1):
        add(k, "lead", "c" if k % 2 else "d")
    add(3, "", "c")
    return docs, tables


def plain(docs, tables):
    """candidate_id-free facts of each form by the rule."""
    out = {}
    section_orgs, groups = defaultdict(lambda: defaultdict(set)), defaultdict(list)
    for doc, section, obj, org in docs:
        section_orgs[section][org].add(obj)
    for t in tables:
        if t[1] != "UNKNOWN" and t[8]:
            groups[t[1], t[8]].append(t)
    for key, rows in groups.items():
        objects = {t[2]: t[3] for t in rows}
        if len(objects) < 3:
            continue
        by_org = Counter(objects.values())
        contents = Counter(t[9] for t in rows if t[9])
        ratios = sorted(((n / len(section_orgs[key[0]][org]), org or "", n) for org, n in by_org.items()), reverse=True)
        delta = ratios[0][0] - (ratios[1][0] if len(ratios) > 1 else 0)
        held = "unknown" if not contents else "same_content" if len(contents) == 1 else "mostly_same_content" if max(contents.values()) / len(objects) >= 0.8 else "stable_form_variable_content"
        mode = lambda k: Counter(t[k] for t in sorted(rows, key=lambda t: (t[0], t[4]))).most_common(1)[0][0]  # noqa: B023, E731
        size = mode(5), mode(6), mode(7)
        trivial = [f"cell_count<{6}"] * (size[2] < 6) + ["one_dimensional_table"] * (size[0] <= 1 or size[1] <= 1)
        out[key] = (
            held, len(contents), "org_specific" if len(by_org) == 1 else "org_distinctive" if delta >= 0.25 else "cross_org_common",
            "borrowing_candidate" if len(by_org) > 1 and held in ("same_content", "mostly_same_content") else "typical_form", *size, len(objects), len({t[0] for t in rows}), len(rows), "|".join(trivial),
        )
    return out


def test_forms_follow_the_rule(spark):
    docs, tables = fixture()
    d, t = spark.createDataFrame(docs, DOC), spark.createDataFrame(tables, TABLE)
    known = [x for x in docs if x[3] is not None], [x for x in tables if x[3] is not None]
    found = T.candidates(spark.createDataFrame(known[1], TABLE), spark.createDataFrame(known[0], DOC)).collect()
    names = ("content_variability", "content_count", "org_class", "candidate_class", "rows_mode", "cols_mode", "cells_mode", "object_count", "document_count", "occurrence_count", "triviality_reason")
    assert {(r["section"], r["layout"]): tuple(r[n] for n in names) for r in found} == plain(*known)
    assert {r["content_variability"] for r in found} == {"same_content", "mostly_same_content", "stable_form_variable_content", "unknown"}
    assert {r["org_class"] for r in found} >= {"org_specific", "org_distinctive"} and len({r["candidate_id"] for r in found}) == len(found)
    assert {r["layout"] for r in T.candidates(t, d).collect()} == {"same", "mostly", "varies", "silent", "one_org", "modes", "lead"}
    assert T.candidates(t.where("false"), d).count() == 0


def test_coverage_knows_no_foreign_form_without_an_organisation(spark):
    docs, tables = fixture()
    d, t = spark.createDataFrame(docs, DOC), spark.createDataFrame(tables, TABLE)
    found = T.candidates(t, d)
    rows = {r["doc_id"]: r for r in T.coverage(d, t, found).collect()}
    assert set(rows) == {k for k, section, *_ in docs if section != "UNKNOWN"}
    assert rows[19]["coverage_status"] == "no_tables" and rows[19]["coverage_ratio"] == 0.0
    for k in (3, 4):  # no organisation, and UNKNOWN
        assert (rows[k]["matched"], rows[k]["expected"], rows[k]["foreign"]) == (2, 0, 0)
    assert rows[0]["tables"] == 10 and rows[0]["matched"] == 7 and rows[0]["trivial"] == 0 and rows[0]["residual"] == 3
    every = {r["doc_id"]: r for r in T.coverage(d, t, found, ("candidate", "diagnostic_trivial")).collect()}
    assert every[0]["matched"] == 9 and every[0]["trivial"] == 2 and every[0]["residual"] == 3
    assert every[0]["status_counts"] == "candidate:7|diagnostic_trivial:2"
    assert every[0]["top_candidates"].split("|")[0].endswith(":3") and not every[0]["ids_truncated"]


def test_lists_are_cut_but_counts_are_not(spark, monkeypatch):
    monkeypatch.setattr(T, "LISTED_IDS", 1)
    monkeypatch.setattr(T, "TOP_IDS", 2)
    monkeypatch.setattr(T, "LISTED_HASHES", 2)
    docs, tables = fixture()
    d, t = spark.createDataFrame(docs, DOC), spark.createDataFrame(tables, TABLE)
    found = T.candidates(t, d)
    row = next(r for r in T.coverage(d, t, found).collect() if r["doc_id"] == 0)
    assert row["ids_truncated"] and row["forms"] == 5 and row["candidate_ids"].count("|") == 0 and row["top_candidates"].count("|") == 1
    cells = spark.createDataFrame([(0, 0, x) for x in ("a", "b", "b", "c", "")], "doc_id bigint, table_id bigint, text string")
    rows = {r["table_id"]: r for r in T.evidence(t, cells, found).collect()}
    assert (rows[0]["hash_count"], rows[0]["hashes_truncated"], rows[0]["cell_hashes"].count("|")) == (3, True, 1)
    assert rows[1]["hash_count"] == 0 and rows[1]["cell_hashes"] == ""


def test_tables_of_cells(spark):
    cells = [(1, "A", "o", "x", 5, r, c, text) for r, c, text in ((2, 0, "p"), (2, 1, ""), (3, 0, "q"))] + [(2, "A", "o", "x", 5, r, c, text) for r, c, text in ((2, 0, "p"), (3, 0, "q"), (2, 1, ""))] + [(3, "A", "o", "x", 1, 1, 0, "")]
    rows = {r["doc_id"]: r for r in T.from_cells(spark.createDataFrame(cells, "doc_id bigint, section string, object_id string, org string, table_id bigint, row int, col int, text string")).collect()}
    assert (rows[1]["rows"], rows[1]["cols"], rows[1]["cells"]) == (2, 2, 3)
    assert rows[1]["layout"] == rows[2]["layout"] and rows[1]["content"] == rows[2]["content"] and rows[3]["content"] is None


def test_combined_report_flags_borrowed_forms(spark):
    docs, tables = fixture()
    d, t = spark.createDataFrame(docs, DOC), spark.createDataFrame(tables, TABLE)
    texts = spark.createDataFrame([(19, "A", "UNKNOWN", 0.5, 0.0, 0.0, "measured")], "doc_id bigint, section string, org string, all_ratio double, foreign_ratio double, copy_review_ratio double, coverage_status string")
    rows = {r["doc_id"]: r for r in combined_report(T.coverage(d, t, T.candidates(t, d)), texts).collect()}
    assert rows[0]["priority"] == "review_high" and rows[0]["text_status"] == "missing" and rows[0]["table_band"] == "medium"
    assert rows[19]["priority"] == "review_clear" and rows[19]["table_status"] == "no_tables" and rows[19]["text_band"] == "medium"


def test_tables_whole_in_a_row_are_those_of_their_cells(spark):
    from pyspark.sql import functions as F

    lines = {
        0: [["a", "", "x"], ["b", "f", None]], 1: [[None, "", None]], 2: [[None, None, None], ["r", "f", "x"]], 3: [[None, None, None]], 4: [["a", "a", "a"]], 5: [["", "", None], ["", None, None]],
    }
    who = "doc_id bigint, section string, object_id string, org string, table_id bigint"
    whole = spark.createDataFrame([(k, "A", f"o{k}", "x", 1, v) for k, v in lines.items()], f"{who}, lines array<array<string>>")
    cells = [(k, "A", f"o{k}", "x", 1, r + 1, c, t) for k, v in lines.items() for r, line in enumerate(v) for c, t in enumerate(line) if t is not None]
    want = T.from_cells(spark.createDataFrame(cells, f"{who}, row int, col int, text string"))
    got = T.from_lines(whole)
    assert got.drop("texts").dtypes == want.dtypes and {r[0] for r in got.collect()} == {0, 1, 2, 4, 5}
    assert sorted(map(tuple, got.drop("texts").collect())) == sorted(map(tuple, want.collect()))
    found = want.select(F.lit("id").alias("candidate_id"), "section", "layout").distinct()
    cells = spark.createDataFrame(cells, f"{who}, row int, col int, text string")
    assert sorted(map(tuple, T.evidence(got, None, found).collect())) == sorted(map(tuple, T.evidence(want, cells, found).collect()))


def test_cells_of_orders_are_no_rows(spark, tmp_path):
    """Every order's tables by the rule; lines of one number, returned and shipped ones apart; the plan explodes no cells."""
    from folioscope.plans import form_queries as Q

    rows = [(k % 40, k // 80, "NRA"[k % 3], "OF"[k % 2], None if k % 13 == 0 else (k % 11) / 100) for k in range(400)] + [(99, 1, "N", "O", 0.1), (7, None, None, "F", 0.08)]
    tables = {
        "lineitem": ("l_orderkey bigint, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double", rows),
        "orders": ("o_orderkey bigint, o_custkey bigint", [(k, k % 9) for k in range(40)]), "customer": ("c_custkey bigint, c_mktsegment string, c_nationkey int", [(k, "ab"[k % 2], k % 3) for k in range(8)]),
    }
    for name, (schema, values) in tables.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    key = lambda x: tuple((v is not None, v) for v in x)
    cells, groups = [], defaultdict(list)
    for o, *line in rows:
        if o < 40 and o % 9 < 8:
            groups[o, int(line[1] == "N")].append(line)
    for (o, t), lines in groups.items():
        c = o % 9
        for r, (_, flag, status, discount) in enumerate(sorted(lines, key=key)):
            texts = [flag and flag.lower(), "" if status == "O" else "f", "discount" if discount is not None and discount > 0.07 else None]
            cells += [(o, "ab"[c % 2], c, f"N{c % 3}", t, r + 1, k, x) for k, x in enumerate(texts) if x is not None]
    want = T.from_cells(spark.createDataFrame(cells, "doc_id bigint, section string, object_id bigint, org string, table_id int, row int, col int, text string"))
    got = Q._tables(spark, str(tmp_path))
    assert sorted(map(tuple, got.drop("texts").collect())) == sorted(map(tuple, want.collect()))
    assert not hasattr(Q, "_cells")
