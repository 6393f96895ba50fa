"""Steps whose cost has to follow the input: what is counted, sent and held, and that results stay the same."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import entities as E
from folioscope.operators import frequency as Q
from folioscope.plans import inputs as I

DOCS = "doc_id bigint, lang string, source string, text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def line(k):
    return " ".join(WORDS[(k * j + j) % len(WORDS)] for j in range(1, 9))


@pytest.fixture
def corpus(spark, tmp_path):
    rows = [(k, "en" if k % 3 else "fr", f"src{k % 4}", f"{line(k % 5)}\n\n{line(k)}\na | {k % 6} | c\nx{k}\n") for k in range(120)]
    rows += [(200, "en", "src0", None), (201, "en", "src1", ""), (202, None, "src1", line(1)), (203, "fr", None, line(2))]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_texts_are_dealt_by_their_size_not_by_the_number_of_shuffle_partitions(spark, corpus):
    read = I.table_docs(spark, corpus).rdd.getNumPartitions()
    assert I.whole_docs(spark, corpus).rdd.getNumPartitions() >= 16 * read > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_frequency_of_wanted_entities_counts_no_others(spark, corpus):
    rows, found = I.canonical_counted(spark, corpus, I.short_hash)
    key = ["section", "entity_kind", "entity_hash"]
    every = Q.document_frequency(I.entities(spark, corpus, I.short_hash), I.with_entities(spark, corpus))
    want = {tuple(r) for r in every.join(rows.select(*key).distinct(), key, "left_semi").select(*found.columns).collect()}
    assert want <= {tuple(r) for r in found.collect()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    semi = next(k for k, x in enumerate(plan.split("\n")) if "Join LeftSemi" in x)
    assert "code" in plan.split("\n")[semi] and sum("Aggregate" in x for x in plan.split("\n")[:semi]) >= 2  # left out before anything is counted


@pytest.mark.parametrize("text", ["a  b", " a\tb ", "\ta", "a   b", " ", " ", "", "a\x1cb  \x1f c", "Ё  ё", "one two", "　x　 y"])
def test_runs_of_space_become_one(spark, text):
    want = " ".join(text.lower().replace("ё", "е").split())
    got = spark.createDataFrame([(text,)], "t string").select(T.normalize_text(F.col("t")), T.is_blank(F.col("t"))).first()
    assert tuple(got) == (want, want == "")


def test_text_entities_are_segments_and_their_shingles(spark):
    text = "One two  three four five six\n\na b c\none two three four five six\nlongword x longer third fourth fifth"
    segs = E.segments(spark.createDataFrame([(1, "en", "o", text)], "doc_id bigint, section string, object_id string, text string"))
    got = Counter()
    for r in E.text_entities(segs, lambda c: c).collect():
        got[r["entity_kind"], r["entity_hash"]] += r["n"]
    want = Counter()
    for x in text.split("\n"):
        n = " ".join(x.lower().split())
        w = [t for t in n.split() if len(t) > 1]
        want.update([("text_segment", n)] if n else [])
        want.update(("text_word_shingle", " ".join(w[i : i + 5])) for i in range(len(w) - 4))
    assert got == want


def coverage_both_ways(spark, d):
    from folioscope.operators import library as L
    from folioscope.plans import stats_queries as S

    rows, found = S._text_library(spark, d)
    docs = I.table_docs(spark, d)
    plain = L.coverage(docs, rows, found, S.TEXT_KINDS)
    lean = L.text_coverage(docs, I.whole_docs(spark, d), S.TEXT_KINDS)
    assert plain.dtypes == lean.dtypes
    return [sorted(map(tuple, x.collect()), key=repr) for x in (plain, lean)]


def test_coverage_by_numbers_is_coverage(spark, corpus):
    plain, lean = coverage_both_ways(spark, corpus)
    assert plain == lean and sum(r[lean_at(spark, "candidates")] for r in lean) > 100


def lean_at(spark, name):
    from folioscope.operators import library as L
    from folioscope.plans import stats_queries as S

    empty = spark.createDataFrame([], "doc_id bigint, section string, object_id string, org string, text string")
    return L.text_coverage(empty, empty, S.TEXT_KINDS).columns.index(name)


def test_coverage_of_odd_documents(spark, tmp_path):
    """Ids twice, with another source or language; no source, no language, no text; sources that are no organisation."""
    rows = [(k % 25, ("en", "fr", None)[k % 3 if k % 5 else 2], (None, "", "UNKNOWN", "src1", "src2")[k % 5], None if k % 11 == 0 else f"{line(k % 3)}\n{line(k % 4)}\nhi\nab {k % 2}") for k in range(60)]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plain, lean = coverage_both_ways(spark, str(tmp_path))
    assert plain == lean


def test_what_does_not_recur_goes_no_further(spark):
    from folioscope.operators import library as L

    rows = [(1, 10, 1, 0), (1, 11, 2, 0), (1, 11, 2, 0), (2, 10, 1, 0), (2, 11, 2, 0), (3, 10, 1, 1), (3, 10, 4, 1), (3, 10, 5, 1), (4, 10, 1, 2)]
    got = L.recurring(spark.createDataFrame(rows, "code bigint, who bigint, doc_id bigint, kind tinyint"), 3, 4).collect()
    assert {tuple(r) for r in got} == {(1, 10, 1, 0, 1), (1, 11, 2, 0, 2)}


def test_coverage_queries_store_no_row_of_every_entity(spark, corpus, monkeypatch):
    from folioscope.operators import library as L
    from folioscope.plans import stats_queries as S

    sizes = {}
    put = L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: sizes.setdefault(name, put(df, name)))
    monkeypatch.setattr(S, "stored", lambda df, name: sizes.setdefault(name, put(df, name)))
    S.coverage_report(spark, corpus).count()
    every = E.measured_entities(E.segments(I.whole_docs(spark, corpus)), T.binary_hash).count()
    assert all(df.count() < every for df in sizes.values())


def test_text_candidates_come_from_what_recurs_alone(spark, corpus, monkeypatch):
    """The same candidates and evidence as from all entities, of which none is stored that only one object has."""
    from folioscope.operators import library as L
    from folioscope.plans import stats_queries as S

    rows, found = S._text_library(spark, corpus)
    sizes = {}
    put = L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: sizes.setdefault(name, put(df, name)))
    lean_rows, lean = S._recurring_library(spark, corpus)
    assert found.dtypes == lean.dtypes and found.count() > 20
    every = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert every(found) == every(lean) and every(L.evidence(rows, found, 6)) == every(L.evidence(lean_rows, lean, 6))
    alone = rows.groupBy("entity_kind", "entity_hash").agg(F.countDistinct("section", "object_id").alias("k")).where("k = 1")
    assert alone.count() > 50 and sizes["recurring-entities"].join(alone, "entity_hash", "left_semi").count() == 0
    assert sizes["recurring-entities"].count() < rows.count()
