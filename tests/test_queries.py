"""Every query against its SQL over the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from folioscope.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    def shown(v) -> str:
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list | tuple):
            return str([shown(x) for x in v])
        if v is None or v is pd.NaT or v != v:
            return "null"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else f"{v:.5f}"
        return str(v)

    frame = frame.reindex(sorted(frame.columns), axis=1).astype(object)
    return sorted("|".join("null" if v is pd.NA else shown(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_is_registered():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    import __spark_entry__

    assert "idf_similarity" in __spark_entry__.entry(spark).columns


@pytest.mark.parametrize("missing", ["public_tokenizers", "xxhash", "sentencepiece", "folioscope.llm", "corpus_pipeline"])
def test_entry_stands_without(missing):
    """Whatever the training-data operators need is missing, the library's own queries are registered."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=120)
    assert ran.returncode == 0, ran.stderr[-2000:]
    queries, oracles = map(int, ran.stdout.split())
    assert queries >= len(registry.QUERIES) and oracles >= len(registry.ORACLES)


def test_entities_of_a_document_are_not_shuffled_again(spark, tmp_path):
    """One shuffle for the texts and one for the frequency, by kind and hash; before, one for each kind's counts and three more."""
    import re

    from folioscope.plans import inputs as I

    spark.createDataFrame([(k, "en", "s", f"a b c d e f{k}\nx|y") for k in range(9)], "doc_id bigint, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = I.frequency(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    keys = set(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan))
    wide = [k for k in keys if "entity_hash" in k]
    assert len(wide) == 1 and "doc_id" not in wide[0] and "section" not in wide[0]
