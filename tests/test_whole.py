"""Queries over whole tables, against brute force on small fixtures."""

import datetime
import hashlib
import itertools
import math
import time
from collections import Counter

import pytest

from folioscope.plans import registry


@pytest.fixture
def tables(spark, tmp_path):
    """Write rows as the driver's tables of a folder."""

    def write(**rows):
        for name, (schema, values) in rows.items():
            spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_quarter_activity_has_every_customer(spark, tables):
    rows = [(k, k % 23, datetime.datetime(2020 + k % 2, 1 + k % 12, 1)) for k in range(200)]
    d = tables(orders=("o_orderkey bigint, o_custkey bigint, o_orderdate timestamp", rows))
    want = Counter((c, f"{t.year}-Q{(t.month + 2) // 3}") for _, c, t in rows)
    assert {(r[0], r[1]): r[2] for r in registry.QUERIES["quarter_activity"](spark, d).collect()} == want


def test_z_distance_has_every_pair(spark, tables):
    rows = [(k, f"b{k % 2}", f"t{k % 3}", k * 7 % 11, k * 13 % 17 + 0.5) for k in range(1, 40)]
    d = tables(part=("p_partkey bigint, p_brand string, p_type string, p_size int, p_retailprice double", rows))
    spread = lambda xs: math.sqrt(sum((x - sum(xs) / len(xs)) ** 2 for x in xs) / len(xs))
    sd = [spread([r[i] for r in rows]) for i in (3, 4)]
    want = {(a[0], b[0]): math.sqrt(sum(((a[i] - b[i]) / s) ** 2 for i, s in zip((3, 4), sd, strict=True)) / 2) for a, b in itertools.combinations(rows, 2) if a[1:3] == b[1:3]}
    got = {(r[0], r[1]): r[2] for r in registry.QUERIES["z_distance"](spark, d).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=6e-5) for k in want)


def test_z_distance_is_dealt_out_whatever_the_size_of_its_table(spark, tables):
    d = tables(part=("p_partkey bigint, p_brand string, p_type string, p_size int, p_retailprice double", [(k, "b", "t", k % 5, 1.0) for k in range(1200)]))
    out = registry.QUERIES["z_distance"](spark, d)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and out.count() == 1200 * 1199 // 2


def test_signatures_cover_every_line(spark, tables):
    rows = [(1, "en", "s", "a b\nc\nd\nE  f"), (2, "en", "s", "a b\nc\nd\ng"), (3, "en", "s", "a")]
    d = tables(documents=("doc_id bigint, lang string, source string, text string", rows))
    cells = lambda text: "\n".join(f"{i}:{j}:{w.lower()}" for i, line in enumerate(text.split("\n")) for j, w in enumerate(line.split(" ")))
    got = dict(tuple(r) for r in registry.QUERIES["content_signatures"](spark, d).collect())
    assert got == {k: hashlib.sha1(cells(text).encode()).hexdigest() for k, _, _, text in rows}


def test_remarks_are_whole_turns(spark, tables):
    rows = [(1, 1, "user", "hello\nуказать штамп"), (2, 1, "user", "hello\nother words"), (3, 1, "assistant", "hello\n other  words"), (4, 1, "user", "hello")]
    d = tables(conversations=("conv_id bigint, turn bigint, role string, text string", rows))
    whole = {k: " ".join(text.split()) for k, _, _, text in rows}
    got = {r["conv_id"]: r for r in registry.QUERIES["remark_categories"](spark, d).collect()}
    assert {k: (r["remark_hash"], r["char_count"], r["word_count"]) for k, r in got.items()} == {k: (hashlib.sha1(t.encode()).hexdigest(), len(t), len(t.split())) for k, t in whole.items()}
    assert got[1]["primary_category"] == "formatting" and got[2]["primary_category"] == "other"
    again = [tuple(r) for r in registry.QUERIES["remark_recurrence"](spark, d).collect()]
    assert again == [(hashlib.sha1(b"hello other words").hexdigest(), 2, "assistant|user")]


def test_page_ranges_of_every_line(spark, tables):
    rows = [(k, n) for k in range(3) for n in range(1, 8)]
    d = tables(lineitem=("l_orderkey bigint, l_linenumber int", rows))
    got = {(r[0], r[1]): r[2] for r in registry.QUERIES["page_ranges"](spark, d).collect()}
    assert got == {(k, n): ",".join(map(str, sorted({1, *range(n, n + 4)}))) for k, n in rows}


def test_z_distance_sends_a_part_to_few_blocks(spark, tables):
    """1,200 parts of a group went out with four shuffles of a row: one left, three right."""
    d = tables(part=("p_partkey bigint, p_brand string, p_type string, p_size int, p_retailprice double", [(k, "b", "t", k % 5, 1.0) for k in range(1200)]))
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    written = lambda: {(x := rows.apply(k)).stageId(): x.shuffleWriteRecords() for rows in [stages()] for k in range(rows.size())}
    before = set(written())
    assert registry.QUERIES["z_distance"](spark, d).where("distance >= 0").count() == 1200 * 1199 // 2
    time.sleep(1)
    assert 2400 <= sum(n for k, n in written().items() if k not in before) < 3000
