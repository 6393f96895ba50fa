"""Order statistics over ranges, the review queue and difficulty of reviews, against plain versions."""

import random
from collections import defaultdict
from statistics import mean, median

import pytest

from folioscope.operators import difficulty as D
from folioscope.operators import ordered as O
from folioscope.operators import review as V


@pytest.fixture(scope="module", params=[0, 1])
def values(request):
    """Groups of which one holds most rows, of few and of many different values, with nulls."""
    rng = random.Random(request.param)
    rows = [("hot", rng.choice([0.0, 1.0, rng.randrange(40) / 4])) for _ in range(900)] + [(g, rng.random()) for g in "abc" for _ in range(60)]
    return rows + [("one", 3.0), ("same", 2.0), ("same", 2.0), ("none", None), ("hot", None)]


def test_places(spark, values):
    groups = defaultdict(list)
    for g, v in values:
        if v is not None:
            groups[g].append(v)
    frame = spark.createDataFrame(values, "g string, v double").repartition(5)
    got = O.with_places(frame, ["g"], "v", rank=O.AVERAGE_RANK, p=O.MIDRANK, upto=O.UP_TO).collect()
    assert len(got) == len(values)
    for r in got:
        if r["v"] is None:
            assert r["rank"] is None and r["p"] is None and r["upto"] is None
            continue
        own = groups[r["g"]]
        below, same = sum(x < r["v"] for x in own), own.count(r["v"])
        rank = below + (same + 1) / 2
        assert r["rank"] == rank and r["upto"] == pytest.approx((below + same) / len(own)) and r["p"] == pytest.approx((rank - 1) / (len(own) - 1) if len(own) > 1 else 0.5)


def test_quantiles(spark, values):
    import numpy as np

    groups = defaultdict(list)
    for g, v in values:
        if v is not None:
            groups[g].append(v)
    wanted = {"low": 0.1, "middle": 0.5, "high": 0.9, "all": 1.0}
    got = {r["g"]: r for r in O.quantiles(spark.createDataFrame(values, "g string, v double"), ["g"], "v", wanted).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        for name, q in wanted.items():
            assert got[g][name] == pytest.approx(float(np.quantile(own, q)))


def test_false_discovery(spark, values):
    rows = [(g, k, None if v is None else min(1.0, v / 10)) for k, (g, v) in enumerate(values)]
    got = {r["k"]: r for r in O.false_discovery(spark.createDataFrame(rows, "g string, k int, p double"), ["g"], "p").collect()}
    for name in {g for g, _, p in rows}:
        own = sorted((p, k) for g, k, p in rows if g == name and p is not None)
        least = 1.0
        for place in range(len(own), 0, -1):
            p, k = own[place - 1]
            least = min(least, p * len(own) / place)
            assert got[k]["q"] == pytest.approx(least, abs=1e-6) and got[k]["significant"] == (round(least, 6) <= 0.1)
    assert all(r["q"] is None for r in got.values() if r["p"] is None)


def test_numbers_run_over_all_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), rng.choice([0.5, rng.random()]), k) for k in range(500)]
    frame = spark.createDataFrame(rows, "s string, v double, k int").repartition(7)
    got = {r["k"]: r["place"] for r in O.numbered(frame, [frame["s"].desc(), frame["v"].asc(), frame["k"].asc()]).collect()}
    want = sorted(rows, key=lambda r: (-ord(r[0]), r[1], r[2]))
    assert got == {k: i + 1 for i, (_, _, k) in enumerate(want)}
    assert O.numbered(frame.where("false"), [frame["k"].asc()]).count() == 0


def test_queue_keeps_labels(spark):
    rows = [("d", "rare_text_partial_overlap", 0.9, 0.99), ("c", "rare_text_high_overlap", 0.5, 0.9), ("b", "rare_text_high_overlap", 0.5, 0.95), ("a", "table_content_overlap", 0.9, 0.99), ("e", "rare_text_high_overlap", 0.8, 0.86)]
    candidates = spark.createDataFrame(rows, "candidate_id string, strength string, jaccard double, score double")
    labels = spark.createDataFrame([("b", "accept", "x"), ("gone", "reject", "x"), ("c", "", "x")], "candidate_id string, review_label string, note string")
    got = sorted(V.queue(candidates, labels).collect(), key=lambda r: r["review_rank"])
    assert [(r["review_rank"], r["candidate_id"], r["review_status"], r["review_label"]) for r in got] == [(1, "e", "pending", ""), (2, "b", "reviewed", "accept"), (3, "c", "pending", ""), (4, "a", "pending", ""), (5, "d", "pending", "")]


def test_difficulty_of_reviews(spark):
    rng = random.Random(6)
    doc = "object_id string, organization string, work_type string, section string, position bigint, pages double, lines double"
    docs = [(f"o{rng.randrange(12)}", "org", "w", rng.choice("AB"), k, float(rng.randrange(5)), float(rng.randrange(50))) for k in range(40)]
    placed = D.percentiles(spark.createDataFrame(docs, doc), ["pages", "lines"])
    share = {}
    for k, d in enumerate(docs):
        parts = []
        for axis in (5, 6):
            own = [x[axis] for x in docs if x[3] == d[3]]
            parts.append(round((sum(v < d[axis] for v in own) + (own.count(d[axis]) - 1) / 2) / (len(own) - 1), 4))
        share[k] = round(mean(parts) + 1e-9, 4)
    assert {r["position"]: r["difficulty"] for r in placed.collect()} == pytest.approx(share, abs=1.01e-4)
    rows = [(rng.choice(["e1", "e2"]), "org", "w", rng.choice(["d1", "d2", "d3"]), f"o{rng.randrange(15)}", rng.choice("AB"), rng.choice(["floor_3", "unlabeled", ""]), rng.random() < 0.4, rng.random() < 0.5) for _ in range(80)]
    reviews = D.merge_reviews(spark.createDataFrame(rows, "expert string, organization string, work_type string, session_date string, object_id string, section string, role string, remark boolean, clean boolean"))
    merged = defaultdict(list)
    for r in rows:
        merged[r[:6]].append(r)
    joined = D.join_reviews(reviews, placed, ["difficulty", "band", "pages"])
    last = {d[:4]: k for k, d in enumerate(docs)}
    got = {(r["expert"], r["organization"], r["work_type"], r["session_date"], r["object_id"], r["section"]): r for r in joined.collect()}
    assert set(got) == set(merged)
    for key, r in got.items():
        k = last.get((key[4], key[1], key[2], key[5]))
        assert r["match_status"] == ("unmatched_document" if k is None else "matched") and (r["difficulty"] is None) == (k is None)
        assert k is None or r["pages"] == docs[k][5]
        assert r["role"] == "|".join(sorted({x[6] for x in merged[key]} - {""})) and r["clean"] == any(x[8] for x in merged[key])
    assert {r["match_status"] for r in got.values()} == {"matched", "unmatched_document"}
    groups = defaultdict(list)
    for key, r in got.items():
        if r["match_status"] == "matched":
            groups[key[:4]].append(r)
    made = {(r["expert"], r["organization"], r["work_type"], r["session_date"]): r for r in D.sessions(joined, ["pages"]).collect()}
    assert set(made) == set(groups)
    for key, own in groups.items():
        s = made[key]
        assert s["documents"] == len(own) and s["pages_total"] == sum(r["pages"] for r in own) and s["clean"] == sum(r["clean"] for r in own)
        assert s["difficulty_mean"] == pytest.approx(mean(r["difficulty"] for r in own), abs=1e-4) and s["difficulty_median"] == pytest.approx(median(r["difficulty"] for r in own), abs=1e-4)
    roles = {r["role"]: r for r in D.roles(D.sessions(joined, ["pages"])).collect()}
    assert all(r["sessions"] == r["low_sessions"] + r["medium_sessions"] + r["high_sessions"] for r in roles.values()) and "unlabeled" not in roles
