"""The pipeline's stages over a small corpus with planted cases, and against a brute-force version of all five."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from folioscope.llm import bpe, perplexity
from tests.llm.conftest import prose
from tests.llm.test_exact import SPACE, brute_components, brute_contamination, vocabulary
from tests.llm.test_learned import brute_keys, brute_model, brute_rules

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def staged(spark, docs, folder):
    """Each stage's rows by name, written and read again."""
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(folder))
        out.write.parquet(f"{folder}/out/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/out/{name}")
        seen[name] = docs
    return seen


def test_stages(spark, tmp_path):
    phrase = prose(77, 40, 300)
    rows = [(k, prose(100 + k, 90, 300), "en", f"s{k % 9}", 0) for k in range(40)]
    rows += [(50, rows[0][1], "en", "s1", 0), (51, rows[1][1].replace("w", "W", 1), "en", "s2", 0)]  # copies of 0 and 1
    rows += [(60, "too short", "en", "s0", 0), (61, None, "en", "s0", 0), (62, "again and again " * 40, "en", "s0", 0)]
    rows += [(70, prose(7, 60, 300) + "\n" + phrase, "en", "s3", 0)]
    rows = [(i, t and t + "\nSubscribe to our letter", *r) for i, t, *r in rows]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, phrase)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = staged(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), tmp_path)
    ids = {name: {r["doc_id"] for r in d.select("doc_id").collect()} for name, d in seen.items()}
    assert ids["quality_rules"] == set(range(40)) | {50, 51, 70}
    assert ids["line_dedup"] == ids["quality_rules"]
    assert seen["line_dedup"].where("text like '%Subscribe%' or n_chars <> length(text)").count() == 0
    assert ids["jaccard_join"] == ids["line_dedup"] - {50, 51}
    assert ids["decontamination"] == ids["jaccard_join"] - {70}
    assert ids["byte_bpe"] == ids["decontamination"] and seen["byte_bpe"].columns[0] == "doc_id"
    assert all(seen[n].columns == ["doc_id", "text", "lang", "source", "n_chars"] for n in list(seen)[:4])


def middle(values):
    return sorted(values)[math.ceil(len(values) / 2) - 1]


def brute_quality(rows, halves):
    """The rows that the fixed rules and the bands keep."""
    texts = [(r[2] or "", halves[r[0]], r[1]) for r in rows]
    models = {m: brute_model([t for g, h, t in texts if (g, 1 - h) == m]) for m in {(g, h) for g, h, _ in texts}}
    scores, passed = {}, defaultdict(dict)
    for r, (lang, half, text) in zip(rows, texts, strict=True):
        words, _, _, _, repeated = brute_rules(text)
        if words >= 50 and 2 * repeated <= words:
            keys = brute_keys(text)
            scores[r[0]] = -sum(math.log(models[lang, half](g)) for g in keys) / len(keys)
            passed[lang].setdefault(text, []).append(scores[r[0]])
    bands = {}
    for lang, by_text in passed.items():
        means = [sum(x) / len(x) for x in by_text.values()]
        m = middle(means)
        spread = 1.4826 * middle([abs(x - m) for x in means])
        wide = len(means) >= perplexity.MEASURED and spread > 0
        bands[lang] = (m - (perplexity.LOWER * spread if wide else perplexity.LEAST_LOWER), m + (perplexity.UPPER * spread if wide else perplexity.LEAST_UPPER))
    return [r for r in rows if r[0] in scores and bands[r[2] or ""][0] <= scores[r[0]] <= bands[r[2] or ""][1]]


def brute_lines(rows, sites=8):
    stands = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if r[3] is not None:
                stands[line.strip(" ")].add(r[3])
    kept = lambda t: "\n".join(x for x in t.split("\n") if not x.strip(" ") or len(stands[x.strip(" ")]) < sites)
    return [(i, t if t is None else kept(t), *rest) for i, t, *rest in rows]


def test_pipeline_is_the_brute_force_one(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = vocabulary()
    rng = np.random.default_rng(12)
    phrase = prose(77, 30, 300)
    rows = []
    for k in range(90):
        text = prose(300 + k, int(rng.integers(45, 110)), 300)
        if k % 9 == 1:
            text = "".join(rng.permutation(list(text)))  # noise
        if k % 11 == 2:
            text = text + "\n" + " ".join(phrase.split()[k % 10 : k % 10 + 18])
        if k % 4 == 0:
            text = f"Home page\n{text}\nAll about us"
        rows.append((k, text, "en" if k % 3 else "xx", f"s{k // 4 % 10}", 0))
        if k % 8 == 3:
            words = text.split(" ")
            words[len(words) // 2] = "changed"
            rows.append((500 + k, " ".join(words), rows[-1][2], "s1", 0))
    rows += [(900, None, "en", "s0", 0), (901, "", None, None, 0), (902, prose(4, 60, 100), None, None, 0)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, phrase), (2, "never said")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    halves = {r["doc_id"]: r["half"] for r in perplexity._slim(docs, "doc_id", "text", "lang").collect()}

    kept = brute_quality(rows, halves)
    assert 0.5 * len(rows) < len(kept) < len([r for r in rows if len(SPACE.findall(r[1] or "")) >= 50])
    lined = brute_lines(kept)
    comps = brute_components([{"doc_id": r[0], "text": r[1]} for r in lined])
    firsts = {c for _, _, c in comps}
    single = [r for r in lined if r[0] in firsts]
    assert len(single) < len(lined)
    clean = [r for r in single if not brute_contamination(r[1], items)[-1]]
    assert len(clean) < len(single)
    codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(bpe.read_ranks(path))}, special_tokens={})
    want = Counter()
    for i, text, *_ in clean:
        ids = codec.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want


def test_stages_over_odd_tables(spark, tmp_path, odd_docs, no_docs):
    """Null ids and texts, repeated rows, clashing and further columns, empty tables."""
    phrase = " ".join(odd_docs.where("doc_id = 4").first()["text"].split()[20:60])
    spark.createDataFrame([(1, phrase), (None, "x"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["row", "key", "_lines", "_removed", "_key", "doc", "gone", "kept", "id", "sk", "nameless", "half", "logp"]
    wide = odd_docs
    for name in names:
        if name not in wide.columns:
            from pyspark.sql import functions as F

            wide = wide.withColumn(name, F.lit("x"))
    long = (77, prose(9, 20_000, 400), "en", "s9", 0)
    more = spark.createDataFrame([long, *[(100 + k, prose(500 + k, 80, 300), "en", f"s{k % 3}", 0) for k in range(40)]], COLUMNS)
    wide = wide.unionByName(more, allowMissingColumns=True)
    rows = {name: d.collect() for name, d in staged(spark, wide, tmp_path).items()}
    assert all(list(rows[n][0].asDict()) == wide.columns for n in list(rows)[:4])
    after = [r["doc_id"] for r in rows["quality_rules"]]
    assert 5 not in after and 6 not in after and after.count(12) in (0, 2) and {100, 120} <= set(after)
    assert [r["doc_id"] for r in rows["line_dedup"]].count(None) == after.count(None)
    assert [r["doc_id"] for r in rows["jaccard_join"]].count(12) <= 1
    assert 4 not in {r["doc_id"] for r in rows["decontamination"]}
    assert len(rows["byte_bpe"]) == len(rows["decontamination"])
    empty = tmp_path / "empty"
    spark.createDataFrame([(1, "x")], "item_id bigint, text string").where("false").write.parquet(f"{empty}/benchmark.parquet")
    assert all(d.count() == 0 for d in staged(spark, no_docs, empty).values())
    # without benchmark items nothing is contaminated
    assert corpus_pipeline.decontamination(spark, more, str(empty)).count() == more.count()
