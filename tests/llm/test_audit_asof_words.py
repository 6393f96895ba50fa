"""Source divergence, the tolerant as-of join and word BPE: against brute force and the tokenizers library."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from folioscope.llm import asof_join, source_divergence, word_bpe

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(rows, least):
    """rows: (lang, source, text); the audit's result by plain integers."""
    rows = [(lang or "", source or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in rows:
        docs[lang].update(set(terms))
        groups[lang, source].update(terms)
    kept = {lang: sorted((t for t, n in c.items() if n >= least), key=str.encode) for lang, c in docs.items()}
    shares, out = {}, set()
    for lang in docs:
        v = len(kept[lang])
        every = Counter()
        for (g, source), c in [x for x in groups.items() if x[0][0] == lang]:
            every.update(c)
            n = sum(c[t] for t in kept[lang])
            shares[g, source] = [1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * v) for t in kept[lang]] if v else []
        n = sum(every[t] for t in kept[lang])
        shares[lang, None] = [1 + 1_000_000_000 * (every[t] + 2) // (n + 2 * v) for t in kept[lang]] if v else []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        p = shares[lang, source]
        pairs = [(sum(map(f, p, shares[lang, other])), other) for g, other in groups if g == lang and other != source]
        terms = [(f(a, b), t) for a, b, t in zip(p, shares[lang, None], kept[lang], strict=True) if groups[lang, source][t] and a > b]
        for part, items, most in (("pair", pairs, None), ("term", terms, source_divergence.TOP_TERMS)):
            ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
            out |= {(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("chunk,rows,block", [(4096, 1_000_000, 64), (3, 5, 2)])
def test_audit_is_the_brute_force_one(spark, monkeypatch, chunk, rows, block):
    for name, value in (("CHUNK_TERMS", chunk), ("CHUNK_ROWS", rows), ("BLOCK_SOURCES", block), ("HELD", 30), ("PIECE", 40)):
        monkeypatch.setattr(source_divergence, name, value)
    rng = random.Random(4)
    words = ["Alpha", "beta", "Ünder", "ünder", "日本", "z", "\U0001f600", "ﬀ", "e9f", "x-y", "q\x00r", "Ä"] + [f"t{'abcdefgh'[k % 8]}{'xyzuvw'[k // 8]}" for k in range(40)]
    data = [(rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "hot", "s1", "s2", "Ω", "", None]), " ".join(rng.choice(words[: rng.choice([4, 20, 52])]) for _ in range(rng.choice([0, 1, 6, 40])))) for _ in range(160)]
    data += [("en", "silent", None), ("en", "silent", ""), ("xx", "a", "rare words only"), ("xx", "b", None), ("yy", "alone", "one " * 30), ("en", "long", "Alpha beta " * 4000)] + [("en", "twice", "beta beta z")] * 3
    docs = spark.createDataFrame([(None, *r, "clash") for r in data], "doc_id bigint, lang string, source string, text string, term string").repartition(5)
    got = source_divergence.audit(docs, min_docs=5).collect()
    assert {tuple(r) for r in got} == brute_audit(data, 5) and len(got) == len({tuple(r) for r in got})
    assert source_divergence.audit(docs.where("false")).count() == 0


def test_shares_are_exact_for_large_counts():
    import numpy as np

    counts = [0, 1, 9_300_000_000, 7 * 10**15]
    n, v = 8 * 10**15, 10**9
    assert source_divergence.share(np.array(counts), n, v).tolist() == [1 + 1_000_000_000 * (c + 2) // (n + 2 * v) for c in counts]


def brute_asof(clicks, sales):
    crc = lambda i: zlib.crc32(str(i).encode())
    us = lambda t: None if t is None else (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    coarse = lambda i, t: t // asof_join.COARSE_US * asof_join.COARSE_US if t is not None and crc(i) % 2 else t
    orders = defaultdict(list)
    for sale, client, total, at in sales:
        cents = None if total is None or total != total else int((100 * total + 0.5) // 1)
        for i in (sale, -1 - sale) if crc(sale) % 3 else (sale,):
            orders[client].append((coarse(sale, us(at)), -1 if cents is None else cents, i, cents))
    out = set()
    for click, client, at in {x[0]: x for x in clicks}.values():
        t = coarse(click, us(at))
        near = [o for o in orders[client] if client is not None and t is not None and o[0] is not None and o[0] <= t]
        best = max(near, default=None)
        if best is None or t - best[0] > asof_join.TOLERANCE_US:
            out.add((click, client, t, None, None, None, 0))
        else:
            out.add((click, client, t, best[2], t - best[0], best[3], sum(o[0] == best[0] for o in near)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_asof_is_the_brute_force_one(spark, seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    when = lambda: None if rng.random() < 0.03 else start + timedelta(seconds=rng.choice([0, 3600 * 6, rng.randrange(120 * 86_400)]), microseconds=rng.choice([0, rng.randrange(10**6)]))
    # one client has a third of all rows; some have clicks only, some orders only
    client = lambda: rng.choice([None, 7, 7, 7, *range(10, 17)])
    clicks = [(k, client(), when()) for k in range(600)]
    clicks += [clicks[k] for k in range(0, 90, 3)] + [(1000 + k, 99, when()) for k in range(40)]
    sales = [(k, client() if k % 9 else rng.choice([7, 98]), rng.choice([None, 1.5, 1.5, 2.345, -0.5, float("nan"), round(rng.random() * 90, 2)]), when()) for k in range(300)] + [(5, 7, 9.0, start)] * 2
    c = spark.createDataFrame([(*x, "x", 0) for x in clicks], "click_id bigint, client_id bigint, ts timestamp_ntz, key string, at int").repartition(4)
    s = spark.createDataFrame([(*x, "x", 0) for x in sales], "sale_id bigint, client_id bigint, total double, sold_at timestamp_ntz, value string, n int").repartition(3)
    got = asof_join.match_orders(c, s).collect()
    want = brute_asof(clicks, sales)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(r["n_tied"] > 1 for r in got) > 5 and sum(r["sale_id"] is None for r in got) > 5
    if not seed:
        assert asof_join.match_orders(c.where("false"), s).count() == 0
        assert asof_join.match_orders(c, s.where("false")).where("n_tied = 0 and sale_id is null").count() == len(want)
        zoned = asof_join.match_orders(c.withColumn("ts", c["ts"].cast("timestamp")), s.withColumn("sold_at", s["sold_at"].cast("timestamp")))
        assert {tuple(r) for r in zoned.collect()} == want


def test_asof_carries_over_buckets_without_orders(spark):
    """One order long before thousands of clicks of its client: every bucket but the first waits for what is carried."""
    left = spark.range(20_000).selectExpr("id", "cast(id % 2 as bigint) key", "1000 + id div 10 at")
    right = spark.createDataFrame([(0, 1000, 5, 1), (0, 2400, 6, 2)], "key bigint, at bigint, value bigint, tie bigint")
    got = asof_join.latest_before(left, right, 900).groupBy("key", "found_at", "n").count().collect()
    found = Counter()
    for i in range(20_000):
        at = 1000 + i // 10
        f = None if i % 2 else max((t for t in (1000, 2400) if at - 900 <= t <= at), default=None)
        found[i % 2, f, int(f is not None)] += 1
    assert {(r["key"], r["found_at"], r["n"]): r["count"] for r in got} == found


@pytest.fixture(scope="module")
def word_file():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids), tokenizer.decode(ids, skip_special_tokens=False)


def test_word_bpe_is_the_library_s(spark, odd_docs, no_docs, word_file):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_file)
    got = Counter(tuple(r) for r in word_bpe.encode(odd_docs, word_file).collect())
    assert got == Counter((r["doc_id"], *expected(tokenizer, r["text"])) for r in odd_docs.collect())
    sums = {tuple(r) for r in word_bpe.digests(word_bpe.encode(odd_docs.where("doc_id in (6, 8)"), word_file)).collect()}
    ids, text = expected(tokenizer, "One two")
    nothing = hashlib.sha256(b"").hexdigest()
    assert sums == {(6, 0, nothing, nothing), (8, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())}
    assert word_bpe.encode(no_docs, word_file).count() == 0


def test_word_bpe_on_odd_characters(word_file, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer, codec = Tokenizer.from_file(word_file), word_bpe.WordCodec(open(word_file, encoding="utf-8").read())
    monkeypatch.setattr(word_bpe, "REMEMBERED", 50)
    rng = random.Random(1)
    pieces = ["a", "B", "don", "'s", "'LL", "Σ", "é", "é", "́", "İ", "日", "  ", "\x1c", "\x85", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "12", "²", "!", "<|", "\x00", "ǅ", "ﬁ", "\U0001f600", "͸", "가", "가", "‍", "×", "ß", "ŉ", "\n\n", "tion" * 30]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        ids, shown = codec.run(text)
        assert (ids, shown.decode()) == expected(tokenizer, text), text


def test_scan_and_heap_merge_alike(word_file):
    codec, rng = word_bpe.WordCodec(open(word_file, encoding="utf-8").read()), random.Random(2)
    for _ in range(2000):
        word = "".join(rng.choice("aaabeinorst") for _ in range(rng.randrange(1, 60)))
        runs = []
        for merge in (codec._merges.scan, codec._merges.heap):
            parts, bounds = [codec._inside[c] for c in word[:-1]] + [codec._last[word[-1]]], [*range(len(word) + 1)]
            merge(parts, bounds)
            runs.append((parts, bounds))
        assert runs[0] == runs[1]
        assert "".join(codec._shown[k].decode() for k in runs[0][0]) == word + "</w>" and runs[0][1][0] == 0 and runs[0][1][-1] == len(word)


def test_another_tokenizer_is_refused(word_file):
    with pytest.raises(ValueError):
        word_bpe.WordCodec(open(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"), encoding="utf-8").read())
