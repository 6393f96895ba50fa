"""Operators whose results follow from a rule: against brute force over odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import bpe, graph, group_matrix, license_scan, line_spread, positional_index, training_order

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def brute_contamination(text, items, window=13):
    words = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for item, phrase in items:
        p = ALNUM.findall(lower(phrase))
        n = min(window, len(p))
        for j in range(len(p) - n + 1 if p else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == p[j : j + n]:
                    hit.update(range(at, at + n))
                    found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words)


def test_contamination(spark, odd_docs, no_docs, monkeypatch):
    short = [r for r in odd_docs.collect() if len(r["text"] or "") < 5000]
    words = ALNUM.findall(lower(next(r["text"] for r in short if r["doc_id"] == 4)))
    items = [(1, " ".join(words[30:50]).upper()), (2, "one two"), (10, "a a a"), (3, ""), (4, None), (None, "one"), (5, "never said before"), (2, "one two"), (7, " ".join(words[:12]) + " nope " + words[12])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame(short, odd_docs.schema)
    want = Counter((r["doc_id"], *brute_contamination(r["text"], [x for x in items if x[0] is not None])) for r in short)
    got = lambda: Counter(tuple(r) for r in positional_index.contamination(docs, bench).collect())
    assert got() == want
    monkeypatch.setattr(positional_index, "SEGMENT_WORDS", 50)
    monkeypatch.setattr(positional_index, "PASS_BYTES", 40)
    assert got() == want
    assert positional_index.contamination(no_docs, bench).count() == 0
    assert positional_index.contamination(docs, bench.where("false")).where("n_hit > 0 or contaminated").count() == 0
    near = positional_index.proximity_matches(positional_index.build(docs), ["one", "two"], 1).collect()
    assert sorted(r["doc_id"] for r in near) == [8, 9]


def test_proximity_is_the_brute_force_one(spark):
    """Places of a segment's rarest word with every other word within the slop, in one document, over several segments."""
    import random

    rng = random.Random(8)
    texts = {k: " ".join(rng.choice("abcdefgh") + rng.choice(["", ",", "."]) for _ in range(rng.choice([0, 3, 20, 60]))) for k in range(30)} | {40: None, 41: "A b"}
    index = positional_index.build(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5))
    segments = [r["ids"] for r in index.where("term is null").collect()]
    assert len(segments) > 3 and sorted(i for ids in segments for i in ids) == sorted(texts)
    words = {k: ALNUM.findall(lower(t)) for k, t in texts.items()}
    for wanted, slop in ((["a", "b"], 1), (["a", "b", "c"], 4), (["h"], 0), (["a", "zz"], 9), (["A", "a", "g"], 2)):
        asked, want = list(dict.fromkeys(lower(w) for w in wanted)), {}
        for ids in segments:
            rarest = min(asked, key=lambda w: sum(words[i].count(w) for i in ids))  # noqa: B023
            for i in ids:
                at = {w: [p for p, x in enumerate(words[i]) if x == w] for w in asked}
                if found := [p for p in at[rarest] if all(any(abs(p - q) <= slop for q in at[w]) for w in asked)]:
                    want[i] = found
        assert {r["doc_id"]: r["positions"] for r in positional_index.proximity_matches(index, wanted, slop).collect()} == want


def brute_components(rows):
    sets = []
    for r in rows:
        w = SPACE.findall(lower(r["text"]))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({("whole", *w)} if w else set()))
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    out = []
    for k, r in enumerate(rows):
        ids = [rows[j]["doc_id"] for j in range(len(rows)) if comp[j] == comp[k] and rows[j]["doc_id"] is not None]
        out.append((r["doc_id"], len(sets[k]), min(ids, default=None)))
    return Counter(out)


def test_jaccard_components(odd_docs, no_docs):
    rows = odd_docs.collect()
    assert Counter(map(tuple, group_matrix.jaccard_components(odd_docs).collect())) == brute_components(rows)
    assert group_matrix.jaccard_components(no_docs).count() == 0


def test_links_missed_by_leaders_are_found_by_the_matrix(spark, monkeypatch):
    """Without any comparison in the first step, all links must come from the token-group matrix."""
    import random

    rng = random.Random(3)
    docs = []
    for base in range(6):
        words = [f"b{base}w{k}" for k in range(60)]
        for copy in range(8):
            own = list(words)
            for _ in range(copy % 3):
                own[rng.randrange(60)] = f"x{rng.random()}"
            docs.append((base * 100 + copy, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = df.collect()
    monkeypatch.setattr(group_matrix, "BLOCK", 3)
    monkeypatch.setattr(group_matrix, "FAMILY", 2)
    monkeypatch.setattr(group_matrix, "_is_marked", lambda marks, key: False)
    assert Counter(map(tuple, group_matrix.jaccard_components(df.repartition(1)).collect())) == brute_components(rows)


def test_unlinked_documents_that_share_a_hot_passage(spark, monkeypatch):
    """Many documents share one passage and are not linked by it; some are, by more than the passage."""
    import random

    rng = random.Random(5)
    passage = [f"p{k}" for k in range(40)]
    docs = []
    for k in range(120):
        own = [f"d{k}w{j}" for j in range(rng.choice([4, 9, 14, 30]))]
        docs.append((k, " ".join(passage + own)))
        if k % 10 == 0:
            docs.append((1000 + k, " ".join([*passage, *own[:-1], "changed"])))
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").collect()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    want = brute_components(rows)
    assert 30 < len({c for _, _, c in want}) < 130
    for block, marked in ((4096, True), (5, True), (5, False)):
        monkeypatch.setattr(group_matrix, "BLOCK", block)
        if not marked:
            monkeypatch.setattr(group_matrix, "_is_marked", lambda marks, key: False)
        assert Counter(map(tuple, group_matrix.jaccard_components(df).collect())) == want


def test_one_of_each_group_stays(odd_docs):
    rows = odd_docs.collect()
    kept = group_matrix.first_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    comp = group_matrix.classes_and_components(odd_docs).collect()
    groups = len({r["comp"] for r in comp if r["comp"] is not None}) + sum(r["comp"] is None for r in comp)
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == groups and 2 not in ids and 3 not in ids and 1 in ids and ids.count(12) == 1 and len(rows) > groups


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(30)] + [(100, 101)], "a bigint, b bigint")
    assert {(r["node"], r["comp"]) for r in graph.components(edges).collect()} == {(k, 0) for k in range(31)} | {(100, 100), (101, 100)}


def test_boilerplate(spark, odd_docs, no_docs):
    common = [(100 + k, f"own line {k}\nshared by many \nall of us", "en", f"site{k % 5}", 0) for k in range(10)] + [(200, "shared by many", "en", None, 0), (201, "on one site\non one site", "en", "s", 0)]
    df = spark.createDataFrame(common, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {r["doc_id"]: r for r in line_spread.remove_boilerplate(df, min_sites=5).collect()}
    counts = {r["doc_id"]: r for r in line_spread.line_dedup(df, min_sites=5).collect()}
    assert out[103]["text"] == "own line 3" and counts[103]["n_removed"] == 2 and out[200]["text"] == "" and out[201]["text"] == "on one site\non one site"
    assert line_spread.line_dedup(df, min_sites=6).where("n_removed > 0").count() == 0
    odd = line_spread.line_dedup(odd_docs)
    assert odd.count() == odd_docs.count() and line_spread.line_dedup(no_docs).count() == 0
    assert odd.where("doc_id = 6 and n_lines = 0 and text_sha256 is null").count() == 1


def test_license_scan(spark, odd_docs, no_docs):
    texts = {
        1: "x y\nLicensed under the Apache License, Version 2.0.", 2: "cc by cc by\nCC-BY", 3: "Released under  the MIT\nLicense.", 4: "all rights  RESERVED, general public license", 5: None, 6: "cc BY",
        7: "Released under the famous MIT License, see below", 10: "Released now and here under many more words that stand between the MIT and its License", 8: "the ccc by all rightsreserved", 9: "K cc by",
    }
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id bigint, text string, need int")
    out = {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan(df).collect()}
    assert out[1] == (10, 0, None, None, "", "apache", 1.0)
    assert out[2] == (6, 3, 0, 4, "cc-by", "cc-by", 1.0)
    assert out[3][-2:] == ("mit", 1.0) and out[5] == (0, 0, None, None, "", "", 0.0) and out[8][1] == 0
    assert out[4] == (6, 2, 0, 3, "gpl,reserved", "gpl,reserved", 1.0)
    assert out[10][-2:] == ("", 0.0) and out[7][-2:] == ("mit", 1.0) and out[9][:4] == (3, 1, 1, 1)
    for r in license_scan.scan(odd_docs).collect():
        if r["doc_id"] == 11:
            assert r["n_words"] == len(ALNUM.findall(lower(next(x["text"] for x in odd_docs.collect() if x["doc_id"] == 11))))
    assert license_scan.scan(odd_docs).count() == odd_docs.count() and license_scan.scan(no_docs).count() == 0


def brute_blocks(text, templates, threshold=license_scan.THRESHOLD, span=license_scan.SPAN):
    words, found = ALNUM.findall(lower(text)), {}
    for label, tokens, need, size in license_scan.template_rows(templates, threshold, span):
        held = max(len(set(tokens) & set(words[p : p + size])) for p in range(max(len(words) - size + 1, 1)))
        if held >= need:
            found[label] = max(found.get(label, 0), round(held / len(tokens), 6))
    return found


def test_license_blocks_span_lines_and_cells(spark):
    import random

    rng = random.Random(11)
    filler = lambda n: [f"w{rng.randrange(50)}" for _ in range(n)]
    texts = {}
    for k in range(60):
        words = filler(rng.choice([0, 3, 120, 700]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            notice = rng.choice(license_scan.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 1, 3, 9])):
                notice[rng.randrange(len(notice))] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        texts[k] = "".join(w + rng.choice([" ", " ", "\n", "\n\n", ", "]) for w in words)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = {k: {} for k in texts}
    for r in license_scan.block_matches(df).collect():
        got[r["doc_id"]][r["label"]] = max(got[r["doc_id"]].get(r["label"], 0), round(r["containment"], 6))
    want = {k: brute_blocks(t, license_scan.TEMPLATES) for k, t in texts.items()}
    assert got == want and sum(map(bool, want.values())) > 15


def test_bpe_is_the_rank_encoding(odd_docs, no_docs):
    import tiktoken

    path, pattern = vocabulary()
    tokens = bpe.read_ranks(path)
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    codec = bpe.Codec(bpe.serialise_model(tokens), tokens, pattern)
    odd = ["", " ", "  a  b\n\n c", "\x1c a\x1d  b 　 c\x85 d e", " lead", "a \tb  ", "x " * 40 + "\n\n  y", "a" * 3000 + " " + "b" * 70, "\r\n x", "'s 's don't we'll", "<unk> <s> ▁ Ġy", "12 ab'll 3½ ²x", "日本 語 é"]
    for text in odd:
        assert codec.encode(text) == plain.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for r in odd_docs.collect():
        ids = plain.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode())] += 1
    assert Counter(map(tuple, bpe.encode_documents(odd_docs, path, pattern).collect())) == want
    assert bpe.encode_documents(no_docs, path, pattern).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    slots = training_order.permute(np.arange(n), n, 5)
    assert sorted(slots) == list(range(n))
    assert (training_order.permute(slots, n, 5, inverse=True) == np.arange(n)).all()
    assert n < 64 or (slots != training_order.permute(np.arange(n), n, 6)).any()


def test_packing_is_exact():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50_257, 1000).astype(np.uint16)
    for common in ([], [5, 50_256, 0], ids[:100].tolist()):
        packing = training_order.Packing(list(dict.fromkeys(common)))
        assert (packing.unpack(packing.pack(ids)) == ids).all()


def test_training_order(spark, odd_docs, no_docs, tmp_path):
    path, pattern = vocabulary()
    folder = f"file://{tmp_path}/shards"
    manifest = {r["slot"]: r for r in training_order.materialise(odd_docs, path, pattern, 9, folder, length=64, per_shard=50).collect()}
    n = len(manifest)
    assert sorted(manifest) == list(range(n)) and n > 50
    read = list(training_order.read(folder))
    assert len(read) == n and all(hashlib.sha256(x.tobytes()).hexdigest() == manifest[k]["sha256"] for k, x in enumerate(read))
    assert all((a == b).all() for a, b in zip(training_order.read(folder, n - 60, n - 40), read[n - 60 : n - 40], strict=True))
    codec = bpe.Codec(bpe.serialise_model(bpe.read_ranks(path)), bpe.read_ranks(path), pattern)
    tokens = sum(len(codec.encode(r["text"] or "")) + 1 for r in odd_docs.collect())
    assert sum(r["n_tokens"] for r in manifest.values()) == tokens
    order = sorted(manifest.values(), key=lambda r: r["ordinal"])
    stream = np.concatenate([read[r["slot"]][: r["n_tokens"]] for r in order])
    ends = np.flatnonzero(stream == 50256)
    texts = sorted(codec.decode(x[x != 50256].tolist()).decode() for x in np.split(stream, ends + 1)[:-1])
    assert texts == sorted(r["text"] or "" for r in odd_docs.collect())
    left = [f.name for f in (tmp_path / "shards").iterdir() if f.name.startswith("_")]
    assert not left and len(list((tmp_path / "shards").glob("shard-*.bin"))) == -(-n // 50)
    # a repeated task overwrites what another attempt has written, and remains of lost attempts go
    (tmp_path / "shards" / "_3-999").write_bytes(b"half a shard")
    (tmp_path / "shards" / "shard-000001.bin").write_bytes(b"old")
    again = {r["slot"]: r for r in training_order.materialise(odd_docs, path, pattern, 9, folder, length=64, per_shard=50).collect()}
    assert {k: r["sha256"] for k, r in again.items()} == {k: r["sha256"] for k, r in manifest.items()}
    assert all((a == b).all() for a, b in zip(training_order.read(folder), read, strict=True)) and not list((tmp_path / "shards").glob("_*"))
    # resumed at any slot, a reader goes on as it would have
    for at in (0, 49, 50, 51, n - 1):
        assert all((a == b).all() for a, b in zip(training_order.read(folder, at), read[at:], strict=True))
    assert training_order.materialise(no_docs, path, pattern, 9, f"file://{tmp_path}/none").count() == 0
