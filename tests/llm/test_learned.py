"""Learned operators: against brute force where there is one, else by their held-out accuracy and invariants."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioscope.llm import language_crf, perplexity, quality_classifier, toxicity
from folioscope.llm.shared import WordHashes

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    words = SPACE.findall(text or "")
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_rules(spark, odd_docs, no_docs):
    want = Counter()
    for r in odd_docs.collect():
        b = brute_rules(r["text"])
        want[r["doc_id"], *b, b[0] < 50 or 100 * b[4] > 50 * b[0]] += 1
    out = perplexity.quality(odd_docs).collect()
    assert Counter((r["doc_id"], *tuple(r)[1:7]) for r in out) == want
    assert all(not (r["base_failed"] and r["kept"]) for r in out)
    assert perplexity.quality(no_docs).count() == 0


def brute_keys(text):
    """The n-grams of a text: each character of its words and the bound after each, after three units before."""
    words = SPACE.findall(text or "")
    s = "   " + " ".join(words) + " "
    return [s[t - 3 : t + 1] for t in range(3, len(s))] if words else []


def brute_model(texts, order=4):
    """Interpolated modified Kneser-Ney, straight from the definition."""
    a = {order: Counter(g for text in texts for g in brute_keys(text))}
    for k in range(order - 1, 0, -1):
        a[k] = Counter(g[1:] for g in a[k + 1])
    d, stats = {}, {}
    for k in range(1, order + 1):
        n = Counter(a[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d[k] = [max(0.1, min(j - 0.1, j - (j + 1) * y * n[j + 1] / n[j])) if n[j] and n[j + 1] and n[1] else j - 0.5 for j in (1, 2, 3)]
        stats[k] = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in a[k].items():
            s = stats[k][g[:-1]]
            s[0] += c
            s[min(c, 3)] += 1

    def p(g):
        k = len(g)
        low = 1 / 65536 if k == 1 else p(g[1:])
        if g[:-1] not in stats[k]:
            return low
        total, *t = stats[k][g[:-1]]
        c = a[k].get(g, 0)
        return (c - d[k][min(c, 3) - 1] if c else 0) / total + sum(x * m for x, m in zip(d[k], t, strict=True)) / total * low

    return p


def test_perplexity_is_the_models(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(rng.choice(["the", "then", "three", "hat", "that", "äther", "日本語", "한국말", "at"], 40)), "en" if k % 4 else None) for k in range(30)]
    rows += [(3, rows[3][1], "en"), (40, None, "en"), (41, "", None), (None, "the hat", "en"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    texts = [(r["lang"], r["half"], r["text"]) for r in perplexity._slim(df, "doc_id", "text", "lang").collect()]
    models = {(lang, half): brute_model([t for g, h, t in texts if g == lang and h != half]) for lang in ("", "en") for half in (0, 1)}
    halves = {r["doc_id"]: (r["lang"], r["half"], r["text"]) for r in perplexity._slim(df, "doc_id", "text", "lang").collect() if r["doc_id"] is not None}
    out = {r["doc_id"]: r["log_perplexity"] for r in perplexity.quality(df).collect()}
    monkeypatch.setattr(perplexity, "PASS_GRAMS", 60)
    monkeypatch.setattr(perplexity, "GROUP", 300)
    monkeypatch.setattr(perplexity, "HELD", 100)
    again = perplexity.quality(df).collect()
    passes = {r["doc_id"]: r["log_perplexity"] for r in again}
    assert len(again) == len(rows)
    for k, (lang, half, text) in halves.items():
        logp = [math.log(models[lang, half](g)) for g in brute_keys(text)]
        assert out[k] == pytest.approx(-sum(logp) / max(len(logp), 1), abs=1e-4)
        assert passes[k] == pytest.approx(out[k], abs=1e-6)


def test_probabilities_sum_to_one():
    p = brute_model(["the cat sat", "the hat", "a bat at that"])
    known = "abcdefghijklmnopqrstuvwxyz "
    # the model's alphabet has 65536 units, of which those never seen are equally likely
    assert sum(p(" th" + c) for c in known) + (65536 - len(known)) * p(" thΩ") == pytest.approx(1)


def test_each_band_rejects(spark):
    """Of texts that pass the rules, the bands alone reject noise, words run together at random, and over-regular text."""
    rng = np.random.default_rng(8)
    nouns = [a + b for a in ("harbour", "window", "morning", "garden", "letter") for b in ("side", "light", "keeper", "house", "walk")]
    sentence = lambda: " ".join(rng.permutation([str(rng.choice(nouns)) for _ in range(4)] + ["the", "of", "opens"]))
    name = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    prose = [(k, " ".join(f"{sentence()} {name()}" for _ in range(12)), "en") for k in range(300)]
    shuffled = " ".join("".join(rng.permutation(list(w))) for w in prose[0][1].split())
    noise = " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 6)) for _ in range(60))
    regular = " ".join(sentence() for _ in range(12))  # not one unexpected word
    odd = [(900, noise, "en"), (901, shuffled, "en"), (902, regular, "en")]
    out = {r["doc_id"]: r for r in perplexity.quality(spark.createDataFrame([*prose, *odd], "doc_id bigint, text string, lang string")).collect()}
    assert all(not out[k]["base_failed"] and not out[k]["kept"] for k in (900, 901, 902))
    assert out[900]["log_perplexity"] > out[900]["high_band"] and out[901]["log_perplexity"] > out[901]["high_band"]
    assert out[902]["log_perplexity"] < out[902]["low_band"]
    assert sum(out[k]["kept"] for k, _, _ in prose if not out[k]["base_failed"]) >= 0.97 * sum(not out[k]["base_failed"] for k, _, _ in prose) > 100


def test_word_order_counts():
    forward, _ = perplexity.spelled([b"one two three".split()])
    backward, _ = perplexity.spelled([b"three two one".split()])
    assert sorted(forward) != sorted(backward)


def test_spelled_keys():
    keys, lengths = perplexity.spelled([[b"ab", b"c"], [], ["𝒳日".encode()]])
    assert list(lengths) == [5, 0, 3] and len(keys) == 8
    shown = ["".join(chr(int(k) >> s & 0xFFFF) for s in (48, 32, 16, 0)) for k in keys.view(np.uint64)[:5]]
    assert shown == ["   a", "  ab", " ab ", "ab c", "b c "]
    assert 0xE000 <= int(keys[5]) & 0xFFFF < 0xF900 and int(keys[6]) & 0xFFFF == ord("日")
    assert perplexity.rules(b"a b c a b c", [b"a", b"b", b"c"] * 2, WordHashes())[3] == 6


def bundle(spark, n=1200):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for k in range(n):
        good, mean = bool(rng.random() < 0.6), bool(rng.random() < 0.3)
        words = [f"w{int(x)}" for x in rng.integers(0, 300, 30)]
        if not good:
            words = [w + "$$$" for w in words]
        if mean:
            words[7] = str(rng.choice(["vile", "vilest", "nasty"]))
        docs.append((k, " ".join(words), "x"))
        labels.append((k, int(good), int(mean)))
    return spark.createDataFrame(docs, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize(("op", "label", "least"), [(quality_classifier, "quality", 0.95), (toxicity, "toxic", 0.95)])
def test_classifiers_hold_out(spark, odd_docs, no_docs, labels, op, label, least):
    docs, known = bundle(spark)
    rows = op.classify(docs, known).join(known, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == r[label] for r in held) / len(held) >= least
    odd = op.classify(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert op.classify(no_docs, labels).count() == 0
    assert {r["score"] for r in op.classify(odd_docs, labels.where("false")).collect()} == {0.5}


def test_swapping_takes_identity_out_of_the_verdict():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        words = [f"w{int(x)}".encode() for x in rng.integers(0, 80, 12)]
        toxic = k % 3 == 0
        if toxic:
            words.append(b"vile")
        if rng.random() < (0.7 if toxic else 0.05):
            words.append(b"muslim")
        elif rng.random() < 0.3:
            words.append(b"christian")
        rows.append((sorted(set(words)), int(toxic)))
    gap = lambda m: abs(m.logit([b"muslim"]) - m.logit([b"christian"]))
    plain, fair = toxicity.train(rows, swap=0.0), toxicity.train(rows, swap=5.0)
    assert gap(fair) < 0.35 * gap(plain)
    assert fair.logit([b"vile"]) > 0 > fair.logit([b"muslim", b"w1"])


def test_neutral_mentions_are_not_toxic():
    """Toxic sentences name one group more often; neutral ones that name it are false positives without the penalty."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(600):
        toxic = k % 3 == 0
        words = [f"w{int(x)}".encode() for x in rng.integers(0, 60, 8)]
        if toxic and rng.random() < 0.5:
            words.append(b"vile")
        if rng.random() < (0.95 if toxic else 0.02):
            words.append(b"muslim")
        elif rng.random() < 0.3:
            words.append(b"christian")
        rows.append((sorted(set(words)), int(toxic)))
    neutral = [[f"w{int(x)}".encode() for x in rng.integers(0, 60, 8)] + [b"muslim"] for _ in range(200)]
    wrong = lambda m: sum(m.logit(w) >= 0 for w in neutral)
    plain, fair = toxicity.train(rows, swap=0.0), toxicity.train(rows, swap=20.0)
    assert wrong(plain) > 150 and wrong(fair) < 0.2 * wrong(plain)
    assert fair.logit([b"vile", b"w3"]) > fair.logit([b"w3"])


def test_toxicity_training_is_the_plain_gradient():
    """The same steps with dictionaries and loops: a round that chooses features, and one that weighs the chosen ones."""
    rng = np.random.default_rng(3)
    rows = [(sorted({f"x{int(v)}".encode() for v in rng.integers(0, 9, 5)} | ({b"muslim"} if k % 4 == 0 else set())), int(k % 3 == 0)) for k in range(40)]
    model = toxicity.train(rows, swap=0.7, epochs=5)
    seen = Counter(f for words, _ in rows for f in {f for w in words for f in toxicity.word_features(w)})
    used = {f for f, n in seen.items() if n >= toxicity.LEAST}
    every = len(used)
    for pull in (toxicity.CHOOSING, toxicity.WEIGHING):
        vector = lambda words: [f for w in words for f in toxicity.word_features(w) if f in used]  # noqa: B023, E731
        docs = [(vector(words), y) for words, y in rows]
        pairs = [(d, vector(copy)) for d, (words, _) in enumerate(rows) for copy in toxicity.swapped(words)]
        assert pairs
        n, ones = len(docs), sum(y for _, y in docs)
        w, square, b, b_square = dict.fromkeys(used, 0.0), dict.fromkeys(used, 1e-8), math.log((ones + 0.5) / (n - ones + 0.5)), 1e-8
        for _ in range(5):
            grad, b_grad = dict.fromkeys(used, 0.0), 0.0
            for v, y in docs:
                e = (1 / (1 + math.exp(-(b + sum(w[f] for f in v)))) - y) / n
                b_grad += e
                for f in v:
                    grad[f] += e
            for d, copy in pairs:
                push = 2 * 0.7 * (sum(w[f] for f in docs[d][0]) - sum(w[f] for f in copy)) / n
                for f in docs[d][0]:
                    grad[f] += push
                for f in copy:
                    grad[f] -= push
            for f in used:
                square[f] += grad[f] ** 2
                step = toxicity.RATE / math.sqrt(square[f])
                moved = w[f] - step * grad[f]
                w[f] = math.copysign(max(abs(moved) - step * pull, 0.0), moved)
            b_square += b_grad**2
            b -= toxicity.RATE * 0.2 * b_grad / math.sqrt(b_square)
        used = {f for f in used if w[f] != 0}
    assert model.constant == pytest.approx(b) and set(model.weights) == used and len(used) <= every
    assert all(model.weights[f] == pytest.approx(w[f]) for f in model.weights)


def test_regularised_leader_is_the_plain_one():
    """Per-coordinate updates with dictionaries, and the vectors straight from their definition."""
    features = quality_classifier.Features()
    texts = [b"Good words here good words", b"BAD $$$ bad bad", b"", None, "Été ça va été".encode(), b"one"]
    rows = [(*features(t), k % 2) for k, t in enumerate(texts)]
    assert [list(x) for x in rows[2][:2]] == [[0], [1.0]] == [list(x) for x in rows[3][:2]]
    assert all(float((x[1:] ** 2).sum()) == pytest.approx(4.0, abs=1e-5) for at, x, _ in rows[:2])  # four families of length one
    weights = quality_classifier.train(rows, epochs=3)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        pull = max(abs(z[i]) - quality_classifier.L1, 0.0)
        return -math.copysign(pull, z[i]) / ((quality_classifier.BETA + math.sqrt(n[i])) / quality_classifier.ALPHA + quality_classifier.L2) if pull else 0.0

    for _ in range(3):
        for at, x, y in rows:
            now = [weight(i) for i in at.tolist()]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(now, x.tolist(), strict=True))))
            moves = []  # two features may share a weight: each moves it from where it was
            for i, v, w in zip(at.tolist(), x.tolist(), now, strict=True):
                g = (p - y) * v
                moves.append((i, g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality_classifier.ALPHA * w, g * g))
            for i, dz, dn in moves:
                z[i] += dz
                n[i] += dn
    assert set(np.flatnonzero(weights).tolist()) == {i for i in list(z) if weight(i)}
    assert all(weights[i] == pytest.approx(weight(i), abs=1e-5) for i in list(z))


def test_language_prediction_is_the_sum_over_paths(spark):
    """Predictions of a small model against label probabilities summed over all label sequences of each chain."""
    import itertools

    rng = np.random.default_rng(6)
    rows = [([f"{lang}{chr(103 + int(x))}".encode() for x in rng.integers(0, 6, 9)], lang) for _ in range(12) for lang in ("ab", "cd")]
    model = language_crf.train(rows)
    assert model.lexicon is not None and len(model.lexicon.keys) > 4
    texts = {1: "abg cdh abi", 2: "cdj cdk 12 abl cdg", 3: "zz, unknown", 4: "7 8", 5: None, 6: "abg abh abi cdg"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in language_crf.predict(df, model).collect()}
    for k, text in texts.items():
        if not text or not any(c.isalpha() for c in text):
            assert (out[k]["lang_pred"], out[k]["score"]) == ("und", 0.0)
            continue
        words = [w.encode() for w in text.split()]
        emitted = []
        for w in words:
            _, features, _ = language_crf.word_features([w], model.lexicon)
            emitted.append(model.emit[features].sum(0).astype(float))
        weight, mean = 0.0, np.zeros(2)
        for path in itertools.product(range(2), repeat=len(words)):
            s = math.exp(model.start[path[0]] + sum(e[x] for e, x in zip(emitted, path, strict=True)) + sum(model.move[a, b] for a, b in itertools.pairwise(path)))
            weight += s
            for x in path:
                mean[x] += s / len(words)
        mean /= weight
        assert out[k]["lang_pred"] == model.labels[int(mean.argmax())] and out[k]["score"] == pytest.approx(mean.max(), abs=1e-4)


def test_language_field(spark, odd_docs, no_docs):
    rng = np.random.default_rng(4)
    syllables = {"aa": ["ba", "lo", "ti"], "bb": ["ker", "schu", "ung"], "cc": ["ión", "que", "ña"]}
    word = lambda lang: "".join(rng.choice(syllables[lang], 3))
    docs = [(k, " ".join(word(lang) for _ in range(40)), lang) for k in range(150) for lang in (list(syllables)[k % 3],)]
    df = spark.createDataFrame(docs + [(900, None, "aa"), (901, "12 !!", "aa"), (902, "bati", None)], "doc_id bigint, text string, lang string")
    out = {r["doc_id"]: r for r in language_crf.identify(df).collect()}
    assert sum(out[k]["lang_pred"] == lang for k, _, lang in docs) >= 148
    assert out[900]["lang_pred"] == out[901]["lang_pred"] == "und" and out[902]["lang_pred"] == "aa"
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in out.items())
    model = language_crf.train([(t.encode().split(), lang) for _, t, lang in docs])
    mixed = [word("aa").encode() for _ in range(20)] + [word("bb").encode() for _ in range(20)]
    best = model.word_labels(mixed).argmax(1)
    assert (best[:20] == 0).mean() > 0.9 and (best[20:] == 1).mean() > 0.9
    assert language_crf.identify(odd_docs).count() == odd_docs.count() and language_crf.identify(no_docs).count() == 0


def test_marginals_are_sums_over_paths():
    import itertools

    rng = np.random.default_rng(0)
    model = language_crf.Model(["a", "b"], np.zeros((1, 2), np.float32), rng.normal(size=(2, 2)), rng.normal(size=2))
    emitted = rng.normal(size=(1, 4, 2))
    weight = {}
    for path in itertools.product(range(2), repeat=4):
        s = model.start[path[0]] + sum(emitted[0, t, x] for t, x in enumerate(path)) + sum(model.move[a, b] for a, b in zip(path, path[1:], strict=False))
        weight[path] = math.exp(s)
    want = [[sum(w for p, w in weight.items() if p[t] == x) / sum(weight.values()) for x in range(2)] for t in range(4)]
    got, pairs = model.marginals(emitted, np.array([4]), True)
    assert np.allclose(got[0], want) and pairs.sum() == pytest.approx(3)
