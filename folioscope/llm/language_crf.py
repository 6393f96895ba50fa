"""Language of each word by a linear-chain conditional random field, and of each text by its words.

A word's features are its affixes, its character n-grams and the languages that a lexicon lists it under (words that
two or more training texts of a language hold); transitions between the labels of neighbouring words are learned with
them. Chains are trained and labelled by forward-backward. All words of the training texts are trained on, in chains;
to learn what a switch looks like, some chains go on with words of another language from a random word on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import remainder
from .shared import lean, mix, small_or_shuffled, space_words, text_bytes

#: log2 of the rows of the feature table; words of a chain (longer texts are cut into several); training texts a language.
BITS, CHAIN, SAMPLE = 16, 48, 300
#: Share of training chains that switch, passes, learning rate, chains of a step, L2 penalty.
SWITCHED, EPOCHS, RATE, STEP, L2 = 0.3, 3, 0.25, 64, 1e-6
#: Training texts of a language that must hold a word for the lexicon to list it.
LISTED = 2
FOLDS, HELD_OUT = 4, 2
#: Words that a worker remembers the scores of.
REMEMBERED = 400_000

_ROLL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD)]
_TRIM = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"


class Lexicon:
    """Sorted hashes of known words, each with the number of a language (a word may stand under several)."""

    def __init__(self, keys: np.ndarray, languages: np.ndarray):
        order = np.lexsort((languages, keys))
        self.keys, self.languages = keys[order], languages[order]

    @classmethod
    def of(cls, rows: list[tuple[list[bytes], str]], place: dict[str, int]) -> Lexicon:
        keys, languages = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lang, number in place.items():
            texts = [np.unique(word_features(sorted(set(words)))[2]) for words, x in rows if x == lang and words]
            found, held = np.unique(np.concatenate(texts or [np.zeros(0, np.uint64)]), return_counts=True)
            keys.append(found[held >= LISTED])
            languages.append(np.full(int((held >= LISTED).sum()), number))
        return cls(np.concatenate(keys), np.concatenate(languages))

    def rows(self, owners: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The feature rows of words (those behind the hashed ones, one a language), with their owners."""
        first, last = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        held = last - first
        at = np.repeat(first - np.cumsum(held) + held, held) + np.arange(held.sum())
        return np.repeat(owners, held), (1 << BITS) + self.languages[at]


def word_features(words: list[bytes], lexicon: Lexicon | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the feature table of each word, as pairs of (the word's place, row), and the words' hashes.

    A word is spelled between two bounds without the punctuation and digits around it. Its features are all 2- and
    3-grams, affixes of up to 4 characters (2- to 5-grams at a bound) and the lexicon's rows; a word of nothing but
    punctuation and digits has none (and no hash).
    """
    text = (b" " + b" ".join([w.strip(_TRIM) for w in words]) + b" ").decode("utf-8", "replace").lower()
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    bounds = np.flatnonzero(c == 32)
    word = np.cumsum(c == 32) - 1  # a bound belongs to the word it opens
    at = np.arange(len(c) - 1)
    end = bounds[word[:-1] + 1]
    opens = (c[:-1] == 32) & (end > at + 1)
    owners, rows = [], []
    rolled = c * _ROLL[0]
    for n in range(2, 6):
        rolled = rolled[:-1] + c[n - 1 :] * _ROLL[n - 1]
        k = len(rolled)
        inside = at[:k] + n - 1 <= end[:k]
        if n < 4:
            inside &= (c[:k] != 32) | opens[:k]
        else:
            inside &= opens[:k] | ((at[:k] + n - 1 == end[:k]) & (c[:k] != 32))
        p = np.flatnonzero(inside)
        owners.append(word[p])
        rows.append(mix(rolled[p] ^ (_ROLL[5] >> np.uint64(n))))
    letters = np.flatnonzero(c != 32)
    spelled = mix(c[letters] + (letters - bounds[word[letters]]).astype(np.uint64) * _ROLL[1])
    whole = np.zeros(len(words), np.uint64)
    np.add.at(whole, word[letters], spelled)
    some = np.unique(word[letters])
    keys = mix(whole[some])
    hashed = (np.concatenate(rows) >> np.uint64(64 - BITS)).astype(np.int64)
    if lexicon is None:
        return np.concatenate(owners), hashed, keys
    listed = lexicon.rows(some, keys)
    return np.concatenate([*owners, listed[0]]), np.concatenate([hashed, listed[1]]), keys


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


class Model:
    """Emission weights by feature row, transitions from one label to the next, first-word weights, and the lexicon."""

    def __init__(self, labels: list[str], emit: np.ndarray, move: np.ndarray, start: np.ndarray, lexicon: Lexicon | None = None):
        self.labels, self.emit, self.move, self.start, self.lexicon = labels, emit, move, start, lexicon
        self._seen: dict[bytes, int] = {}
        self._table = np.zeros((0, len(labels)), np.float32)

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Summed emission weights of each word for each label; those of known words are remembered."""
        seen = self._seen
        if len(seen) > REMEMBERED:
            seen.clear()
            self._table = self._table[:0]
        new = [w for w in set(words) if w not in seen]
        if new:
            owner, rows, _ = word_features(new, self.lexicon)
            made = np.stack([np.bincount(owner, self.emit[rows, j], len(new)) for j in range(len(self.labels))], 1)
            seen.update(zip(new, range(len(self._table), len(self._table) + len(new)), strict=True))
            self._table = np.concatenate([self._table, made.astype(np.float32)])
        return self._table[np.fromiter(map(seen.__getitem__, words), np.int64, len(words))]

    def marginals(self, emitted: np.ndarray, lengths: np.ndarray, count_pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each word of each chain (chains x words x labels), and of each pair of neighbours summed."""
        chains, size, k = emitted.shape
        factor = np.exp(emitted - emitted.max(2, keepdims=True))
        move = np.exp(self.move).astype(factor.dtype)
        forward = np.empty_like(factor)
        f = factor[:, 0] * np.exp(self.start).astype(factor.dtype)
        forward[:, 0] = f / f.sum(1, keepdims=True)
        for t in range(1, size):
            f = (forward[:, t - 1] @ move) * factor[:, t]
            forward[:, t] = f / f.sum(1, keepdims=True)
        out, pairs = np.zeros_like(factor), np.zeros((k, k))
        b = np.ones((chains, k), factor.dtype)
        for t in range(size - 1, -1, -1):
            inside = (t < lengths)[:, None]
            p = forward[:, t] * b
            out[:, t] = np.where(inside, p / p.sum(1, keepdims=True), 0)
            if t:
                right = factor[:, t] * b
                if count_pairs:
                    joint = forward[:, t - 1, :, None] * move[None] * right[:, None, :]
                    joint /= joint.sum((1, 2), keepdims=True)
                    pairs += (joint * inside[:, :, None]).sum(0)
                b = np.where(inside, right @ move.T, factor.dtype.type(1))
                b /= b.sum(1, keepdims=True)
        return out, pairs

    def word_labels(self, words: list[bytes]) -> np.ndarray:
        """Label probabilities of each word of one text, in chains of CHAIN words."""
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        return self.all_labels([words])[0]

    def all_labels(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        flat = [w for words in texts for w in words]
        emitted = self.scores(flat)
        cuts = [np.arange(0, len(words), CHAIN) for words in texts]
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
        starts = np.concatenate([c + o for c, o in zip(cuts, offsets[:-1], strict=True)] or [np.zeros(0, int)]).astype(int)
        ends = np.concatenate([np.minimum(c + CHAIN, len(w)) + o for c, o, w in zip(cuts, offsets[:-1], texts, strict=True)] or [np.zeros(0, int)]).astype(int)
        out = np.zeros((len(flat), len(self.labels)), np.float32)
        order = np.argsort(ends - starts, kind="stable")
        for k in range(0, len(order), 2048):
            some = order[k : k + 2048]
            lengths = ends[some] - starts[some]
            at = np.minimum(starts[some][:, None] + np.arange(lengths.max()), ends[some][:, None] - 1)
            probabilities, _ = self.marginals(emitted[at], lengths)
            inside = np.arange(lengths.max()) < lengths[:, None]
            out[at[inside]] = probabilities[inside]
        return [out[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def train(rows: list[tuple[list[bytes], str]], seed: int = 7) -> Model | None:
    """A model of the rows' labels, by adaptive gradient steps on the chains' log likelihood; None without rows."""
    labels = sorted({lang for _, lang in rows})
    if not labels:
        return None
    place, rng = {x: k for k, x in enumerate(labels)}, np.random.default_rng(seed)
    chains: list[tuple[list[bytes], np.ndarray]] = []
    by_lang = {x: [w for w, lang in rows if lang == x and w] for x in labels}
    for part, lang in [(words[at : at + CHAIN], lang) for words, lang in rows for at in range(0, len(words), CHAIN)]:
        truth = np.full(len(part), place[lang])
        if len(labels) > 1 and rng.random() < SWITCHED and len(part) > 3:
            other = labels[(place[lang] + int(rng.integers(1, len(labels)))) % len(labels)]
            if by_lang[other]:
                donor = by_lang[other][int(rng.integers(len(by_lang[other])))]
                cut, at = int(rng.integers(1, len(part))), int(rng.integers(len(donor)))
                tail = donor[at : at + len(part) - cut]
                part, truth = part[:cut] + tail, np.concatenate([truth[:cut], np.full(len(tail), place[other])])
        chains.append((part, truth))
    k = len(labels)
    model = Model(labels, np.zeros(((1 << BITS) + k, k), np.float32), np.zeros((k, k)), np.zeros(k), Lexicon.of(rows, place))
    emit_sq, move_sq, start_sq = np.full(model.emit.shape, 1e-4, np.float32), np.full((k, k), 1.0), np.full(k, 1.0)
    kinds = list({w for words, _ in chains for w in words})
    owner, rows_of, _ = word_features(kinds, model.lexicon)
    order = np.argsort(owner, kind="stable")
    flat_rows, first = rows_of[order], np.searchsorted(owner[order], np.arange(len(kinds) + 1))
    number = {w: i for i, w in enumerate(kinds)}
    for _ in range(EPOCHS):
        rng.shuffle(chains)
        for s in range(0, len(chains), STEP):
            some = chains[s : s + STEP]
            lengths = np.array([len(w) for w, _ in some])
            size, n = int(lengths.max()), len(some)
            which = np.array([number[w] for words, _ in some for w in words])
            counts = first[which + 1] - first[which]
            places = np.concatenate([c * size + np.arange(len(words)) for c, (words, _) in enumerate(some)])
            owner = np.repeat(places, counts)
            features = flat_rows[np.repeat(first[which] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            emitted = np.stack([np.bincount(owner, model.emit[features, j], n * size) for j in range(k)], 1).reshape(n, size, k)
            guess, pairs = model.marginals(emitted, lengths, True)
            error = -guess
            true_pairs, true_start = np.zeros((k, k)), np.zeros(k)
            for c, (_, truth) in enumerate(some):
                error[c, np.arange(len(truth)), truth] += 1
                np.add.at(true_pairs, (truth[:-1], truth[1:]), 1)
                true_start[truth[0]] += 1
            flat = error.reshape(n * size, k) / n
            rows_used, inverse = np.unique(features, return_inverse=True)
            grad = np.stack([np.bincount(inverse, flat[owner, j], len(rows_used)) for j in range(k)], 1).astype(np.float32)
            grad -= L2 * model.emit[rows_used]
            emit_sq[rows_used] += grad**2
            model.emit[rows_used] += RATE * grad / np.sqrt(emit_sq[rows_used])
            move_grad, start_grad = (true_pairs - pairs) / n, (true_start - guess[:, 0].sum(0)) / n
            move_sq += move_grad**2
            start_sq += start_grad**2
            model.move += RATE * move_grad / np.sqrt(move_sq)
            model.start += RATE * start_grad / np.sqrt(start_sq)
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` documents of each language outside the held-out fold (least id hash first), in one task.

    The choice reads ids and languages only and keeps, at each step, a bounded number of ids a language. The chosen
    texts are learned from whole.
    """
    ids = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["lang"].cast("string").alias("lang")).where(
        "doc_id is not null and lang is not null"
    )
    ids = ids.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT).withColumn("h", F.xxhash64("doc_id"))
    # a threshold on the hash leaves about twice the sample of each language, whatever the table's size
    counts = ids.groupBy("lang").agg(F.count("*").alias("n"))
    near = ids.join(small_or_shuffled(counts), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.greatest(F.lit(2.0 * sample) / F.col("n"), F.lit(0.0)) * (1 << 30))
    ranked = near.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.pmod("h", F.lit(1 << 30)).alias("h"), "doc_id"))), 1, sample).alias("s"))
    chosen = ranked.select("lang", F.explode("s").alias("s")).select("lang", "s.doc_id")
    slim = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    texts = slim.join(F.broadcast(chosen), ["doc_id", "lang"]).where("text is not null").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(space_words(x), lang) for batch in batches for lang, x in zip(batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True)]
        model = train(rows)
        if model is not None:
            own = model.lexicon
            parts = [x.tobytes() for x in (model.emit.astype(np.float32), model.move, model.start, own.keys, own.languages.astype(np.int64))]
            names = ["labels", "emit", "move", "start", "known", "under"]
            yield pa.RecordBatch.from_arrays([pa.array([model.labels], pa.list_(pa.string())), *[pa.array([p], pa.binary()) for p in parts]], names=names)

    schema = "labels array<string>, emit binary, move binary, start binary, known binary, under binary"
    out = texts.repartition(1).sortWithinPartitions("doc_id", "lang").mapInArrow(lean(learn), schema).collect()
    if not out:
        return None
    k = len(out[0]["labels"])
    return Model(
        list(out[0]["labels"]),
        np.frombuffer(out[0]["emit"], np.float32).reshape(-1, k),
        np.frombuffer(out[0]["move"]).reshape(k, k),
        np.frombuffer(out[0]["start"]),
        Lexicon(np.frombuffer(out[0]["known"], np.uint64), np.frombuffer(out[0]["under"], np.int64)),
    )


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, switches of every document; the model's size is bounded by the training sample."""
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.labels, model.emit, model.move, model.start, model.lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if shared.value is None else Model(*shared.value)
        for batch in batches:
            raw = text_bytes(batch.column(1))
            names, scores, switches = [], [], []
            for group in _grouped(raw):
                words = [space_words(x) if own is not None else [] for x in group]
                for text, probabilities in zip(group, own.all_labels(words) if own is not None else words, strict=True):
                    if own is None or not has_letter(text.decode("utf-8", "replace") if text else None):
                        names.append("und")
                        scores.append(0.0)
                        switches.append(0)
                        continue
                    mean = probabilities.mean(0)
                    best = probabilities.argmax(1)
                    names.append(own.labels[int(mean.argmax())])
                    scores.append(float(min(mean.max(), 1.0)))
                    switches.append(int((best[1:] != best[:-1]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(switches, pa.int64())],
                names=["doc_id", "lang_pred", "score", "switches"],
            )

    slim = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    out = slim.mapInArrow(lean(run), "doc_id bigint, lang_pred string, score double, switches bigint")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "switches")


def _grouped(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text or b"")
        if size > 2_000_000:
            yield group
            group, size = [], 0
    yield group


def identify(docs: DataFrame) -> DataFrame:
    """Learn from text and lang and label every whole text: doc_id, held_out, lang_pred, score, switches.

    A text's language is that of the largest mean label probability of its words, which is its score; switches counts
    neighbours with different likeliest labels. Null texts and texts without a letter get ``und`` and score 0, as do all
    without training rows. Null ids stay null and count as not held out; repeated rows each get a row; other columns
    are not read; an empty table gives an empty result.
    """
    return predict(docs, fit(docs))
