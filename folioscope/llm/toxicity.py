"""Toxicity: a logistic model whose score is held still when identity terms are swapped.

Features are a document's distinct words and their beginnings. Of each training document that names a group, copies
with the term swapped for others are made; next to the log loss, training penalises the squared differences of the
scores of a document and its copies, so that naming one group or another cannot carry the verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled, remainder
from .shared import alnum_words, lean, text_bytes

#: Terms that may stand for each other, by kind; words as alnum_words() gives them. Fixed values, and a parameter.
IDENTITY_TERMS = (
    ("men", "women", "boys", "girls"),
    ("man", "woman", "boy", "girl"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("männer", "frauen"), ("muslime", "christen", "juden"), ("hommes", "femmes"), ("musulmans", "chrétiens", "juifs"),
    ("hombres", "mujeres"), ("musulmanes", "cristianos", "judíos"),
)
#: Labelled rows learned from at most, least documents a feature must stand in, and swapped copies of a document.
SAMPLE, LEAST, COPIES = 8000, 3, 2
#: Passes of either round, learning rate, and the weight of the squared score differences.
EPOCHS, RATE, SWAP = 100, 0.5, 1.0
#: L1 pull to zero of the round that chooses features, and of the one that weighs the chosen ones anew: a pull that
#: leaves out what few documents happen to share also holds down the weights of what is left.
CHOOSING, WEIGHING = 5e-3, 1e-4
#: Lengths of the word beginnings that are features beside the word itself.
BEGINNINGS = (4, 5, 6)
FOLDS, HELD_OUT, CUT = 5, 0, 0.5


def word_features(word: bytes) -> list[int]:
    """64-bit keys of a word and of its beginnings (whole characters)."""
    out = [xxhash.xxh64_intdigest(word)]
    if len(word) > min(BEGINNINGS):
        text = word.decode("utf-8", "replace")
        out += [xxhash.xxh64_intdigest(text[:n], n) for n in BEGINNINGS if n < len(text)]
    return out


def _words(text: bytes | None) -> list[bytes]:
    return sorted(set(alnum_words(text)))


def swapped(words: list[bytes], terms=IDENTITY_TERMS, copies: int = COPIES) -> list[list[bytes]]:
    """Copies of a document's distinct words with each identity term replaced by the next of its kind, and so on."""
    place = {t.encode(): (kind, k) for kind in terms for k, t in enumerate(kind)}
    if not any(w in place for w in words):
        return []
    out = []
    for step in range(1, copies + 1):
        new = {(place[w][0][(place[w][1] + step) % len(place[w][0])].encode() if w in place else w) for w in words}
        if new != set(words):
            out.append(sorted(new))
    return out


class Model:
    """Sorted feature keys, their weights, and the constant."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, constant: float):
        kept = weights != 0
        self.weights = dict(zip(keys[kept].tolist(), weights[kept].tolist(), strict=True))
        self.constant = constant
        self._seen: dict[bytes, float] = {}

    def logit(self, words) -> float:
        seen, get, total = self._seen, self.weights.get, self.constant
        for w in words:
            value = seen.get(w)
            if value is None:
                if len(seen) > 500_000:
                    seen.clear()
                value = seen[w] = sum(get(k, 0.0) for k in word_features(w))
            total += value
        return total

    def score(self, text: bytes | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.logit(set(alnum_words(text))), -30, 30))))


def train(rows: list[tuple[list[bytes], int]], terms=IDENTITY_TERMS, swap: float = SWAP, epochs: int = EPOCHS) -> Model:
    """Full-batch adaptive gradient steps on log loss plus swap * squared score differences of documents and their copies.

    Two rounds: one with a strong L1 pull chooses the features, one with a weak pull weighs them.
    """
    docs = [words for words, _ in rows]
    y = np.array([label for _, label in rows], np.float64)
    pairs = [(d, copy) for d, words in enumerate(docs) for copy in swapped(words, terms)]
    cache: dict[bytes, list[int]] = {}

    def features(words: list[bytes]) -> np.ndarray:
        return np.array([k for w in words for k in (cache.get(w) or cache.setdefault(w, word_features(w)))], np.uint64)

    vectors = [features(words) for words in docs]
    copies = [features(copy) for _, copy in pairs]
    if not vectors:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    every, seen = np.unique(np.concatenate([np.unique(v) for v in vectors] + [np.zeros(0, np.uint64)]), return_counts=True)
    named = np.unique(np.concatenate(copies)) if copies else np.zeros(0, np.uint64)
    keys = np.union1d(every[seen >= LEAST], named[np.isin(named, every[seen >= LEAST])])
    if not len(keys):
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Model(keys, np.zeros(0), float(np.log(rate / (1 - rate))))

    def sparse(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows_at = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        at = np.searchsorted(keys, flat)
        at[at == len(keys)] = 0
        ok = keys[at] == flat
        return rows_at[ok], at[ok]

    dr, dc = sparse(vectors)
    cr, cc = sparse(copies)
    origin = np.array([d for d, _ in pairs], np.int64)
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))

    def descend(kept: np.ndarray, pull: float) -> tuple[np.ndarray, float]:
        """Weights of the kept features (0 for the others) and the constant."""
        w, b = np.zeros(len(keys)), start
        squares, b_square = np.full(len(keys), 1e-8), 1e-8
        d_row, d_col, c_row, c_col = dr[kept[dc]], dc[kept[dc]], cr[kept[cc]], cc[kept[cc]]
        for _ in range(epochs):
            logit = b + np.bincount(d_row, w[d_col], len(docs))
            error = (1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30))) - y) / len(docs)
            grad = np.bincount(d_col, error[d_row], len(keys))
            if len(pairs):
                gap = logit[origin] - b - np.bincount(c_row, w[c_col], len(pairs))
                push = 2 * swap * gap / len(docs)
                back = np.bincount(origin, push, len(docs))
                grad += np.bincount(d_col, back[d_row], len(keys)) - np.bincount(c_col, push[c_row], len(keys))
            squares += grad**2
            step = RATE / np.sqrt(squares)
            w = w - step * grad
            w = np.sign(w) * np.maximum(np.abs(w) - step * pull, 0.0)
            b_grad = error.sum()
            b_square += b_grad**2
            b -= RATE * 0.2 * b_grad / np.sqrt(b_square)
        return w, float(b)

    chosen, _ = descend(np.ones(len(keys), bool), CHOOSING)
    return Model(keys, *descend(chosen != 0, WEIGHING))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, terms=IDENTITY_TERMS, swap: float = SWAP) -> Model:
    """A model from at most ``sample`` labelled documents outside the held-out fold, trained in one task."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [b" ".join(_words(x)) for x in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary())], names=["doc_id", "y", "words"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(w.split(), y) for batch in batches for y, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        model = train(rows, terms, swap)
        keys = np.array(list(model.weights), np.uint64)
        weights = np.array(list(model.weights.values()), np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys.tobytes()]), pa.array([weights.tobytes()]), pa.array([model.constant])], names=["keys", "weights", "constant"]
        )

    made = labelled(docs, labels, label, FOLDS, HELD_OUT, sample).select("doc_id", "y", "text").mapInArrow(distinct, "doc_id bigint, y int, words binary")
    rows = made.repartition(1).sortWithinPartitions("doc_id").mapInArrow(learn, "keys binary, weights binary, constant double").collect()
    if not rows:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    return Model(np.frombuffer(rows[0]["keys"], np.uint64), np.frombuffer(rows[0]["weights"], np.float64), rows[0]["constant"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the model is bounded by the training sample."""
    shared = docs.sparkSession.sparkContext.broadcast((np.array(list(model.weights), np.uint64), np.array(list(model.weights.values())), model.constant))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([own.score(x) for x in text_bytes(batch.column(1))], pa.float64())], names=["doc_id", "score"]
            )

    slim = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return slim.mapInArrow(lean(run), "doc_id bigint, score double").select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels.toxic`` and score every whole text: doc_id, held_out, score, predicted.

    Null and empty texts get the score of the constant alone. Null ids stay null and count as not held out; repeated
    rows each get a row; other columns are not read; without labels every score is 0.5; an empty table gives none.
    """
    return score(docs, fit(docs, labels))
