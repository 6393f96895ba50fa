"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A document is a sparse vector of hashed unigrams and bigrams, of its words and of their shapes (runs of lower case,
upper case, digits, symbols), each family with square-rooted frequencies, so of length one. Its score is the logistic
function of the dot product with the weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled, remainder
from .shared import lean, mix, space_words, text_bytes

#: log2 of the number of weights (1 MB of them); labelled rows that are learned from at most; passes over them.
BITS, SAMPLE, EPOCHS = 18, 6000, 4
#: Learning rate and its offset, and the L1 and L2 penalties of the updates.
ALPHA, BETA, L1, L2 = 0.6, 1.0, 0.02, 0.5
FOLDS, HELD_OUT, CUT = 5, 0, 0.3

_KINDS = bytes(
    0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x41 if 0x41 <= b <= 0x5A else 0x39 if 0x30 <= b <= 0x39 else b for b in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


class _Hashed(dict):
    """Word to the hashes of itself (lower-cased) and of its shape, remembered."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = _RUNS.sub(rb"\1", word.translate(_KINDS))
        out = self[word] = xxhash.xxh64_intdigest(word.lower()), xxhash.xxh64_intdigest(shape, 7)
        return out


class Features:
    def __init__(self, bits: int = BITS):
        self._seen, self._shift = _Hashed(), np.uint64(64 - bits)

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of a text's vector; index 0 is the constant."""
        words = space_words(text)
        if not words:
            return np.zeros(1, np.int64), np.ones(1, np.float32)
        if len(self._seen) > 500_000:
            self._seen.clear()
        both = np.array(list(map(self._seen.__getitem__, words)), np.uint64)
        indices, values = [np.zeros(1, np.int64)], [np.ones(1, np.float32)]
        for column in range(2):
            h = both[:, column]
            pairs = mix(h[:-1]) * np.uint64(3) + h[1:]
            pairs[both[:-1, 0] == both[1:, 0]] = np.uint64(0x5851F42D4C957F2D)  # a word after itself, whichever
            for part in (h, pairs):
                if len(part):
                    at, n = np.unique(mix(part) >> self._shift, return_counts=True)
                    indices.append(at.astype(np.int64))
                    values.append(np.sqrt(n / len(part)).astype(np.float32))
        return np.concatenate(indices), np.concatenate(values)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after follow-the-regularised-leader updates, one row after the other."""
    z, n = np.zeros(1 << bits, np.float64), np.zeros(1 << bits, np.float64)

    def weights(at) -> np.ndarray:
        pull = np.maximum(np.abs(z[at]) - L1, 0.0)
        return -np.sign(z[at]) * pull / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for at, x, y in rows:
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            np.add.at(z, at, g - sigma * w)
            np.add.at(n, at, g * g)
    return weights(slice(None)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most ``sample`` labelled documents outside the held-out fold; all zero without any.

    Features are made where the texts are; one task sees the sample's vectors (bounded by the sample and 2^BITS).
    """

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            made = [features(x) for x in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.astype(np.int32).tobytes() for a, _ in made]), pa.array([v.tobytes() for _, v in made])],
                names=["doc_id", "y", "at", "x"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for _, y, at, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((np.frombuffer(at, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64), y))
        yield pa.RecordBatch.from_arrays([pa.array([train(rows).tobytes()])], names=["weights"])

    made = labelled(docs, labels, label, FOLDS, HELD_OUT, sample).select("doc_id", "y", "text")
    made = made.mapInArrow(lean(vectors), "doc_id bigint, y int, at binary, x binary")
    out = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)), "doc_id").mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(out[0]["weights"], np.float32) if out else np.zeros(1 << BITS, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the weights have a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(), shared.value
        for batch in batches:
            totals = []
            for text in text_bytes(batch.column(1)):
                at, x = features(text)
                totals.append(float(w[at] @ x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(np.array(totals), -30, 30))))], names=["doc_id", "score"]
            )

    slim = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return slim.mapInArrow(lean(run), "doc_id bigint, score double").select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels.quality`` and score every whole text: doc_id, held_out, score, predicted.

    Null and empty texts get the score of the constant alone. Null ids stay null and count as not held out; repeated
    rows each get a row; other columns are not read; without labels every score is 0.5; an empty table gives none.
    """
    return score(docs, fit(docs, labels))
