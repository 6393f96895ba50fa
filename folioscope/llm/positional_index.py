"""Benchmark decontamination with a distributed positional inverted index.

build() cuts the training texts into segments of about SEGMENT_WORDS words and stores, for each term of a segment,
its sorted positions. A query intersects the position lists of one segment at a time, each shifted by the term's
offset in the phrase, from the rarest term on: so no list is ever longer than a segment, however hot a word is, and
nothing but the (small) query set is sent to all executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import alnum_words, lean, stored, text_bytes

#: A segment is closed at so many words; only a single longer text makes it longer.
SEGMENT_WORDS = 1 << 20
#: Words in a row that make a hit.
WINDOW = 13
#: Bytes of benchmark text that are matched in one pass (and sent to all executors); more are matched in more passes.
PASS_BYTES = 32 << 20

INDEX_SCHEMA = "segment string, term string, n int, positions binary, ids array<bigint>, starts array<int>, lengths array<int>"


class _Segment:
    """Gathers the words of whole documents, with an unused position between two documents."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.parts, self.ids, self.starts, self.lengths, self.at = [], [], [], [], 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        terms = self.terms
        for w in set(words):
            if w not in terms:
                terms[w] = len(terms)
        self.parts.append(np.fromiter(map(terms.__getitem__, words), np.int32, len(words)))
        self.ids.append(doc_id)
        self.starts.append(self.at)
        self.lengths.append(len(words))
        self.at += len(words) + 1

    def rows(self) -> pa.RecordBatch:
        """One row of the documents (term null), then one for each term with its positions, sorted."""
        starts, lengths = np.array(self.starts, np.int32), np.array(self.lengths, np.int32)
        codes = np.concatenate(self.parts)
        positions = np.arange(len(codes), dtype=np.int32) + np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
        order = np.argsort(codes, kind="stable")
        counts = np.bincount(codes, minlength=len(self.terms)).astype(np.int32)
        offsets = np.concatenate([[0, 0], np.cumsum(counts) * 4]).astype(np.int32)
        lists = pa.Array.from_buffers(
            pa.binary(), len(counts) + 1, [None, pa.py_buffer(offsets), pa.py_buffer(positions[order])]
        )
        none = [None] * len(counts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([uuid.uuid4().hex] * (len(counts) + 1), pa.string()),
                pa.array([None, *self.terms], pa.binary()).cast(pa.string()),
                pa.array(np.concatenate([np.zeros(1, np.int32), counts])),
                lists,
                pa.array([self.ids, *none], pa.list_(pa.int64())),
                pa.array([starts, *none], pa.list_(pa.int32())),
                pa.array([lengths, *none], pa.list_(pa.int32())),
            ],
            names=["segment", "term", "n", "positions", "ids", "starts", "lengths"],
        )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = _Segment()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            words = alnum_words(text)
            if now.at and now.at + len(words) > SEGMENT_WORDS:
                yield now.rows()
                now = _Segment()
            now.add(doc_id, words)
    if now.ids:
        yield now.rows()


def build(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the postings of every word of every whole text and return the stored index (a map, no shuffle).

    Without ``path`` it goes to the shared folder and is dropped with the session.
    """
    spark = docs.sparkSession
    slim = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = slim.mapInArrow(lean(_segments), INDEX_SCHEMA)
    if path is None:
        return stored(rows, "postings")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _windows(words: list[bytes], window: int) -> int:
    return min(window, len(words))


class _Lists:
    """The position lists of one segment."""

    def __init__(self, terms: list[bytes], blobs: list[bytes]):
        self.of = {t: np.frombuffer(b, np.int32) for t, b in zip(terms, blobs, strict=True)}

    def has(self, term: bytes, at: np.ndarray) -> np.ndarray:
        """Whether the term stands at each of the positions."""
        positions = self.of.get(term)
        if positions is None:
            return np.zeros(len(at), bool)
        k = np.searchsorted(positions, at)
        k[k == len(positions)] = 0
        return positions[k] == at

    def count(self, term: bytes) -> int:
        return len(self.of.get(term, ()))

    def runs(self, words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each occurring window of the phrase starts: positions, and their window lengths."""
        size = _windows(words, window)
        df = [self.count(w) for w in words]
        anchored: dict[int, list[int]] = {}
        for j in range(len(words) - size + 1):
            if min(df[j : j + size]) > 0:
                rarest = min(range(j, j + size), key=df.__getitem__)
                anchored.setdefault(rarest, []).append(j)
        found = []
        for rarest, starts in anchored.items():
            lo, hi = starts[0], starts[-1] + size
            base = self.of[words[rarest]] - rarest  # position that the phrase's first word would have
            if size > 1:  # one neighbour of the anchor is in every window: this rids us of nearly all
                near = np.zeros(len(base), bool)
                for i in (rarest - 1, rarest + 1):
                    if lo <= i < hi:
                        near |= self.has(words[i], base + i)
                base = base[near]
            if not len(base):
                continue
            inside = np.stack([self.has(words[i], base + i) for i in range(lo, hi)])
            total = np.concatenate([np.zeros((1, len(base)), np.int32), np.cumsum(inside, axis=0, dtype=np.int32)])
            for j in starts:
                whole = total[j - lo + size] - total[j - lo] == size
                if whole.any():
                    found.append(base[whole] + j)
        at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)
        return at, np.full(len(at), size, np.int32)

    def near(self, words: list[bytes], slop: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Positions of the rarest word that have every other word within slop words in the same document."""
        words = list(dict.fromkeys(words))
        if not words or min(map(self.count, words)) == 0:
            return np.zeros(0, np.int32)
        first, *rest = sorted(words, key=self.count)
        at = self.of[first]
        for w in rest:
            positions = self.of[w]
            k = np.searchsorted(positions, at)
            d = np.searchsorted(starts, at, "right") - 1
            before, after = positions[np.maximum(k - 1, 0)], positions[np.minimum(k, len(positions) - 1)]
            left = (k > 0) & (before >= starts[d]) & (at - before <= slop)
            right = (k < len(positions)) & (after < starts[d] + lengths[d]) & (after - at <= slop)
            at = at[left | right]
        return at


def _queries(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' ids (as strings) and words, in passes of a bounded size; items without id or words match nothing."""
    slim = benchmark.select(benchmark[id_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text")).where(
        "item is not null and text is not null"
    )
    size = slim.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    passes = max(1, -(-int(size) // PASS_BYTES))
    for k in range(passes):
        part = slim if passes == 1 else slim.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        items = [(r["item"], alnum_words(r["text"].encode())) for r in part.collect()]
        yield [(item, words) for item, words in items if words]


MATCH_SCHEMA = "segment string, number int, doc_id bigint, n_words bigint, items array<string>, runs array<int>"


def _pass(index: DataFrame, items: list[tuple[str, list[bytes]]], window: int) -> DataFrame:
    """For each document of the index: the items with a window in it, and the word ranges hit (start, end, ...)."""
    spark = index.sparkSession
    terms = sorted({w for _, words in items for w in words})
    wanted = spark.createDataFrame([(t.decode("utf-8", "replace"),) for t in terms], "term string")
    lists = index.join(F.broadcast(wanted), "term", "left_semi") if terms else index.where("false")
    rows = index.where("term is null").unionByName(lists)

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows[rows["term"].isna()].iloc[0]
        starts, lengths = np.array(head["starts"], np.int32), np.array(head["lengths"], np.int32)
        body = rows[rows["term"].notna()]
        lists = _Lists([t.encode() for t in body["term"]], list(body["positions"]))
        hits: dict[int, list] = {}
        for item, words in items:
            at, sizes = lists.runs(words, window)
            if len(at):
                which = np.searchsorted(starts, at, "right") - 1
                for d, p, n in zip(which.tolist(), at.tolist(), sizes.tolist(), strict=True):
                    names, ranges = hits.setdefault(d, (set(), []))
                    names.add(item)
                    ranges.append((p - int(starts[d]), p - int(starts[d]) + n))
        out = []
        for d, doc_id in enumerate(head["ids"]):
            names, ranges = hits.get(d, ((), ()))
            out.append((head["segment"], d, doc_id, int(lengths[d]), sorted(names), _merged(ranges)))
        frame = pd.DataFrame(out, columns=["segment", "number", "doc_id", "n_words", "items", "runs"])
        frame["doc_id"] = pd.array([r[2] if r[2] == r[2] else None for r in out], dtype="Int64")
        return frame

    return rows.groupBy("segment").applyInPandas(match, MATCH_SCHEMA)


def _merged(ranges) -> list[int]:
    """Ranges as a flat list of start, end, start, end, ..., without overlaps."""
    flat: list[int] = []
    for a, b in sorted(ranges):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def phrase_matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Exact phrase matches of the benchmark's windows, one row for each indexed document.

    segment, number (the document's place there), doc_id, n_words, items (ids as strings, sorted) and runs (the
    ranges of words inside any occurrence of a window, as start, end, start, end, ...).
    """
    parts = []
    for items in _queries(benchmark, id_col, text_col):  # a pass is run and stored before the next one's items are read
        parts.append(stored(_pass(index, items, window), "matches"))
    if len(parts) == 1:
        return parts[0]
    found = parts[0].where("false")
    for part in parts:
        found = found.unionByName(part.where("size(items) > 0"))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        """One row for each document of a segment that any pass has found something in."""
        out = []
        for _, same in rows.groupby("number", sort=False):
            first = same.iloc[0].copy()
            first["items"] = sorted({i for r in same["items"] for i in r})
            first["runs"] = _merged([(int(r[k]), int(r[k + 1])) for r in same["runs"] for k in range(0, len(r), 2)])
            out.append(first)
        frame = pd.DataFrame(out, columns=rows.columns)
        frame["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in frame["doc_id"]], dtype="Int64")
        return frame

    merged = found.groupBy("segment").applyInPandas(merge, MATCH_SCHEMA)
    rest = parts[0].join(merged.select("segment", "number"), ["segment", "number"], "left_anti")
    return rest.withColumns({"items": F.array().cast("array<string>"), "runs": F.array().cast("array<int>")}).select(*parts[0].columns).unionByName(merged)


def proximity_matches(index: DataFrame, words: list[str], slop: int) -> DataFrame:
    """Places where all words stand within ``slop`` words of the rarest of them: doc_id, positions (of the rarest)."""
    wanted = [w for word in words for w in alnum_words(word.encode())]
    rows = index.where(F.col("term").isNull() | F.col("term").isin([w.decode("utf-8", "replace") for w in wanted]))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        head, body = rows[rows["term"].isna()].iloc[0], rows[rows["term"].notna()]
        starts, lengths = np.array(head["starts"], np.int32), np.array(head["lengths"], np.int32)
        at = _Lists([t.encode() for t in body["term"]], list(body["positions"])).near(wanted, slop, starts, lengths)
        found: dict[int, list[int]] = {}
        for d, p in zip((np.searchsorted(starts, at, "right") - 1).tolist(), at.tolist(), strict=True):
            found.setdefault(d, []).append(p - int(starts[d]))
        return pd.DataFrame({"doc_id": pd.array([head["ids"][d] for d in found], dtype="Int64"), "positions": pd.Series(list(found.values()), dtype=object)})

    return rows.groupBy("segment").applyInPandas(match, "doc_id bigint, positions array<int>")


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, index: DataFrame | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words).

    A document word inside any occurrence of an item's window of ``window`` words (of all its words, where it has
    fewer) is hit. Null and empty texts have no words and no hits; null ids stay null; repeated rows each get a row;
    items without id, text or words match nothing, and repeated items count once by id; other columns are not read;
    without documents the result is empty, without items nothing is hit.
    """
    index = build(docs, None, id_col, text_col) if index is None else index
    found = phrase_matches(index, benchmark, window)
    ends = "filter(runs, (x, i) -> i % 2 = 1)"
    begins = "filter(runs, (x, i) -> i % 2 = 0)"
    total = "aggregate({}, 0L, (a, x) -> a + x)"
    return (
        found.withColumn("n_hit", F.expr(f"{total.format(ends)} - {total.format(begins)}"))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("bigint").alias("n_items"),
            F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
    )
