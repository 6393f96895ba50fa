"""Source divergence audit: how far the term shares of a language's sources lie apart, in exact integers.

Terms are counted a task and folded by language, source and term. A range partition by language and term brings all rows
of a term together, in UTF-8 order: there kept terms become sorted arrays (chunks), every counted term finds its integer id by
searchsorted, and a bincount a source gives its vector. Ids follow the order of the bytes, so dense vectors of a chunk
line up between sources, and ties between terms go by id. Sources meet a chunk and a pair of source blocks at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_stored, lean, stored

#: Documents of its language that a kept term stands in, at least.
MIN_DOCS = 10
#: Terms that part ``term`` lists for each group.
TOP_TERMS = 10
#: Terms of a chunk, rows after which a chunk ends early, and sources of a block: a task holds two blocks of dense vectors.
CHUNK_TERMS = 4096
CHUNK_ROWS = 1_000_000
BLOCK_SOURCES = 64
#: Distinct terms of groups that a counting task holds before it hands them on, and bytes of text split at once.
HELD = 300_000
PIECE = 1 << 20

#: A-Z lower-cased; every other ASCII byte that is no letter ends a term.
_TERM_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

COUNTS = "lang string, source string, term string, n bigint, d bigint"
VECTORS = "lang string, chunk bigint, source string, terms array<string>, ids array<int>, counts array<bigint>"
FOUND = "lang string, source string, part string, item string, value bigint"


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some PIECE bytes at a time."""
    text, at = text.translate(_TERM_TABLE), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE) if len(text) - at > PIECE else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences (n) and documents (d) of each term by language and source, of one task's texts."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            if n:
                terms = pa.array(list(n), pa.string())
                columns = [pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), pa.array([source]).take(pa.array(np.zeros(len(n), np.int32)))]
                yield pa.RecordBatch.from_arrays([*columns, terms, pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "d"])
        held.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = batch.column(2).cast(pa.large_binary())
        for lang, source, text in zip(langs, sources, texts, strict=True):
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            pieces = _pieces(text.as_py())
            first = next(pieces, [])
            n.update(first)
            seen = set(first)
            for piece in pieces:
                n.update(piece)
                seen.update(piece)
            d.update(seen)
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from flush()
    yield from flush()


class _Chunks:
    """Kept terms of one range partition, in order, and their counts by source; handed on a chunk at a time."""

    def __init__(self, partition: int, min_docs: int):
        self._next, self._min = partition << 32, min_docs
        self._lang, self._rows, self._n_rows, self._n_terms = None, [], 0, 0

    def add(self, lang: str, terms: np.ndarray, sources: np.ndarray, n: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Take rows of whole terms of one language, sorted by term."""
        if lang != self._lang:
            yield from self.flush()
            self._lang = lang
        starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
        sizes = np.diff(np.r_[starts, len(terms)])
        kept = np.add.reduceat(d, starts) >= self._min
        rows = np.repeat(kept, sizes)
        terms, sources, n, sizes = terms[rows], sources[rows], n[rows], sizes[kept]
        ends = np.cumsum(sizes)
        at = term = 0
        while term < len(sizes):  # as many whole terms as the chunk still takes
            room = np.searchsorted(ends, ends[term] - sizes[term] + max(1, CHUNK_ROWS - self._n_rows), "right")
            upto = min(max(term + 1, int(room)), term + CHUNK_TERMS - self._n_terms, len(sizes))
            end = int(ends[upto - 1])
            self._rows.append((terms[at:end], sources[at:end], n[at:end]))
            self._n_rows, self._n_terms = self._n_rows + end - at, self._n_terms + upto - term
            at, term = end, upto
            if self._n_terms >= CHUNK_TERMS or self._n_rows >= CHUNK_ROWS:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self._rows:
            terms, sources, n = (np.concatenate(x) for x in zip(*self._rows, strict=True))
            dictionary = terms[np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])]
            ids = np.searchsorted(dictionary, terms)
            names, groups = np.unique(sources, return_inverse=True)
            out = [(None, dictionary, np.arange(len(dictionary)), _bincount(ids, n, len(dictionary)))]
            order = np.argsort(groups, kind="stable")
            for name, at in zip(names, np.split(order, np.cumsum(np.bincount(groups))[:-1]), strict=True):
                counts = _bincount(ids[at], n[at], len(dictionary))
                own = np.flatnonzero(counts)
                out.append((name, None, own, counts[own]))
            size = len(out)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([self._lang] * size, pa.string()), pa.array([self._next] * size, pa.int64()), pa.array([x[0] for x in out], pa.string()),
                    pa.array([x[1] for x in out], pa.list_(pa.string())), pa.array([x[2] for x in out], pa.list_(pa.int32())), pa.array([x[3] for x in out], pa.list_(pa.int64())),
                ],
                names=["lang", "chunk", "source", "terms", "ids", "counts"],
            )
            self._next += 1
        self._rows, self._n_rows, self._n_terms = [], 0, 0


def _bincount(ids: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Sums of n by id, exact: in halves, as weights are doubles."""
    low, high = n & 0x7FFFFFFF, n >> 31
    return (np.bincount(ids, high, size).astype(np.int64) << 31) + np.bincount(ids, low, size).astype(np.int64)


def _encode(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, rest = _Chunks(TaskContext.get().partitionId(), min_docs), None

        def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
            langs = table["lang"].combine_chunks()
            cuts = [0, *(np.flatnonzero(pc.not_equal(langs[1:], langs[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(langs)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = table.slice(a, b - a)
                # bytes, so that numpy compares in UTF-8 order
                terms = np.array(part["term"].cast(pa.binary()).to_pylist() + [None], object)[:-1]
                yield from chunks.add(langs[a].as_py(), terms, np.array(part["source"].to_pylist() + [None], object)[:-1], part["n"].to_numpy(), part["d"].to_numpy())

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            last = pc.and_(pc.equal(table["lang"], table["lang"][-1]), pc.equal(table["term"], table["term"][-1]))
            open_rows = int(pc.sum(last).as_py())  # its term may go on in the next batch
            rest = table.slice(len(table) - open_rows)
            if open_rows < len(table):
                yield from whole(table.slice(0, len(table) - open_rows))
        if rest is not None:
            yield from whole(rest)
        yield from chunks.flush()

    return run


def share(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (n + 2 * v)), digit by digit, so that nothing overflows below totals of 9 * 10^15."""
    whole, rest = np.zeros(len(counts), np.int64), counts.astype(np.int64) + 2
    below = n + 2 * v
    for _ in range(3):
        whole, rest = whole * 1000 + rest * 1000 // below, rest * 1000 % below
    return whole + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compare(key: tuple, rows: pa.Table) -> pa.Table:
    """Part sums of the pairs between two blocks of sources over one chunk, and the chunk's leading terms of each group of a block.

    rows: those of both blocks (ids and counts of what occurs; n the group's total, v the language's kept terms), and,
    where both blocks are the same, one without a source: the terms with the language's counts and total.
    """
    lang, left, right = key[0].as_py(), key[2].as_py(), key[3].as_py()
    data, v = rows.to_pylist(), rows["v"][0].as_py()
    terms = next((r for r in data if r["source"] is None), None)
    size = rows["n_terms"][0].as_py()

    def dense(r: dict) -> np.ndarray:
        counts = np.zeros(size, np.int64)
        if r["ids"]:
            counts[np.array(r["ids"], np.int64)] = r["counts"]
        return counts

    groups = [(r["source"], r["block"], dense(r), r["n"]) for r in data if r["source"] is not None]
    shares = {g[0]: share(g[2], g[3], v) if v else g[2] for g in groups}
    out: list[tuple] = []
    ones = [g[0] for g in groups if g[1] == left]
    others = ones if left == right else [g[0] for g in groups if g[1] == right]
    matrix = np.array([shares[s] for s in others]).reshape(len(others), size)
    for k, one in enumerate(ones):
        start = k + 1 if left == right else 0
        if start < len(others):
            sums = distance(shares[one], matrix[start:]).sum(axis=1).tolist() if v else [0] * (len(others) - start)
            for other, value in zip(others[start:], sums, strict=True):
                out += [(lang, one, "pair", other, value), (lang, other, "pair", one, value)]
    if terms is not None:
        q, names = share(dense(terms), terms["n"], v), terms["terms"]
        for source, _, counts, _ in groups:
            p = shares[source]
            found = np.flatnonzero((counts > 0) & (p > q))
            value = distance(p[found], q[found])
            best = np.lexsort((found, -value))[:TOP_TERMS]
            out += [(lang, source, "term", names[found[i]], int(value[i])) for i in best]
    types = [pa.string()] * 4 + [pa.int64()]
    return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: distances between sources (part ``pair``) and each group's leading terms (part ``term``).

    Null text, language and source count as ''. A document is a row, so repeated rows count each; ids and other columns
    are not read. A group without terms has pairs but no leading terms; the pairs of a language that keeps no term have
    the value 0 and rank by item; a language of one source has no pairs. Ties rank by item in UTF-8 order. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    slim = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counted = slim.mapInArrow(lean(_count), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    counts = stored(counted, "term-counts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term", "source")
    vectors = stored(ranged.mapInArrow(lean(_encode(min_docs)), VECTORS), "term-vectors")
    drop_stored(counts)

    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    sums = vectors.groupBy("lang", "source").agg(F.sum(total).alias("n"), F.sum(F.size("terms")).cast("bigint").alias("v"), F.collect_list(F.when(F.col("source").isNull(), F.struct("chunk", F.size("terms").alias("n_terms")))).alias("chunks"))
    langs = sums.where("source is null").select("lang", "v", "chunks", F.col("n").alias("lang_n"))
    groups = slim.select("lang", "source").distinct()
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_SOURCES).alias("blocks"))
    groups = groups.join(sums.where("source is not null").select("lang", "source", "n"), ["lang", "source"], "left").join(blocks, "lang").join(langs, "lang", "left")
    empty = F.array(F.struct(F.lit(-1).cast("bigint").alias("chunk"), F.lit(0).alias("n_terms")))
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), "blocks", F.pmod(F.xxhash64("source"), F.col("blocks")).alias("block"), F.explode(F.coalesce("chunks", empty)).alias("c"))
    groups = groups.select("lang", "source", "n", "v", "blocks", "block", "c.*")
    own = groups.join(vectors.where("source is not null").select("lang", "chunk", "source", "ids", "counts"), ["lang", "chunk", "source"], "left")
    own = own.withColumn("terms", F.lit(None).cast("array<string>")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = vectors.where("source is null").join(langs.join(blocks, "lang"), "lang")
    every = every.select("lang", "chunk", "source", F.col("lang_n").alias("n"), "v", "terms", F.size("terms").alias("n_terms"), "ids", "counts", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).withColumn("other", F.col("block"))
    columns = ["lang", "chunk", F.least("block", "other").alias("b_left"), F.greatest("block", "other").alias("b_right"), "source", "block", "n", "v", "n_terms", "terms", "ids", "counts"]
    found = own.select(*columns).unionByName(every.select(*columns)).groupBy("lang", "chunk", "b_left", "b_right").applyInArrow(_compare, FOUND)
    found = stored(found, "divergence")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    # a chunk's leading terms of a group: only the first few of a task go on
    terms = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= TOP_TERMS)
    return pairs.withColumn("rank", rank).unionByName(terms)
