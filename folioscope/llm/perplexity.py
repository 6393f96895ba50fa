"""Quality rules: fixed text rules, and perplexity bands of a modified Kneser-Ney n-gram model for each language.

The model's units are characters, with one bound between two words: each character (and each bound after a word) is
predicted from the ORDER - 1 units before it, across the bounds, so the order of the words counts as well as their
spelling. Spark counts the n-grams of all documents. A document is scored by the model of the *other* half of the
documents (halves by a hash of doc_id), so that it doesn't vouch for itself. All n-grams that will be looked up are
known beforehand, since every document is counted: their interpolated log probabilities are joined together once, and
reach the workers as sorted arrays of 64-bit keys, in as many passes as the size of the arrays asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, drop_stored, lean, mix, small_or_shuffled, space_words, stored, text_bytes

ORDER = 4
#: A unit has 16 bits: code points of the basic plane stand for themselves; all others share its private-use area.
BITS, BOUND, PRIVATE, PRIVATE_SIZE = 16, 0x20, 0xE000, 0x1900
#: Rejected from so many scaled median absolute deviations below and above the language's median log perplexity.
LOWER, UPPER = 5.0, 6.0
#: Where fewer texts than MEASURED (or only equal scores) give no spread, the band reaches so many nats down and up.
MEASURED, LEAST_LOWER, LEAST_UPPER = 30, 0.35, 2.2
#: Bytes of text worked on at once, n-grams a worker gathers before it passes them on, and n-grams of one scoring pass.
GROUP, HELD, PASS_GRAMS = 1 << 20, 3_000_000, 4_000_000
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_NOT_IN_WORDS = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))
_MASK = {k: (1 << (BITS * k)) - 1 for k in range(ORDER)}


def spelled(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-gram that ends at each predicted unit of the texts (lists of words), and how many each text has.

    Before a text stand ORDER - 1 bounds; its words follow, each with a bound after it.
    """
    plain = [b" ".join(words).decode("utf-8", "replace") + " " for words in texts if words]
    lengths = np.zeros(len(texts), np.int64)
    lengths[[k for k, words in enumerate(texts) if words]] = list(map(len, plain))
    lead = " " * (ORDER - 1)
    points = np.frombuffer((lead + lead.join(plain)).encode("utf-32-le"), np.uint32)
    codes = points.astype(np.uint64)
    beyond = points > 0xFFFF
    codes[beyond] = PRIVATE + points[beyond] % PRIVATE_SIZE
    keys = codes.copy()
    for j in range(1, ORDER):
        keys[j:] |= codes[:-j] << np.uint64(BITS * j)
    some = lengths[lengths > 0]
    predicted = np.repeat(np.tile([False, True], len(some)), np.stack([np.full(len(some), ORDER - 1), some], 1).ravel())
    return keys[: len(predicted)][predicted].view(np.int64), lengths


def rules(text: bytes | None, words: list[bytes], hashes: WordHashes) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not words:
        return 0, 0, 0, 0
    chars = len(text.translate(None, _NOT_IN_WORDS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if len(words) > 3:
        h = hashes.of(words)
        windows = mix(h[:-2]) ^ mix(h[1:-1] + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(3) ^ mix(h[2:] ^ np.uint64(0xD1B54A32D192ED03)) * np.uint64(5)
        order = np.argsort(windows, kind="stable")
        s = windows[order]
        twin = np.zeros(len(s), bool)
        same = s[1:] == s[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        inside = np.zeros(len(words), bool)
        starts = order[twin]
        for j in range(3):
            inside[starts + j] = True
        repeated = int(inside.sum())
    return chars, symbols, len(lines) - len(set(lines)), repeated


def _slim(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    ident = docs[id_col].cast("bigint")
    return docs.select(
        ident.alias("doc_id"),
        docs[text_col].cast("string").alias("text"),
        F.xxhash64(docs[text_col].cast("string")).alias("text_hash"),
        F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang"),
        F.pmod(F.xxhash64(ident), F.lit(2)).cast("int").alias("half"),
    )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with some GROUP bytes of text each (a longer text alone)."""
    for batch in batches:
        sizes = np.cumsum([len(x) if x is not None else 0 for x in text_bytes(batch.column(batch.schema.names.index("text")))])
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(int(np.searchsorted(sizes, before + GROUP, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def _by_model(langs: list[str], halves: list[int]) -> dict[tuple[str, int], list[int]]:
    out: dict[tuple[str, int], list[int]] = {}
    for k, model in enumerate(zip(langs, halves, strict=True)):
        out.setdefault(model, []).append(k)
    return out


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts, summed."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def count_grams(slim: DataFrame) -> DataFrame:
    """lang, half, key, c: how often each n-gram of full length stands in the documents of a language and half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def folded(model: tuple[str, int]) -> tuple[np.ndarray, np.ndarray]:
            parts = held.pop(model)
            return parts[0] if len(parts) == 1 else _counted(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))

        def rows(model: tuple[str, int], keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 500_000):
                some, n = keys[k : k + 500_000], len(keys[k : k + 500_000])
                columns = [pa.array([model[0]] * n, pa.string()), pa.array(np.full(n, model[1], np.int32)), pa.array(some), pa.array(counts[k : k + n])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "half", "key", "c"])

        for batch in _groups(batches):
            texts, langs, halves = text_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for model, which in _by_model(langs, halves).items():
                keys, _ = spelled([space_words(texts[k]) for k in which])
                if len(keys):
                    held.setdefault(model, []).append(_counted(keys))
            if sum(len(k) for parts in held.values() for k, _ in parts) > HELD:
                for model in list(held):
                    held[model] = [folded(model)]
                if sum(len(k) for parts in held.values() for k, _ in parts) > HELD // 2:
                    for model in list(held):
                        yield from rows(model, *folded(model))
        for model in list(held):
            yield from rows(model, *folded(model))

    rows = slim.select("text", "lang", "half").mapInArrow(lean(run), "lang string, half int, key bigint, c bigint")
    return rows.groupBy("lang", "half", "key").agg(F.sum("c").alias("c"))


def log_probabilities(grams: DataFrame) -> DataFrame:
    """lang, half, key, logp: each counted n-gram's log probability by the model of the other half.

    ``grams`` is what count_grams() gives, and is read many times: store it first.
    """
    by = ["lang", "half"]
    adjusted = {ORDER: grams.select("lang", (1 - F.col("half")).alias("half"), "key", F.col("c").alias("a"))}
    targets = {ORDER: grams.select(*by, "key")}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("key").bitwiseAND(F.lit(_MASK[k])).alias("key")
        # an n-gram's lower-order count is the number of different units before it
        # each order is written once, which keeps the plans of the next ones small
        adjusted[k] = stored(adjusted[k + 1].groupBy(*by, shorter).agg(F.count("*").alias("a")), "counts")
        targets[k] = stored(targets[k + 1].select(*by, shorter).distinct(), "targets")

    lower = None
    for k in range(1, ORDER + 1):
        counts = adjusted[k]
        n = {j: F.sum(F.when(F.col("a") == j, 1).otherwise(0)).cast("double").alias(f"n{j}") for j in (1, 2, 3, 4)}
        y = "n1 / (n1 + 2 * n2)"
        discount = counts.groupBy(*by).agg(*n.values()).select(
            *by,
            *[
                F.expr(f"case when n{j} > 0 and n{j + 1} > 0 and n1 > 0 then greatest(0.1D, least({j} - 0.1D, {j} - {j + 1} * {y} * n{j + 1} / n{j})) else {j} - 0.5D end").alias(f"d{j}")
                for j in (1, 2, 3)
            ],
        )
        contexts = (
            counts.groupBy(*by, F.shiftrightunsigned("key", BITS).alias("context"))
            .agg(
                F.sum("a").cast("double").alias("total"),
                F.count_if(F.col("a") == 1).alias("t1"),
                F.count_if(F.col("a") == 2).alias("t2"),
                F.count_if(F.col("a") > 2).alias("t3"),
            )
            .join(F.broadcast(discount), by)  # a row for each language and half
            .select(*by, "context", "total", "d1", "d2", "d3", F.expr("(d1 * t1 + d2 * t2 + d3 * t3) / total").alias("left_over"))
        )
        now = targets[k].join(counts, [*by, "key"], "left").withColumn("context", F.shiftrightunsigned("key", BITS))
        now = now.join(contexts, [*by, "context"], "left")
        if lower is None:
            now = now.withColumn("low", F.lit(1.0 / (1 << BITS)))
        else:
            shorter = F.col("key").bitwiseAND(F.lit(_MASK[k - 1]))
            now = now.withColumn("shorter", shorter).join(lower.select(*by, F.col("key").alias("shorter"), F.col("p").alias("low")), [*by, "shorter"])
        own = "case when a is null then 0 when a = 1 then a - d1 when a = 2 then a - d2 else a - d3 end / total"
        above = stored(now.select(*by, "key", F.expr(f"case when total is null then low else {own} + left_over * low end").alias("p")), "p")
        drop_stored(*[x for x in (lower, counts, targets[k]) if x is not None and k < ORDER])
        lower = above
    return lower.select(*by, "key", F.log("p").cast("float").alias("logp"))


SCORE_SCHEMA = (
    "doc_id bigint, text_hash bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint,"
    " n_dup_lines bigint, n_repeat_words bigint, logp double, n_predicted bigint"
)


def _arrays(part: DataFrame) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """The sorted hash arrays of each language and half: keys, and their log probabilities."""
    table = part.select("lang", "half", "key", "logp").toArrow().combine_chunks()
    if not table.num_rows:
        return {}
    coded = table.column("lang").combine_chunks().dictionary_encode()
    names, halves = coded.dictionary.to_pylist(), table.column("half").to_numpy()
    keys, values = table.column("key").to_numpy(), table.column("logp").to_numpy()
    model = coded.indices.to_numpy() * 2 + halves
    out = {}
    for m in np.unique(model):
        own = np.flatnonzero(model == m)
        own = own[np.argsort(keys[own])]
        out[names[m // 2], int(m % 2)] = keys[own], values[own]
    return out


def score(slim: DataFrame, table: DataFrame) -> DataFrame:
    """Rule counts, summed log probabilities and numbers of predicted units of each document, stored.

    The arrays go to the workers PASS_GRAMS entries at a time. One pass is a map; further ones read the texts again
    and add up their partial sums by document (rows that repeat id, text and language have equal sums).
    """
    spark = slim.sparkSession
    passes = max(1, -(-table.count() // PASS_GRAMS))
    parts = []
    for k in range(passes):
        part = table if passes == 1 else table.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == k)
        arrays = spark.sparkContext.broadcast(_arrays(part))
        parts.append(stored(slim.mapInArrow(lean(_scorer(arrays, k == 0)), SCORE_SCHEMA), "scores"))
        arrays.destroy()
    if passes == 1:
        return parts[0]
    same = ["doc_id", "text_hash", "lang"]
    sums = None
    for part in parts[1:]:
        sums = part.select(*same, "logp") if sums is None else sums.unionByName(part.select(*same, "logp"))
    sums = sums.groupBy(*same).agg((F.avg("logp") * (passes - 1)).alias("more"))
    first = parts[0].alias("first")
    rest = sums.select(*[F.col(c).alias(f"{c}_") for c in same], "more")
    joined = first.join(rest, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & F.col("text_hash").eqNullSafe(F.col("text_hash_")) & (F.col("lang") == F.col("lang_")))
    return joined.withColumn("logp", F.col("logp") + F.col("more")).select(*parts[0].columns)


def _scorer(models: Broadcast, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, arrays = WordHashes(most=200_000), models.value
        for batch in _groups(batches):
            names = batch.schema.names
            doc_ids, text_hashes, langs, halves = (batch.column(names.index(c)) for c in ("doc_id", "text_hash", "lang", "half"))
            texts = text_bytes(batch.column(names.index("text")))
            split = [space_words(x) for x in texts]
            logp, predicted = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for model, which in _by_model(langs.to_pylist(), halves.to_pylist()).items():
                keys, lengths = spelled([split[k] for k in which])
                predicted[which] = lengths
                if len(keys) and model in arrays:
                    known, values = arrays[model]
                    at = np.searchsorted(known, keys)
                    at[at == len(known)] = 0
                    found = np.where(known[at] == keys, values[at], np.float32(0)).astype(np.float64)
                    logp[which] = np.bincount(np.repeat(np.arange(len(which)), lengths), found, len(which))
            counts = [rules(x, ws, hashes) for x, ws in zip(texts, split, strict=True)] if first else [(0, 0, 0, 0)] * len(texts)
            numbers = [pa.array([len(ws) for ws in split], pa.int64()), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]]
            columns = [doc_ids, text_hashes, langs, *numbers, pa.array(logp), pa.array(predicted)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORE_SCHEMA.split(",")])

    return run


def judge(scores: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """base_failed, log_perplexity and kept: inside the language's band around the median of documents that pass the rules."""
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rows = scores.withColumns({"base_failed": failed, "log_perplexity": -F.col("logp") / F.greatest("n_predicted", F.lit(1))})
    # copies count once: else a large group of them would make the spread 0
    passed = rows.where("not base_failed").groupBy("lang", "text_hash").agg(F.avg("log_perplexity").alias("log_perplexity"))
    medians = passed.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("middle"))
    spreads = (
        passed.join(F.broadcast(medians), "lang")  # a row for each language
        .groupBy("lang")
        .agg(
            F.first("middle").alias("middle"),
            F.count("*").alias("texts"),
            (1.4826 * F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")), 0.5, 10000)).alias("spread"),
        )
    )
    measured = (F.col("texts") >= MEASURED) & (F.col("spread") > 0)
    spreads = spreads.select(
        "lang",
        (F.col("middle") - F.when(measured, lower * F.col("spread")).otherwise(LEAST_LOWER)).alias("low_band"),
        (F.col("middle") + F.when(measured, upper * F.col("spread")).otherwise(LEAST_UPPER)).alias("high_band"),
    )
    inside = F.col("log_perplexity").between(F.col("low_band"), F.col("high_band"))
    bands = small_or_shuffled(stored(spreads, "bands"))  # a row for each language
    return rows.join(bands, "lang", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_hash: bool = False) -> DataFrame:
    """Per document row: n_words, the rule counts, base_failed, kept, log_perplexity, low_band, high_band (and text_hash, lang).

    Null and empty texts have no words and fail the rules. A null language is a language of its own. Null ids stay
    null (and fall into one half), repeated rows each get a row, other columns are not read, and an empty table gives
    an empty result. Where the other half has no text, all characters are equally likely.
    """
    slim = _slim(docs, id_col, text_col, lang_col)
    grams = stored(count_grams(slim), "grams")
    table = log_probabilities(grams)
    scores = score(slim, table)
    drop_stored(grams, table)
    return judge(scores).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "log_perplexity", "low_band", "high_band", *["text_hash", "lang"] * with_hash,
    )
