"""Training-order materialisation: packed token sequences in a keyed pseudo-random global order, as fixed-stride shards.

Documents are encoded, each closed by an end token, and packed into sequences of a fixed length. A keyed Feistel
permutation of 0 .. N-1 (cycle-walking where the power of four above N overshoots) gives each sequence its slot; a
shard holds a range of slots, each at slot * stride: a reader goes on from any slot with one seek.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import read_ranks
from .shared import drop_stored, lean, mix, new_path, stored

#: Tokens of a sequence, sequences of a shard, rounds of the permutation.
LENGTH, PER_SHARD, ROUNDS = 1024, 8192, 6
#: Bytes of shards that one writing task makes, and its shards at least: so writing tasks grow with the data, not with the shards.
TASK_BYTES = 256 << 20
#: Documents whose tokens are counted to pack payloads tightly (how well they are packed changes no result), and the level.
PACKING_SAMPLE, LEVEL = 400, 6


class Packing:
    """Payloads for the way through the shuffle: ids by how common they are, high and low bytes apart, compressed."""

    def __init__(self, common: list[int]):
        rest = np.ones(1 << 16, bool)
        rest[common] = False
        self.id_of = np.concatenate([np.array(common, np.int64), np.flatnonzero(rest)]).astype(np.uint16)
        self.place = np.empty(1 << 16, np.uint16)
        self.place[self.id_of] = np.arange(1 << 16, dtype=np.uint16)
        self._in = self._out = None

    def __getstate__(self):
        return {"id_of": self.id_of, "place": self.place, "_in": None, "_out": None}

    def pack(self, ids: np.ndarray) -> bytes:
        import zstandard

        self._in = self._in or zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        return self._in.compress(self.place[ids].view(np.uint8).reshape(-1, 2)[:, ::-1].T.tobytes())

    def unpack(self, blob: bytes) -> np.ndarray:
        import zstandard

        self._out = self._out or zstandard.ZstdDecompressor()
        planes = np.frombuffer(self._out.decompress(blob), np.uint8).reshape(2, -1)
        return self.id_of[planes[0].astype(np.uint16) << 8 | planes[1]]


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The slot of each of the ordinals x among 0 .. n-1, or the ordinal of each slot: a bijection for every key."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    seeds = [mix(np.array([(key * 0x9E3779B97F4A7C15 + r + 1) & (2**64 - 1)], np.uint64))[0] for r in range(ROUNDS)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        if inverse:
            for seed in reversed(seeds):
                left, right = right ^ (mix(left ^ seed) & mask), left
        else:
            for seed in seeds:
                left, right = right, left ^ (mix(right ^ seed) & mask)
        return left << shift | right

    out = once(np.asarray(x, np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def common_tokens(docs: DataFrame, vocabulary: str, pattern: str, most: int = PACKING_SAMPLE) -> list[int]:
    """The ids that stand in the first ``most`` documents, the most common first."""
    import tiktoken

    codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={token: rank for rank, token in enumerate(read_ranks(vocabulary))}, special_tokens={})
    counts = np.zeros(1 << 16, np.int64)
    for row in docs.select(docs["text"].cast("string").alias("text")).limit(most).collect():
        counts += np.bincount(codec.encode_ordinary(row["text"] or ""), minlength=1 << 16)
    order = np.argsort(-counts, kind="stable")
    return order[counts[order] > 0].tolist()


def sequences(docs: DataFrame, vocabulary: str, pattern: str, length: int = LENGTH, packing: Packing | None = None) -> DataFrame:
    """part, seq, n_tokens, doc_ids, payload (packed 16-bit ids, filled up with the end token): one map, no shuffle.

    Sequences follow the documents as the table's scan gives them; ``part`` is the scan's partition.
    """
    packing = packing or Packing([])
    tokens = read_ranks(vocabulary)
    end = len(tokens)
    if end >= 1 << 16:
        raise ValueError("ids must fit into 16 bits")
    ranks = {token: rank for rank, token in enumerate(tokens)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        part, seq = TaskContext.get().partitionId(), 0
        held, ids, n = [], [], 0  # ids: (first token's place among those held, doc_id)

        def packed(last: bool) -> pa.RecordBatch:
            nonlocal held, ids, n, seq
            stream = np.concatenate(held) if held else np.zeros(0, np.uint16)
            whole = -(-len(stream) // length) if last else len(stream) // length
            starts, names = np.array([s for s, _ in ids], np.int64), [i for _, i in ids]
            rows = []
            for k in range(whole):
                piece = stream[k * length : (k + 1) * length]
                lo = max(int(np.searchsorted(starts, k * length, "right")) - 1, 0)
                hi = int(np.searchsorted(starts, k * length + len(piece), "left"))
                full = np.concatenate([piece, np.full(length - len(piece), end, np.uint16)])
                rows.append((part, seq + k, len(piece), names[lo:hi], packing.pack(full)))
            seq += whole
            rest = stream[whole * length :]
            open_at = max(int(np.searchsorted(starts, whole * length, "right")) - 1, 0)
            ids = [(max(s - whole * length, 0), i) for s, i in ids[open_at:]] if len(rest) else []
            held, n = ([rest], len(rest)) if len(rest) else ([], 0)
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["part", "seq", "n_tokens", "doc_ids", "payload"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                coded = codec.encode_to_numpy(text or "", disallowed_special=()).astype(np.uint16)
                ids.append((n, doc_id))
                held += [coded, np.array([end], np.uint16)]
                n += len(coded) + 1
                if n > 1_000_000:
                    yield packed(False)
        yield packed(True)

    slim = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return slim.mapInArrow(lean(run), "part int, seq bigint, n_tokens int, doc_ids array<bigint>, payload binary")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _drop_unfinished(system, root: str) -> None:
    """Remove what attempts have left that ended with their executor."""
    from pyarrow import fs

    for found in system.get_file_info(fs.FileSelector(root)):
        if found.base_name.startswith("_"):
            system.delete_file(found.path)


def materialise(
    docs: DataFrame, vocabulary: str, pattern: str, key: int, path: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD
) -> DataFrame:
    """Write the shards and return their manifest: slot, shard, byte_offset, ordinal, n_tokens, doc_ids, sha256.

    One row for each sequence. A task writes a range of consecutive shards, each to a name of its own that is then
    renamed, so a repeated task leaves the same files; what a failed one leaves is removed. The ordinal of a sequence
    follows the order of the table's scan: the same files read with the same splits give the same shards, other splits
    another packing of the same tokens. Null texts count as empty (an end token alone); null ids stay null among
    doc_ids; repeated rows are packed each; other columns are not read; an empty table gives no shard and no row.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "shards")
    packing = Packing(common_tokens(docs, vocabulary, pattern))
    rows = stored(sequences(docs, vocabulary, pattern, length, packing), "sequences")
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg((F.max("seq") + 1).alias("n")).collect())  # a row a task
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n

    @F.pandas_udf("bigint")
    def slot(ordinal: pd.Series) -> pd.Series:
        return pd.Series(permute(ordinal.to_numpy(), total, key))

    starts = spark.createDataFrame(offsets, "part int, start bigint")
    shards, stride = -(-total // per_shard), 2 * length
    tasks = max(1, min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * stride // TASK_BYTES)))
    ordered = (
        rows.join(F.broadcast(starts), "part")
        .withColumn("ordinal", F.col("start") + F.col("seq"))
        .withColumn("slot", slot("ordinal"))
        .withColumn("shard", F.expr(f"cast(slot div {per_shard} as int)"))
        .select("shard", "slot", "ordinal", "n_tokens", "doc_ids", "payload")
        .repartitionByRange(tasks, "shard")
        .sortWithinPartitions("slot")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = _filesystem(path)
        system.create_dir(root, recursive=True)
        mark = f"{TaskContext.get().taskAttemptId()}"
        out, now = None, None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                system.move(f"{root}/_{now}-{mark}", f"{root}/shard-{now:06d}.bin")
                out = None

        try:
            for batch in batches:
                names = batch.schema.names
                hashes = []
                for shard, blob in zip(batch.column(0).to_pylist(), batch.column(names.index("payload")).to_pylist(), strict=True):
                    if shard != now:
                        close()
                        now = shard
                        out = system.open_output_stream(f"{root}/_{now}-{mark}")
                    raw = packing.unpack(blob).tobytes()
                    out.write(raw)
                    hashes.append(sha256(raw).hexdigest())
                offset = [(s % per_shard) * stride for s in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), batch.column(0), pa.array(offset, pa.int64()), *[batch.column(k) for k in (2, 3, 4)], pa.array(hashes, pa.string())],
                    names=["slot", "shard", "byte_offset", "ordinal", "n_tokens", "doc_ids", "sha256"],
                )
            close()
        finally:
            if out is not None:
                out.close()
                system.delete_file(f"{root}/_{now}-{mark}")

    schema = "slot bigint, shard int, byte_offset bigint, ordinal bigint, n_tokens int, doc_ids array<bigint>, sha256 string"
    manifest = stored(ordered.mapInArrow(lean(write), schema), "manifest")
    drop_stored(rows)
    system, root = _filesystem(path)
    system.create_dir(root, recursive=True)
    _drop_unfinished(system, root)
    with system.open_output_stream(f"{root}/layout.json") as out:
        out.write(json.dumps({"sequences": total, "length": length, "per_shard": per_shard, "stride": stride, "key": key}).encode())
    return manifest


def read(path: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """The sequences of slots start .. stop-1, in order: one open file at a time, one seek at the start."""
    system, root = _filesystem(path)
    with system.open_input_stream(f"{root}/layout.json") as f:
        layout = json.loads(f.read())
    stop = layout["sequences"] if stop is None else min(stop, layout["sequences"])
    at = start
    while at < stop:
        shard, first = divmod(at, layout["per_shard"])
        with system.open_input_file(os.path.join(root, f"shard-{shard:06d}.bin")) as f:
            f.seek(first * layout["stride"])
            for _ in range(min(stop - at, layout["per_shard"] - first)):
                yield np.frombuffer(f.read(layout["stride"]), np.uint16)
                at += 1


def order(spark: SparkSession, n: int, key: int) -> DataFrame:
    """ordinal and slot of all of 0 .. n-1."""

    @F.pandas_udf("bigint")
    def slot(ordinal: pd.Series) -> pd.Series:
        return pd.Series(permute(ordinal.to_numpy(), n, key))

    return spark.range(n).select(F.col("id").alias("ordinal"), slot("id").alias("slot"))
