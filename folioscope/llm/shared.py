"""Helpers that the operators of this subpackage share: shared storage, word splitting and 64-bit word hashes."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids or hashes up to which a side of a join is sent to all executors (some 4 MB, 16 MB as a hash table).
BROADCAST_ROWS = 250_000

#: Rows an operator has written to shared storage, by session, so that release() can drop them.
_written: "weakref.WeakKeyDictionary[SparkSession, list[str]]" = weakref.WeakKeyDictionary()

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
#: Lower-cases A-Z and turns every ASCII byte other than 0-9 and a-z into a space.
ALNUM_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
LOWER_TABLE = bytes.maketrans(_UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, one of our own, but only in a local run."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/folioscope/{name}-{uuid.uuid4().hex}"
    if spark not in _written:
        _written[spark] = []
        atexit.register(_quiet_release, weakref.ref(spark))
    _written[spark].append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: a lineage cut that outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Delete the files of frames that stored() gave, once nothing that is still to run reads them."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            own = [p for p in _written.get(spark, ()) if path.endswith(p.partition(":")[2].lstrip("/") or p)]
            if own:
                delete(spark, own[0])
                _written[spark].remove(own[0])
    if frames:
        free_shuffles(frames[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of plans that have run and are stored: the driver drops what it holds of them.

    Without it they stay until the driver happens to collect its garbage.
    """
    gc.collect()
    spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_or_shuffled(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast where it has at most ``most`` rows; else as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def release(spark: SparkSession) -> None:
    """Delete what stored() has written so far. Call it only when no DataFrame that reads it is still to be run."""
    for path in _written.pop(spark, []):
        delete(spark, path)


def _quiet_release(ref) -> None:
    spark = ref()
    try:
        if spark is not None and spark._jsc.sc().isStopped() is False:
            release(spark)
    except Exception:  # the gateway may be gone when the interpreter ends
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow: a worker that has ended a task gives its memory back before it waits for the next one."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased; none for null."""
    return text.translate(ALNUM_TABLE).split() if text else []


def space_words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ (what bytes.split() splits), A-Z lower-cased on demand; none for null."""
    if not text:
        return []
    return (text.translate(LOWER_TABLE) if lower else text).split()


class WordHashes(dict):
    """Word to 64-bit hash, remembered; trim() bounds what is remembered."""

    def __init__(self, seed: int = 0, most: int = 1_000_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
        if len(self) > self.most:
            self.clear()
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
