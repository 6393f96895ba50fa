"""Where operators cut their lineage: the shared folder of spark.checkpoint.dir, written once and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_written: "weakref.WeakKeyDictionary[SparkSession, list[str]]" = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own, but only if there are no other machines to share it with."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back; deleted when the program ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folioscope/{name}-{uuid.uuid4().hex}"
    if spark not in _written:
        _written[spark] = []
        atexit.register(_release, weakref.ref(spark))
    _written[spark].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete the files of frames that stored() gave, once nothing that is still to run reads them."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            for path in [p for p in _written.get(spark, ()) if p.rpartition("/")[2] == folder.rpartition("/")[2]]:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
                _written[spark].remove(path)


def _release(ref) -> None:
    spark = ref()
    try:
        if spark is not None and not spark._jsc.sc().isStopped():
            for path in _written.pop(spark, []):
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the gateway may be gone when the interpreter ends
        pass


def dealt_out(df: DataFrame, key: str) -> DataFrame:
    """df, dealt out by key where its files make fewer partitions than there are cores (small tables in one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def by_key(df: DataFrame, *keys: str, times: int = 1, least: int = 1) -> DataFrame:
    """df, dealt out by keys in a fixed number of partitions: what groups by these and other columns is not shuffled again.

    ``least``: partitions at least, where their number has to follow the size of an input.
    """
    spark = df.sparkSession
    return df.repartition(max(least, times * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))), *keys)
