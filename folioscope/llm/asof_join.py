"""Tolerant as-of join: the latest right row at or before each left row of the same key, in two levels.

Left rows and the right side's summaries (one a key and time) are dealt out together by ranges of key, time and id, so that
a key of any size is cut into buckets of about equal size. A bucket is a sorted stream: a left row takes the last summary of
its key there. The latest summary of each bucket's last key is carried on: a prefix maximum over buckets, by key, gives what
precedes a bucket, and left rows that found nothing in their own bucket take it by an equi-join on key and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, stored

#: What an order is matched within, and what times of every other id are floored to, in microseconds.
TOLERANCE_US = 720 * 3_600_000_000
COARSE_US = 6 * 3_600_000_000

#: found_*: the summary that a left row found; open: it may have one in an earlier bucket. A row that isn't is_left carries a bucket's latest summary.
_FOUND = "id bigint, key bigint, at bigint, is_left boolean, open boolean, bucket int, found_at bigint, value bigint, tie bigint, n bigint"


def _own_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Left rows with the last summary of their key in this bucket, and the latest summary of the bucket's last key."""
    bucket = TaskContext.get().partitionId()
    first_key = carried = None  # carried: key, at, value, tie, n of the latest summary so far
    last_key = None

    def column(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
        values = batch.column(k)
        return values.fill_null(0).to_numpy(), values.is_valid().to_numpy(zero_copy_only=False)

    for batch in batches:
        (key, has_key), (at, _), (value, has_value), (tie, has_tie), (n, _) = (column(batch, k) for k in (0, 1, 4, 5, 6))
        left = batch.column(2).to_numpy(zero_copy_only=False)
        if first_key is None and has_key.any():
            first_key = int(key[has_key.argmax()])
        # row 0 is the latest summary of the batches before
        before = carried or (0, 0, None, None, 0)
        joined = lambda column, k, kind=np.int64: np.r_[kind(before[k] or 0), column]  # noqa: B023, E731
        s_key, s_at, s_value, s_tie, s_n = joined(key, 0), joined(at, 1), joined(value, 2), joined(tie, 3), joined(n, 4)
        s_has_value, s_has_tie = np.r_[before[2] is not None, has_value], np.r_[before[3] is not None, has_tie]
        latest = np.maximum.accumulate(np.where(left, 0, np.arange(1, len(left) + 1)))
        found = left & has_key & ((latest > 0) | (carried is not None)) & (s_key[latest] == key)
        pick, rows = latest[left], found[left]
        wanted = np.flatnonzero(left)
        if len(wanted):
            nullable = lambda a, valid: pa.array(a, pa.int64(), mask=~(rows & valid))  # noqa: B023, E731
            take = pa.array(wanted)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(3).take(take), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.ones(len(wanted), bool)),
                    pa.array(~rows & has_key[wanted] & (key[wanted] == (0 if first_key is None else first_key))), pa.array(np.full(len(wanted), bucket, np.int32)),
                    nullable(s_at[pick], True), nullable(s_value[pick], s_has_value[pick]), nullable(s_tie[pick], s_has_tie[pick]), nullable(s_n[pick], True),
                ],
                names=[f.split()[0] for f in _FOUND.split(", ")],
            )
        if len(key):
            last_key = int(key[-1]) if has_key[-1] else None
            if k := int(latest[-1]):
                carried = (int(s_key[k]), int(s_at[k]), int(s_value[k]) if s_has_value[k] else None, int(s_tie[k]) if s_has_tie[k] else None, int(s_n[k]))
    if carried is not None and carried[0] == last_key:
        row = [None, carried[0], None, False, False, bucket, *carried[1:]]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[f.split()[0] for f in _FOUND.split(", ")])


def latest_before(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """id, key, at of every left row, and found_at, value, tie, n of the latest right rows of its key in [at - tolerance, at].

    left: id, key, at; right: key, at, value, tie; all bigint. Of right rows at the same time, that with the larger value,
    then the larger tie is taken, null loses; n counts all of them (0 where none is found). Null keys and times match
    nothing; repeated left rows give a row each; an empty side gives no matches. A key of any size, and times that many
    rows share, are cut between buckets by id; right rows are folded by key and time before they are dealt out.
    """
    points = right.where("key is not null and at is not null").groupBy("key", "at").agg(F.max(F.struct("value", "tie")).alias("best"), F.count("*").alias("n"))
    points = points.select("key", "at", F.lit(False).alias("is_left"), F.lit(None).cast("bigint").alias("id"), "best.value", "best.tie", "n")
    null = F.lit(None).cast("bigint")
    # a left row without a time comes first in its key, where it finds nothing
    asked = left.select("key", "at", F.lit(True).alias("is_left"), "id", null.alias("value"), null.alias("tie"), null.alias("n"))
    order = ["key", "at", "is_left", "id"]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = points.unionByName(asked).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = stored(stream.mapInArrow(lean(_own_bucket), _FOUND), "as-of-buckets")

    summary = F.struct(F.col("found_at").alias("at"), "value", "tie", "n")
    summaries = rows.where("not is_left").select("key", "bucket", summary.alias("latest"))
    waiting = rows.where("is_left and open")
    entries = summaries.unionByName(waiting.select("key", "bucket", F.lit(None).alias("latest")).distinct(), allowMissingColumns=True)
    entries = entries.groupBy("key", "bucket").agg(F.max("latest").alias("latest"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = entries.withColumn("carried", F.max("latest").over(earlier)).where("carried is not null").select("key", "bucket", "carried.*")
    late = waiting.drop("found_at", "value", "tie", "n").hint("merge").join(carried.withColumnRenamed("at", "found_at"), ["key", "bucket"], "left")

    found = rows.where("is_left and not open").unionByName(late)
    near = F.col("found_at").isNotNull() & (F.col("at") - F.col("found_at") <= tolerance)
    taken = [F.when(near, F.col(c)).alias(c) for c in ("found_at", "value", "tie")]
    return found.select("id", "key", "at", *taken, F.when(near, F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("n"))


def microseconds(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone counts as UTC, whatever the session's zone."""
    at = df[name]
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(at.cast("timestamp"))
    seconds = F.unix_date(at.cast("date")).cast("bigint") * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("bigint")


def _checksum(number: Column) -> Column:
    return F.crc32(number.cast("string").cast("binary"))


def _coarse(at: Column, checksum: Column, width: int) -> Column:
    return F.when(checksum % 2 == 1, at - F.pmod(at, F.lit(width))).otherwise(at)


def match_orders(clicks: DataFrame, sales: DataFrame, tolerance: int = TOLERANCE_US) -> DataFrame:
    """Each click's latest order: click_id, client_id, ts_us, sale_id, lag_us, total_cents, n_tied.

    Of copies of a click_id one counts (their least time and least client, should they differ; null ids are one click);
    repeated sales are orders each. Times of ids with an odd checksum are floored to six hours; sales whose checksum isn't
    divisible by 3 give a second order. Null clients and times match nothing (n_tied 0), null totals and those that are
    no finite number lose ties. Empty tables give no rows or no matches. Other columns are not read.
    """
    times = clicks.select(clicks["click_id"].cast("bigint").alias("id"), clicks["client_id"].cast("bigint").alias("key"), microseconds(clicks, "ts").alias("at"))
    left = times.groupBy("id").agg(F.min("key").alias("key"), F.min("at").alias("at"))
    left = left.withColumn("at", _coarse(F.col("at"), _checksum(F.col("id")), COARSE_US))
    total = sales["total"].cast("double")
    finite = ~F.isnan(total) & (F.abs(total) < 9e16)
    orders = sales.select(sales["sale_id"].cast("bigint").alias("sale_id"), sales["client_id"].cast("bigint").alias("key"), microseconds(sales, "sold_at").alias("at"), F.when(finite, F.floor(100 * total + 0.5)).cast("bigint").alias("value"))
    orders = orders.withColumn("checksum", _checksum(F.col("sale_id")))
    ids = F.when(F.col("checksum") % 3 != 0, F.array(F.col("sale_id"), -1 - F.col("sale_id"))).otherwise(F.array("sale_id"))
    right = orders.select("key", _coarse(F.col("at"), F.col("checksum"), COARSE_US).alias("at"), "value", F.explode(ids).alias("tie"))
    found = latest_before(left, right, tolerance)
    return found.select(
        F.col("id").alias("click_id"), F.col("key").alias("client_id"), F.col("at").alias("ts_us"), F.col("tie").alias("sale_id"),
        (F.col("at") - F.col("found_at")).alias("lag_us"), F.col("value").alias("total_cents"), F.col("n").alias("n_tied"),
    )
