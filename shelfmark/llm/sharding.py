"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import staged


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; with one more shard, keys move only into it.

    A key jumps through the shard counts at which it would move; its shard is the last jump below shards.
    """
    state = keys.astype(np.uint64)
    shard = np.zeros(len(keys), np.int64)
    open_, b = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    while len(open_):
        state[open_] = state[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        shard[open_] = b
        after = (b + 1) * (float(1 << 31) / ((state[open_] >> np.uint64(33)).astype(np.float64) + 1))
        b = np.minimum(after, shards).astype(np.int64)
        open_, b = open_[b < shards], b[b < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """A column with the shard of a long column of keys."""

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return run(key)


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row, by the law ``key``.

    size is the UTF-8 bytes of the text plus 1; a null text has size 1 and the checksum of nothing, 0. A null id is a
    key of its own; repeated ids share a shard and each has its slot. Slots count from 0 within a shard in the order
    of ids (null first), ties by checksum, without gaps. The text is read once and never shuffled. No documents give no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"),
    )
    rows = rows.select("id", "size", "crc", shard_of(F.col("key"), shards).alias("shard"), shard_of(F.col("key"), shards + 1).alias("grown"))
    rows = staged(rows.withColumn("tie", F.monotonically_increasing_id()), "rows")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges of ids, ties dealt too, so that a repeated id is not one range; their counts give where slots start.
    ranged = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), "crc", "tie").withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "ranged")
    counts = ranged.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))  # ranges x shards rows
    order = Window.partitionBy("shard", "part").orderBy(F.col("id").asc_nulls_first(), "crc", "tie")
    out = ranged.withColumn("own", F.row_number().over(order)).join(F.broadcast(starts), ["shard", "part"])
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        (F.col("at") + F.col("own") - 1).alias("slot"), F.col("grown").alias("grown_shard"),
    )
