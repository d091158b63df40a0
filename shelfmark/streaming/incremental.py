"""Incremental runs: high-water marks, events counted once, batches applied once, and retention."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.keyed import apply_changes, stored
from ..staging import shared_dir, staged


def since(df: DataFrame, marks: DataFrame, group: list[str], at: str, now: Column | None = None, keep: str = "30 DAYS") -> DataFrame:
    """Rows at or after their group's mark (columns group and mark); groups without a mark are whole.

    With now, a mark that is older than it is kept has expired, as if there were none.
    """
    if now is not None:
        marks = marks.where(~expired(F.col("mark"), now, keep))
    return df.join(marks.select(*group, "mark"), group, "left").where(F.col("mark").isNull() | (F.col(at) >= F.col("mark"))).drop("mark")


def next_marks(df: DataFrame, marks: DataFrame, group: list[str], at: str) -> DataFrame:
    """The marks after a run over df: the latest time of each group."""
    seen = df.select(*group, F.col(at).alias("mark")).unionByName(marks.select(*group, "mark"))
    return seen.groupBy(*group).agg(F.max("mark").alias("mark"))


def debounced(df: DataFrame, key: list[str], at: str, within: str) -> DataFrame:
    """One row per key within the delay. On a stream, state older than the delay is dropped; on a batch all rows of a key count once."""
    return df.withWatermark(at, within).dropDuplicatesWithinWatermark(key) if df.isStreaming else df.dropDuplicates(key)


def starts(df: DataFrame, key: list[str], at: str, gap: str, tie: str) -> DataFrame:
    """Rows of a key that follow no other within the gap: the first of each burst."""
    before = F.lag(at).over(Window.partitionBy(*key).orderBy(at, tie))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(at) > F.col("_before") + F.expr(f"INTERVAL {gap}"))).drop("_before")


#: What a gate keeps of a key: when it was last passed or locked, in microseconds; null if it is open.
GATE_STATE = "closed_at long"


def _passes(kind: str | None, at: int, closed: int | None, ttl: int, inclusive: bool) -> tuple[bool, int | None]:
    """Whether an event passes a gate that was closed then, and when it is closed after it."""
    if kind == "done":
        return False, None
    free = closed is None or (at >= closed + ttl if inclusive else at > closed + ttl)
    return free, at if free else closed


def _gated(events: DataFrame, key: list[str], at: str, ttl: str, tie: str, kind: str | None, inclusive: bool) -> DataFrame:
    micros = int(events.sparkSession.sql(f"SELECT CAST(INTERVAL {ttl} AS INTERVAL DAY TO SECOND) AS i").first().i.total_seconds() * 1_000_000)
    when = F.unix_micros(F.col(at).cast("timestamp"))
    named = [F.col(c).alias(f"_key{k}") for k, c in enumerate(key)]
    rows = events.select("*", *named, when.alias("_at"), (F.col(kind) if kind else F.lit(None).cast("string")).alias("_kind"))
    names, out = [f"_key{k}" for k in range(len(key))], events.schema
    if events.isStreaming:

        def step(group, tables, state):
            (closed,) = state.get if state.exists else (None,)
            # A key's rows come in parts, cut anywhere, in no order.
            table, keep = pd.concat(list(tables), ignore_index=True).sort_values(["_at", tie]), []
            for now, what in zip(table["_at"].tolist(), table["_kind"].tolist()):
                ok, closed = _passes(what, now, closed, micros, inclusive)
                keep.append(ok)
            yield table.loc[keep, out.names]
            if closed is None:
                if state.exists:
                    state.remove()
            else:
                state.update((closed,))
                state.setTimeoutTimestamp(max(closed + micros, state.getCurrentWatermarkMs() * 1000) // 1000 + 1)

        def expiring(group, tables, state):
            if state.hasTimedOut:
                state.remove()
                return
            yield from step(group, tables, state)

        return rows.groupBy(*names).applyInPandasWithState(expiring, out, GATE_STATE, "append", "EventTimeTimeout")

    def run(batches):
        before, closed = None, None
        for batch in batches:
            keep = []
            for now, what, *own in zip(*(batch[c].to_pylist() for c in ("_at", "_kind", *names))):
                if own != before:
                    before, closed = own, None
                ok, closed = _passes(what, now, closed, micros, inclusive)
                keep.append(ok)
            yield batch.filter(pa.array(keep, pa.bool_())).select(out.names)

    return rows.repartition(*names).sortWithinPartitions(*names, "_at", tie).mapInArrow(run, out)


def posts(events: DataFrame, key: list[str], at: str, timeout: str, tie: str) -> DataFrame:
    """Events that are posted: those later than the timeout after the last that was posted of their key.

    Batches are read in order of key, time and tie, with the time of one key's last post in memory, however many events
    it has. On a stream, which needs a watermark, that time is the key's state, and is dropped once it cannot suppress; a
    key's events of one micro-batch are put into order in memory, and events under the watermark are dropped.
    """
    return _gated(events, key, at, timeout, tie, None, False)


def admitted(events: DataFrame, key: list[str], at: str, kind: str, ttl: str, tie: str) -> DataFrame:
    """Requests that are admitted: those of a key that has no lock. A request that is admitted locks its key until an
    event of kind ``done`` or until the lock is as old as it may be. Batches and streams as for posts()."""
    return _gated(events, key, at, ttl, tie, kind, True)


def bursts(df: DataFrame, key: list[str], at: str, gap: str) -> DataFrame:
    """(key, start, end, n): rows of a key with less than the gap between them, as session windows; a stream needs a watermark."""
    grouped = df.groupBy(*key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def expired(at: Column, now: Column, keep: str) -> Column:
    """Whether a row is older than it is kept."""
    return at < now - F.expr(f"INTERVAL {keep}")


def file_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int | None = 100) -> DataFrame:
    """A stream of a folder's Parquet files whose names match, as they come, so many in a batch (all, if None); the path may be a pattern."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def apply_once(stream: DataFrame, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Apply a step to each micro-batch of what has come so far, and write its rows under the batch's number.

    A batch that is run again after a failure overwrites its own folder, so its rows are there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Pages that are written by one job, after which a mark is set.
LAP = 1_000


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """df with _row, its place in the order of a unique key, from 0: ranges of keys are numbered each by itself, after those before."""
    ranges = staged(df.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # of a row per range
    starts = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranges.join(F.broadcast(starts), "_range").withColumn("_row", F.col("_start") + place - 1).drop("_range", "_start")


def cursor_pages(df: DataFrame, key: str, rows: int, step: Callable[[DataFrame], DataFrame], target: str, at: Column | None = None, keep: str = "30 DAYS", pages: int | None = None, pause: float = 0.0) -> int:
    """Apply a step to df in pages, so many rows each in the order of a unique key, from where the last run ended; how many pages.

    A run numbers the rows after the mark once, and goes through their pages in laps of LAP, one by one if there is a pause (in seconds)
    between them. The step gets the rows of a lap with the number of their page in column page, which it keeps. They are
    written under ``page=n`` in target/rows, then the lap's last page and key are marked in target/marks. A run that is lost in between
    writes its lap again, so each row is there once, and rows that have come after the mark in the meantime are taken up next
    time. Marks that are older than they are kept have expired, and the run begins anew. With pages, a run ends after so many.
    """
    spark = df.sparkSession
    marks = f"{target.rstrip('/')}/marks"
    now = at if at is not None else F.current_timestamp()
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("last", kind), T.StructField("marked_at", T.TimestampType())])
    known = stored(spark, marks, schema).where(~expired(F.col("marked_at"), now, keep))
    mark = known.agg(F.max("n").alias("n"), F.max_by("last", "n").alias("last")).first()
    left, first = (df, 0) if mark.n is None else (df.where(F.col(key) > F.lit(mark.last)), mark.n + 1)
    if pages is not None:
        left = left.orderBy(key).limit(rows * pages)
    page = F.lit(first) + F.floor(F.col("_row") / rows)
    left = _numbered(left, key).withColumn("page", page.cast("long")).withColumn("_lap", F.floor((F.col("page") - first) / (1 if pause else LAP)))
    at_laps = f"{shared_dir(spark)}/shelfmark/{uuid.uuid4().hex}/laps"
    left.drop("_row").write.partitionBy("_lap").parquet(at_laps)
    whole = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("page", T.LongType()), T.StructField("_lap", T.LongType())])).parquet(at_laps)
    laps = sorted(whole.groupBy("_lap").agg(F.max("page").alias("n"), F.max(key).alias("last")).collect())  # one row for LAP pages
    for lap, n, last in laps:
        out = step(whole.where(F.col("_lap") == lap).drop("_lap"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("page").parquet(f"{target.rstrip('/')}/rows")
        row = spark.createDataFrame([(n, last)], T.StructType(schema.fields[:2])).withColumn("marked_at", now)
        apply_changes(marks, row, ["n"], uuid.uuid4().hex, buckets=1)
        time.sleep(pause)
    return laps[-1][1] + 1 - first if laps else 0
