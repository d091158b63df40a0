"""Stored tables that take changes by key: only the hash buckets that a change falls into are written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET, BUCKETS = "_bucket", 64


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    system, at = _file_system(spark, path)
    return system.exists(at)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a stored table; none if there is no table yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path).drop(BUCKET)


def apply_changes(path: str, changes: DataFrame, key: list[str], run_id: str, gone: Column | None = None, buckets: int = BUCKETS) -> bool:
    """Put changes into the table at path: rows replace those with their key, and those of which gone holds take them out.

    Returns whether anything was done: a run whose id was applied before does nothing, so a job may be started again.
    Changes have the table's columns and each key once (nulls are a key like others). The rows of the buckets that
    change are put together in a folder of the run first and then replace those buckets alone; a run that was
    lost on the way is finished from that folder, which by then may be all that has them. Buckets are hashes of keys, so
    none is much larger than others; a table keeps their number for good. One run writes a table at a time.
    """
    spark, schema = changes.sparkSession, changes.schema
    own = f"{path.rstrip('/')}/_runs/{run_id}"
    if _exists(spark, f"{own}/done"):
        return False
    bucket = F.pmod(F.hash(*key), F.lit(buckets)).alias(BUCKET)
    full = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    touched = changes.select(bucket).distinct()
    if not _exists(spark, f"{own}/rows/_SUCCESS"):
        leaves = F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)
        there = _exists(spark, path) and any(s.getPath().getName().startswith(f"{BUCKET}=") for s in _file_system(spark, path)[0].listStatus(_file_system(spark, path)[1]))
        rows = changes.where(~leaves).select("*", bucket)
        if there:
            # The buckets' numbers are at most so many; they prune the folders that are read.
            old = spark.read.schema(full).parquet(path).join(F.broadcast(touched), BUCKET, "left_semi")
            new = changes.select(*[F.col(c).alias(f"_{c}") for c in key])
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
            condition = same[0]
            for c in same[1:]:
                condition = condition & c
            rows = rows.unionByName(old.join(new, condition, "left_anti"))
        rows.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{own}/rows")
        touched.coalesce(1).write.mode("overwrite").parquet(f"{own}/touched")
    merged = spark.read.schema(full).parquet(f"{own}/rows")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    filled = {r[0] for r in merged.select(BUCKET).distinct().collect()}  # of BUCKETS at most
    for (number,) in spark.read.parquet(f"{own}/touched").collect():
        if number not in filled:
            system, at = _file_system(spark, f"{path.rstrip('/')}/{BUCKET}={number}")
            system.delete(at, True)
    system, at = _file_system(spark, f"{own}/done")
    system.create(at, True).close()
    system.delete(_file_system(spark, f"{own}/rows")[1], True)
    return True
