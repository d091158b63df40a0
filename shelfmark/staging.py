"""The shared folder and tables staged in it, which keep plans short and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a part, about.
PART = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only in local mode, as in tests, an unset one is made here."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="shelfmark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, and lost executors cost no recomputation.

    The files stay until clear() is called, since the results that read them are lazy.
    """
    path = f"{shared_dir(df.sparkSession)}/shelfmark/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *on: str) -> DataFrame:
    """df dealt out by columns for an operation on rows of equal values, of so many rows as are given: in parts of PART rows or
    so where the session's number of partitions would make larger ones, so that a task's memory does not grow with a table.
    The number of more than one part is given to Spark, which else joins parts by their packed bytes, whatever their rows."""
    many = -(-rows // PART)
    return df.repartition(max(many, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *on) if many > 1 else df.repartition(*on)


def clear(spark: SparkSession) -> bool:
    """Remove all staged tables of the shared folder, once no result that reads them is needed; whether there were any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/shelfmark")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
