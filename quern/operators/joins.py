"""Joins that broadcast only what has been counted, and tables written where every executor sees them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a few dozen bytes that may be broadcast.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be at most `rows` rows, else as it is (a shuffled join).

    df is run for the count: give it a table, or what cut() has written.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """small(cut(df)) with one job: rows are counted as they are written."""
    counted = Observation()
    out = cut(df.observe(counted, F.count(F.lit(1)).alias("n")))
    return F.broadcast(out) if counted.get["n"] <= rows else out


def new_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = known.get()
    return f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written below spark.checkpoint.dir: what follows reads them, however often, and never computes them again."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_there(table: DataFrame) -> bool:
    """Whether the files of a table that cut() has written still exist."""
    spark = table.sparkSession
    return all(
        (at := spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) for f in table.inputFiles()[:1]
    )
