"""What the operators of this subpackage share: tables, shared folders, checked broadcasts, ASCII folding."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of the contracts: the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few dozen bytes that may be broadcast: at most some 30 MB.
BROADCAST_ROWS = 500_000
#: Groups with more than one of so many rows are joined by broadcast: there are fewer of them than this.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which every executor sees. Without that setting there is none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = known.get()
    return f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"


class Folders:
    """What cut() writes while this is the owner. Each block of owned() has one of its own, and so does each thread."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def only(self, *frames: DataFrame) -> None:
        """Deletes all but what frames read."""
        files = [f for df in frames for f in df.inputFiles()] if self.paths else []
        kept = [p for p in self.paths if any(f"/{p.rpartition('/')[2]}/" in f for f in files)]
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            if path not in kept:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)
        self.paths[:] = kept


_OWNER: ContextVar[Folders | None] = ContextVar("owner", default=None)


def hold(path: str) -> str:
    """path, which now belongs to the owner."""
    if (own := _OWNER.get()) is not None:
        own.paths.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: its lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = hold(shared_folder(spark))
    df.write.option("compression", "zstd").parquet(path)  # texts take half the disk that they would otherwise
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def owned(spark: SparkSession) -> Iterator[Folders]:
    """The owner of what cut() writes in the block. After an error all of it goes; else what only() has left stays, with the block around this as its owner, if there is one."""
    own, outer = Folders(spark), _OWNER.get()
    token = _OWNER.set(own)
    try:
        yield own
    except BaseException:
        own.only()
        raise
    finally:
        _OWNER.reset(token)
        if outer is not None:
            outer.paths += own.paths


def tidy(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A step (spark, ...) after which only those folders are left that its result reads: these stay for as long as somebody may read it."""

    @wraps(step)
    def run(spark: SparkSession, *args) -> DataFrame:
        with owned(spark) as own:
            out = step(spark, *args)
            own.only(out)
            return out

    return run


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be at most `rows` rows, else as it is (a shuffled join).

    df is run for the count: give it what cut() has written.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def column(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def whole_row(names: list[str]) -> Column:
    """These columns as one struct, to go through Python and be taken apart by parts()."""
    return F.struct(*map(column, names))


def parts(names: list[str], whole: str = "whole") -> list[Column]:
    return [F.col(whole).getField(c).alias(c) for c in names]


def fields(df: DataFrame, names: list[str], more: str) -> T.StructType:
    """The schema of columns of df and then those of `more`, in DDL."""
    return T.StructType([df.schema[c] for c in names] + T.StructType.fromDDL(more).fields)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many "_" behind it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """rows left-joined to groups, of which each key has one row; its column `size` counts the rows with that key.

    Groups of more than a HOT_SHARE-th of all rows, fewer than HOT_SHARE of them, are broadcast, and their rows stay where
    they are; so no task of the shuffled join gets a key with more rows than that. Both sides are read twice: cut them before.
    """
    many = max(rows.count() // HOT_SHARE, 1)
    hot, rest = groups.where(F.col(size) > many), groups.where(F.col(size) <= many)
    first = rows.join(F.broadcast(hot), on, "left")
    return first.where(F.col(size).isNotNull()).unionByName(first.where(F.col(size).isNull()).select(*rows.columns).join(rest, on, "left"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() is the fast path for texts of one byte a character."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )
