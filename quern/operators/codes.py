"""Exact nearest vectors in two stages: codes of a byte a component leave few rows open, and only the vectors of these are read.

rank.nearest() reads every vector whole. Here the scan reads a quarter of that, and what it says of a row is bounded: a code is off by at most what
was stored with it, so a score lies between two bounds, and rows whose upper bound is below the k-th best lower bound aren't among the best k.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import dot
from quern.operators.joins import cut, held, new_folder, small
from quern.operators.rank import QUERY_BLOCK, VECTORS, ranked

#: Vectors of a block, which is a folder of its own: blocks without open rows aren't read.
BLOCK_ROWS = 1 << 15
CODES = "id long, block long, code binary, scale float, rest float"


class Coded(NamedTuple):
    """codes (id, block, code, scale, rest) and vectors (id, vec, block). A filter on codes is one on the search."""

    codes: DataFrame
    vectors: DataFrame


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        most = np.abs(rows).max(1, initial=0)
        scale = np.where(most > 0, most / 127, 1).astype(np.float32)
        codes = np.rint(rows / scale[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
        near = codes * scale[:, None].astype(np.float64)
        # what the code leaves out, and what 32-bit sums of products may be off by, a unit of the query's length
        rest = np.linalg.norm(rows - near, axis=1) + (rows.shape[1] + 4) * 2.0**-23 * np.linalg.norm(near, axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("block"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(np.nextafter(rest.astype(np.float32), np.float32(np.inf)))], ["id", "block", "code", "scale", "rest"]
        )


def encode(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> Coded:
    """Codes and vectors of (id, vec), written below spark.checkpoint.dir; rows without a vector have neither. All vectors are finite and of one length, ids are unique.

    A row's block is a hash of its id, so blocks are of even size. The vectors are shuffled once, here, and lie in a folder for each block.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).where("vec is not null")
    blocks = max(1, -(-rows.count() // block_rows))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    folder = new_folder(spark)
    placed.repartition("block").sortWithinPartitions("block", "id").write.partitionBy("block").parquet(folder)
    whole = spark.read.schema("id long, vec array<float>, block long").parquet(folder)
    return Coded(cut(whole.select("id", "block", "vec").mapInArrow(_encoded, CODES)), whole)


def _bytes(column: pa.Array) -> np.ndarray:
    """The values of a binary column one after the other, as numbers; they are of one length."""
    wide = pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.int8)[at[0] : at[-1]].reshape(len(column), -1)


def _open(batches: Iterator[pa.RecordBatch], asked: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    """Rows whose upper bound isn't below the k-th best lower bound so far. A task holds k bounds a query, however many rows stay open."""
    names, matrix = asked.value
    names, sizes, turned = np.array(names, np.int64), np.linalg.norm(matrix, axis=1), matrix.T.astype(np.float32)
    best = np.full((len(names), k), -np.inf)
    for batch in batches:
        if not batch.num_rows:
            continue
        near = (_bytes(batch.column("code")).astype(np.float32) @ turned).astype(np.float64) * batch.column("scale").to_numpy()[:, None]
        off = batch.column("rest").to_numpy().astype(np.float64)[:, None] * sizes
        low, high = near - off, near + off
        best = np.partition(np.concatenate([best, low.T], 1), -k, axis=1)[:, -k:]
        r, q = np.nonzero(high >= best[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[q]), batch.column("id").take(pa.array(r)), batch.column("block").take(pa.array(r)), pa.array(low[r, q]), pa.array(high[r, q])], ["query_id", "id", "block", "low", "high"]
        )


def open_rows(coded: Coded, queries: DataFrame, k: int = VECTORS) -> DataFrame:
    """(query_id, id, block, low, high, least) of the rows that may be among the best k of queries (query_id, vec): high isn't below least, the k-th best low."""
    spark = queries.sparkSession
    asked, out = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).toLocalIterator(), None
    while block := list(islice(asked, QUERY_BLOCK)):
        value = spark.sparkContext.broadcast(([r["query_id"] for r in block], np.array([r["vec"] for r in block], np.float64)))
        part = cut(coded.codes.mapInArrow(partial(_open, asked=value, k=k), "query_id long, id long, block long, low double, high double"))
        value.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, block long, low double, high double, least double")
    least = ranked(out, k, F.desc("low"), F.asc("id")).where(F.col("rank") == k).select("query_id", F.col("low").alias("least"))
    return out.join(held(least), "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))).where("high >= least")


def nearest(coded: Coded, queries: DataFrame, k: int = VECTORS) -> DataFrame:
    """(query_id, id, score, rank): the rows of rank.nearest(). Ties go to the smaller id; scores that differ in their last bits alone may change places."""
    queries = cut(queries.where("vec is not null").select(F.col("query_id").cast("long").alias("query_id"), "vec"))
    rows = held(open_rows(coded, queries, k)).where("high >= least")  # said once more: a filter lets Spark leave blocks out
    found = coded.vectors.join(rows.select("query_id", "id", "block"), ["block", "id"])
    asked = small(queries.select("query_id", F.col("vec").alias("asked")), QUERY_BLOCK)
    scored = found.join(asked, "query_id").select("query_id", "id", dot(F.col("vec"), F.col("asked")).alias("score"))
    return ranked(scored, k, F.desc("score"), F.asc("id"))
