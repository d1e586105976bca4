"""Ingest as a stream: new files of a folder are extracted, chunked and appended, each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions import paths
from quern.operators import chunking, history
from quern.sources import files

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watched(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """Files that appear below root, with their contents."""
    rows = spark.readStream.schema(BINARY).format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    kept = rows.withColumn("kind", paths.kind_of(paths.extension(name))).where("kind is not null").where(~paths.is_excluded_file(name))
    return kept.where(F.col("length") <= paths.size_cap(F.col("kind")))


def chunked(rows: DataFrame) -> DataFrame:
    """Chunks of watched files; the content's hash names them, so a file that comes again adds nothing new."""
    hashed = rows.select("path", "kind", "content", F.sha2("content", 256).alias("content_id"))
    ready = files.extract(hashed).where("status = 'ok'")
    return chunking.chunk(ready.select("content_id", "kind", "text", "blocks"))


def index_folder(spark: SparkSession, root: str, table: str, checkpoint: str) -> StreamingQuery:
    """Appends chunks of what is new below root to a Parquet table and stops; started again it goes on where it was.

    A micro-batch that is tried again overwrites its own folder, so chunks are never appended twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        unique = batch.dropDuplicates(["content_id", "ord"])
        unique.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return chunked(watched(spark, root)).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced(events: DataFrame, gap: str = "1500 milliseconds", lateness: str = "10 seconds") -> DataFrame:
    """Runs of a key's events, closed once the watermark has passed their gap."""
    return history.debounced(events.withWatermark("ts", lateness), gap)


def coalesced(events: DataFrame, width: str = "400 milliseconds", lateness: str = "10 seconds") -> DataFrame:
    return history.coalesced(events.withWatermark("ts", lateness), width)


def reconciled(spark: SparkSession, root: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a full listing of root says of known files (path, size, mtime_ms): (new or changed ones, gone ones). For a run every few minutes, as watching sees no deletions."""
    now = files.listing(spark, root).select("path", "size", "mtime_ms")
    return now.join(known, ["path", "size", "mtime_ms"], "left_anti"), known.join(now, "path", "left_anti")
