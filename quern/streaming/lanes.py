"""Indexing in lanes: files are scanned, hashed, extracted and embedded by small commits to versioned tables.

A lane takes its newest work, some rows at a time, computes what follows from the tables as they are, and commits it as the next version. Nothing else is kept:
a process that is killed anywhere goes on from the last whole version and takes up the same work again, so the tables come out as if nothing had happened.
Words come before meaning: nothing is embedded while something is still to be extracted. Failed work is tried again some times, behind all other work.

The tables are logs of rows by version; the latest rows of a key hold, and a row that is gone takes its key out. compact() writes them as one.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions import vectors
from quern.operators import chunking, providers, store
from quern.operators.joins import cut, small
from quern.sources import files as sources


class Kept(NamedTuple):
    """Columns of a table, without version and gone, and its key, of which a version has all rows or none."""

    columns: str
    key: str


TABLES = {
    "files": Kept("path string, rel_path string, kind string, size long, mtime_ms long, status string, attempts int, content_id string", "path"),
    "contents": Kept("content_id string, kind string, path string, mtime_ms long, extract_status string, attempts int, embed_status string, chunk_count long", "content_id"),
    "chunks": Kept("content_id string, ord int, text string, start long, stop long", "content_id"),
    "vectors": Kept("content_id string, ord int, vec array<float>", "content_id"),
}
MANIFEST = "paths map<string,array<string>>"
LANES = ("hash", "extract", "embed")


class Lanes:
    """The tables in `folder`, of the files below `root`. Without an embedder vectors are hashed words."""

    def __init__(self, spark: SparkSession, folder: str, root: str, embedder: providers.Embedder | None = None, batch: int = 1000) -> None:
        self.spark, self.folder, self.root, self.embedder, self.batch = spark, folder.rstrip("/"), root, embedder, batch
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> tuple[int, dict[str, list[str]]]:
        """The number and the paths by table of the latest whole version."""
        at = self._path(f"{self.folder}/versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        whole = [int(n) for n in names if n.isdigit() and self._fs.exists(self._path(f"{self.folder}/versions/{n}/_SUCCESS"))]
        if not whole:
            return 0, {}
        return max(whole), dict(self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/versions/{max(whole)}").first()["paths"])

    def read(self, name: str) -> DataFrame:
        """The rows of a table now."""
        schema, paths = f"{TABLES[name].columns}, version long, gone boolean", self.version()[1].get(name, [])
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        latest = F.max("version").over(Window.partitionBy(TABLES[name].key))
        return rows.withColumn("latest", latest).where("version = latest and not gone").drop("version", "latest", "gone")

    def commit(self, changes: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None) -> int:
        """The next version: rows of `changes` replace those of their keys, keys of `gone` (a column of the key's name) go."""
        number, paths = self.version()
        number += 1
        for name in {*changes, *(gone or {})}:
            kept, out = TABLES[name], None
            names = [c.split()[0] for c in kept.columns.split(", ")]
            if name in changes:
                out = changes[name].select(*names).withColumn("gone", F.lit(False))
            if gone and name in gone:
                left = gone[name].select(*(F.col(kept.key) if f.name == kept.key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.read(name).schema)).withColumn("gone", F.lit(True))
                out = left if out is None else out.unionByName(left)
            path = f"{self.folder}/{name}/{number}-{uuid.uuid4().hex[:12]}"
            out.withColumn("version", F.lit(number).cast("long")).write.parquet(path)
            paths = paths | {name: [*paths.get(name, []), path]}
        return self._publish(number, paths)

    def _publish(self, number: int, paths: dict[str, list[str]]) -> int:
        self.spark.createDataFrame([(paths,)], MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/versions/{number}")
        return number

    def compact(self) -> int:
        """The same rows, each table as one path; older versions and what broken commits left go. Nothing else may be at work."""
        number = self.commit({name: self.read(name) for name in TABLES})
        new = {name: [p for p in own if f"/{number}-" in p] for name, own in self.version()[1].items()}
        self._publish(number + 1, new)
        kept = {p for own in new.values() for p in own} | {f"{self.folder}/versions/{number + 1}"}
        for name in (*TABLES, "versions"):
            at = self._path(f"{self.folder}/{name}")
            for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if not any(str(s.getPath().toString()).endswith(k.removeprefix("file://")) for k in kept):
                    self._fs.delete(s.getPath(), True)
        return number + 1

    def scan(self) -> bool:
        """Commits what a full listing says: new and changed files wait for their hash, and those that are gone go, with contents that nothing else has. A root that can't be listed deletes nothing."""
        try:
            now = cut(sources.listing(self.spark, self.root).select("path", "rel_path", "kind", "size", "mtime_ms", "status"))
        except AnalysisException:
            return False
        held = cut(self.read("files"))
        same = now.join(held.select("path", "size", "mtime_ms"), ["path", "size", "mtime_ms"], "left_anti")
        fresh = same.join(held.select("path", "content_id"), "path", "left").withColumn("attempts", F.lit(0))
        gone = cut(held.join(now.select("path"), "path", "left_anti").select("path"))
        left = held.join(small(gone), "path", "left_anti").select("content_id").unionByName(fresh.select("content_id"))
        return self._with_orphans({"files": cut(fresh)}, {"files": gone}, left)

    def _with_orphans(self, changes: dict[str, DataFrame], gone: dict[str, DataFrame], used: DataFrame) -> bool:
        """Commits changes, if there are any, with the end of contents that aren't in `used`, and of their chunks and vectors."""
        unused = cut(self.read("contents").join(used, "content_id", "left_anti").select("content_id"))
        if all(df.isEmpty() for df in (*changes.values(), *gone.values(), unused)):
            return False
        self.commit(changes, gone | {name: unused for name in ("contents", "chunks", "vectors")})
        return True

    def waiting(self) -> dict[str, int]:
        """How much each lane has to do."""
        files = self.read("files").agg(F.count_if(F.col("status") == "pending")).first()
        contents = self.read("contents").agg(F.count_if(F.col("extract_status") == "pending"), F.count_if((F.col("extract_status") == "ok") & (F.col("embed_status") == "pending"))).first()
        return dict(zip(LANES, (files[0], *contents), strict=True))

    def step(self) -> str | None:
        """Does some of the first lane's work that has any, and commits it; the lane's name, or None if all is done."""
        lane = next((name for name, n in self.waiting().items() if n), None)
        if lane:
            getattr(self, f"_{lane}")()
        return lane

    def run(self) -> int:
        """Steps until nothing waits; how many there were."""
        n = 0
        while self.step():
            n += 1
        return n

    def _bytes(self, work: DataFrame) -> DataFrame:
        """work (path, ...) with content; null for files that can't be found any more. A batch of paths at a time."""
        paths = [r["path"] for r in work.select("path").distinct().collect()]  # at most a batch
        there = [p for p in paths if self._fs_of(p).exists(self._path(p))]
        if not there:
            return work.withColumn("content", F.lit(None).cast("binary"))
        read = self.spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(there).select("path", "content")
        return work.join(read, "path", "left")

    def _fs_of(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _hash(self) -> None:
        files = cut(self.read("files"))
        work = cut(store.work_queue(files.where("status = 'pending'"), self.batch, "path", F.col("attempts")))
        sha = F.concat_ws(":", F.sha2("content", 256), "kind")
        done = cut(self._bytes(work).withColumn("new_id", F.when(F.col("content").isNotNull(), sha)).drop("content"))
        read = F.col("new_id").isNotNull()
        tries = F.col("attempts") + F.when(read, 0).otherwise(1)
        status = F.when(read, "linked").when(tries >= store.HASH_TRIES, "error").otherwise("pending")
        changed = cut(done.select("path", "rel_path", "kind", "size", "mtime_ms", status.alias("status"), tries.alias("attempts"), F.coalesce("new_id", "content_id").alias("content_id")))
        linked = changed.where("status = 'linked'")
        newest = F.max_by(F.struct("path", "mtime_ms"), F.struct("mtime_ms", "path")).alias("newest")
        fresh = linked.join(self.read("contents").select("content_id"), "content_id", "left_anti").groupBy("content_id", "kind").agg(newest)
        contents = fresh.select("content_id", "kind", "newest.path", "newest.mtime_ms", F.lit("pending").alias("extract_status"), F.lit(0).alias("attempts"), F.lit("not_applicable").alias("embed_status"), F.lit(0).cast("long").alias("chunk_count"))
        used = files.join(changed.select("path"), "path", "left_anti").select("content_id").unionByName(changed.select("content_id"))
        self._with_orphans({"files": changed, "contents": cut(contents)}, {}, used)

    def _extract(self) -> None:
        work = cut(store.work_queue(self.read("contents").where("extract_status = 'pending'"), self.batch, "content_id", F.col("attempts")))
        # any linked file of a content will do
        paths = self.read("files").where("status = 'linked'").join(small(work.select("content_id")), "content_id", "left_semi").groupBy("content_id").agg(F.min("path").alias("path"))
        found = self._bytes(cut(work.drop("path").join(paths, "content_id", "left").where("path is not null")))
        same = F.concat_ws(":", F.sha2("content", 256), "kind") == F.col("content_id")
        made = cut(sources.extract(found.where(same).select("content_id", "kind", "content")).select("content_id", "kind", "status", "text", "blocks"))
        chunks = cut(chunking.chunk(made.where("status = 'ok'").select("content_id", "kind", "text", "blocks")).select("content_id", "ord", "text", "start", "stop"))
        counted = chunks.groupBy("content_id").agg(F.count("*").alias("n"))
        both = work.join(made.select("content_id", F.col("status").alias("now")), "content_id", "left").join(counted, "content_id", "left")
        tries = F.col("attempts") + F.when(F.col("now").isNull() | F.col("now").isin(*store.RETRIED), 1).otherwise(0)
        status = F.when(F.col("now").isNotNull() & ~F.col("now").isin(*store.RETRIED), F.col("now")).when(tries >= store.EXTRACT_TRIES, F.coalesce("now", F.lit("failed"))).otherwise("pending")
        contents = both.select(
            "content_id", "kind", "path", "mtime_ms", status.alias("extract_status"), tries.alias("attempts"),
            F.when((status == "ok") & (F.coalesce("n", F.lit(0)) > 0), "pending").otherwise("not_applicable").alias("embed_status"), F.coalesce("n", F.lit(0)).cast("long").alias("chunk_count"),
        )
        self.commit({"contents": contents, "chunks": chunks})

    def _embed(self) -> None:
        waiting = self.read("contents").where("extract_status = 'ok' and embed_status = 'pending'")
        work = cut(store.work_queue(waiting, self.batch, "content_id", F.col("kind") == "code"))
        chunks = self.read("chunks").join(small(work.select("content_id")), "content_id", "left_semi").select(F.struct("content_id", "ord").alias("id"), "text")
        made = providers.embed(chunks, self.embedder) if self.embedder else chunks.select("id", vectors.hashed_words(F.col("text")).cast("array<float>").alias("vec"))
        self.commit({"vectors": made.select("id.content_id", "id.ord", "vec"), "contents": work.withColumn("embed_status", F.lit("done"))})

    def start(self, every: str = "10 minutes", checkpoint: str | None = None) -> StreamingQuery:
        """Scans and runs all lanes at each trigger, until stopped. What a trigger that broke off has committed, the next one goes on from."""

        def once(_: DataFrame, number: int) -> None:
            self.scan()
            self.run()

        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint or f"{self.folder}/ticks").trigger(processingTime=every).start()
