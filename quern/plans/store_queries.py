"""Queries of the store: contents, copies, counters, failures, merges, garbage, invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import store
from quern.plans import model
from quern.plans.model import FILES_SQL

GENERATION = 7


def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.contents_of(model.files(spark, sf_dir)).select("content_id", "kind", "sha", "newest_id", "copies")


def copies_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.copies(model.files(spark, sf_dir)).select("content_id", "file_id", "place", (F.col("place") == 1).alias("is_primary"))


def live_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.live_contents(model.files(spark, sf_dir))


def index_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.progress(model.files(spark, sf_dir), model.contents(spark, sf_dir))


def folder_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = model.files(spark, sf_dir)
    folders = files.select("folder").distinct().unionByName(spark.createDataFrame([("/empty",)], "folder string"))
    return store.folder_counters(folders, files, model.contents(spark, sf_dir))


def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = model.files(spark, sf_dir).join(model.contents(spark, sf_dir).select("content_id", "extract_status", "embed_status"), "content_id", "left")
    reason = store.failure_reason(F.col("status"), F.lit("too large"), F.lit("too short"), F.col("extract_status"), F.col("embed_status"))
    return both.select("file_id", "path", reason.alias("reason")).where("reason is not null")


def status_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.contents(spark, sf_dir).select("content_id", store.status_label(F.col("extract_status"), F.col("embed_status"), F.col("chunk_count")).alias("label"))


def _snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An old snapshot without the files of English texts of odd length, and a listing without Spanish ones, in which French ones have grown."""
    files = model.files(spark, sf_dir)
    old = files.where("not (kind = 'en' and size > 5000)").select(F.lower("path").alias("path_key"), "size", "mtime_ms", "status", F.lit(1).alias("attempts"), "content_id", F.lit(GENERATION - 1).alias("seen"))
    listing = files.where("kind <> 'es'").select(F.lower("path").alias("path_key"), (F.col("size") + (F.col("kind") == "fr").cast("long")).alias("size"), "mtime_ms")
    return old, listing


def scan_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.merge_scan(*_snapshot(spark, sf_dir), GENERATION)


def delete_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete_unseen(store.merge_scan(*_snapshot(spark, sf_dir), GENERATION), GENERATION).select("path_key", "status")


def gc_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents after Spanish files went: their contents were marked at an age that grows with the id."""
    contents = model.contents(spark, sf_dir).select("content_id", "kind", F.when(F.col("kind") == "es", F.col("content_id") * 1000).alias("orphaned_at"))
    left = model.files(spark, sf_dir).where("kind not in ('es', 'de')")
    return store.collect_garbage(contents, left, 1_000_000).select("content_id", "orphaned_at")


def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = model.contents(spark, sf_dir).where("extract_status = 'ok'").select(F.col("content_id").alias("chunk_id"))
    live = store.live_contents(model.files(spark, sf_dir)).select(F.col("content_id").alias("chunk_id"))
    vectors = model.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return store.missing_vectors(chunks.join(live, "chunk_id", "left_semi"), vectors)


def retry_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = model.files(spark, sf_dir).withColumn("attempts", F.lit(3))
    contents = model.contents(spark, sf_dir).withColumn("extract_attempts", F.lit(3))
    files, contents = store.retry_failed(files, contents)
    return files.select("file_id", "status", "attempts", "content_id").join(contents.select("content_id", "extract_status", "extract_attempts", "embed_status"), "content_id", "left")


def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, contents = model.files(spark, sf_dir), model.contents(spark, sf_dir).withColumn("chunk_count", F.lit(1))
    chunks = contents.select("content_id", F.col("content_id").alias("chunk_id"))
    vectors = model.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    postings = model.contents(spark, sf_dir).where(F.col("text").rlike(r"[\p{L}\p{N}]")).select(F.col("content_id").alias("chunk_id"))
    return store.invariants(files, contents, chunks, vectors, postings)


def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.work_queue(model.files(spark, sf_dir).where("status = 'pending'").select("file_id", "mtime_ms"), 25, "file_id")


W = "WITH " + FILES_SQL
MERGED = f"""{W},
old AS (SELECT lower(path) AS path_key, size AS old_size, mtime_ms AS old_mtime, status AS old_status, content_id FROM files WHERE NOT (kind = 'en' AND size > 5000)),
listing AS (SELECT lower(path) AS path_key, size + (kind = 'fr')::BIGINT AS size, mtime_ms FROM files WHERE kind <> 'es'),
merged AS (
    SELECT path_key, coalesce(size, old_size) AS size, coalesce(mtime_ms, old_mtime) AS mtime_ms,
           CASE WHEN old_size IS NULL OR size <> old_size OR mtime_ms <> old_mtime THEN 'pending' ELSE old_status END AS status,
           CASE WHEN old_size IS NULL OR size <> old_size OR mtime_ms <> old_mtime THEN 0 ELSE 1 END AS attempts,
           content_id, CASE WHEN size IS NULL THEN {GENERATION - 1} ELSE {GENERATION} END AS seen
    FROM old FULL JOIN listing USING (path_key))"""
SQL = {
    "content_dedupe": f"{W} SELECT content_id, kind, sha256(text) AS sha, max(file_id) AS newest_id, count(*) AS copies FROM files GROUP BY content_id, kind, text",
    "copies_primary": f"{W} SELECT content_id, file_id, row_number() OVER w AS place, row_number() OVER w = 1 AS is_primary FROM files WHERE status = 'linked' WINDOW w AS (PARTITION BY content_id ORDER BY mtime_ms DESC, path)",
    "live_contents": f"{W} SELECT content_id FROM live",
    "index_progress": f"""{W}, f AS (
        SELECT count(*) AS files, count(*) FILTER (WHERE status = 'pending') AS to_hash, count(*) FILTER (WHERE status = 'linked') AS linked, count(*) FILTER (WHERE status = 'skipped') AS skipped,
               count(*) FILTER (WHERE status = 'error' OR status = 'linked' AND extract_status NOT IN ('ok', 'pending')) AS failed FROM files LEFT JOIN contents USING (content_id)),
        c AS (SELECT count(*) AS contents, count(*) FILTER (WHERE extract_status = 'pending') AS to_extract, count(*) FILTER (WHERE embed_status = 'pending') AS to_embed, count(*) FILTER (WHERE embed_status = 'done') AS embedded, coalesce(sum(chunk_count), 0)::BIGINT AS chunks
              FROM contents WHERE content_id IN (SELECT content_id FROM live))
        SELECT * FROM f, c""",
    "folder_counters": f"""{W}, g AS (
        SELECT folder, count(*) FILTER (WHERE status IN ('linked', 'pending')) AS found, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'error' OR extract_status NOT IN ('ok', 'pending')) AS failed
        FROM files LEFT JOIN contents USING (content_id) GROUP BY folder)
        SELECT * FROM g UNION ALL SELECT '/empty', 0, 0, 0""",
    "failure_reasons": f"""{W}, r AS (
        SELECT file_id, path, CASE WHEN status = 'skipped' THEN 'skipped: too large' WHEN status = 'error' THEN 'unreadable: too short' WHEN extract_status NOT IN ('ok', 'pending') THEN 'not extracted: ' || extract_status WHEN embed_status = 'failed' THEN 'not embedded' END AS reason
        FROM files LEFT JOIN contents USING (content_id)) SELECT * FROM r WHERE reason IS NOT NULL""",
    "status_labels": f"""{W} SELECT content_id, CASE WHEN extract_status = 'pending' THEN 'waiting' WHEN extract_status <> 'ok' THEN replace(extract_status, '_', ' ') WHEN chunk_count = 0 THEN 'empty' WHEN embed_status = 'done' THEN 'searchable by meaning'
        WHEN embed_status = 'failed' THEN 'searchable by words only' ELSE 'searchable by words' END AS label FROM contents""",
    "scan_merge": f"{MERGED} SELECT * FROM merged",
    "delete_unseen": f"{MERGED} SELECT path_key, status FROM merged WHERE seen = {GENERATION}",
    "gc_orphans": f"""{W}, m AS (
        SELECT content_id, CASE WHEN content_id NOT IN (SELECT content_id FROM files WHERE kind NOT IN ('es', 'de')) THEN CASE WHEN kind = 'es' THEN content_id * 1000 ELSE 1000000 END END AS orphaned_at FROM contents)
        SELECT * FROM m WHERE orphaned_at IS NULL OR orphaned_at > 400000""",
    "missing_vectors": f"{W} SELECT content_id AS chunk_id FROM contents WHERE extract_status = 'ok' AND content_id IN (SELECT content_id FROM live) AND content_id NOT IN (SELECT vec_id FROM embeddings)",
    "retry_failed": f"""{W} SELECT file_id, CASE WHEN status = 'error' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'error' THEN 0 ELSE 3 END AS attempts, content_id,
        CASE WHEN extract_status IN ('timeout', 'failed') THEN 'pending' ELSE extract_status END AS extract_status, CASE WHEN extract_status IN ('timeout', 'failed') THEN 0 ELSE 3 END AS extract_attempts,
        CASE WHEN embed_status = 'failed' THEN 'pending' ELSE embed_status END AS embed_status FROM files LEFT JOIN contents USING (content_id)""",
    "invariants": f"""{W} SELECT 'chunk without content' AS rule, 0::BIGINT AS violations
        UNION ALL SELECT 'vector without chunk', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT content_id FROM contents)
        UNION ALL SELECT 'file without content', count(*) FROM files WHERE content_id NOT IN (SELECT content_id FROM contents)
        UNION ALL SELECT 'linked file without content', 0 UNION ALL SELECT 'chunk count differs', 0
        UNION ALL SELECT 'chunk without postings', count(*) FROM contents WHERE NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]')""",
    "work_queue": f"{W} SELECT file_id, mtime_ms FROM files WHERE status = 'pending' ORDER BY mtime_ms DESC, file_id LIMIT 25",
}
QUERIES = {name: globals()[name] for name in SQL}
