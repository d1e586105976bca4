"""The store of files and contents as snapshots: merges, deletes, retries, garbage, counters and invariants.

A snapshot is immutable; each function gives the next one. Keys decide rows, never their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.joins import held

ORPHAN_GRACE_MS = 10 * 60 * 1000
HASH_TRIES, EXTRACT_TRIES = 5, 3
RETRIED = ("timeout", "failed")


def merge_scan(files: DataFrame, scan: DataFrame, generation: int) -> DataFrame:
    """Upserts a listing (path_key, size, mtime_ms) into files (path_key, size, mtime_ms, status, attempts, content_id, seen).

    New and changed files become pending with no attempts; changed ones keep their content until they are read again.
    """
    old = files.select(F.col("path_key"), *(F.col(c).alias(f"old_{c}") for c in ("size", "mtime_ms", "status", "attempts", "content_id", "seen")))
    both = old.join(scan.select("path_key", "size", "mtime_ms"), "path_key", "full")
    gone = F.col("size").isNull() & F.col("old_size").isNotNull()
    new = F.col("old_size").isNull()
    changed = ~gone & ~new & ((F.col("size") != F.col("old_size")) | (F.col("mtime_ms") != F.col("old_mtime_ms")))
    return both.select(
        "path_key", F.coalesce("size", "old_size").alias("size"), F.coalesce("mtime_ms", "old_mtime_ms").alias("mtime_ms"),
        F.when(new | changed, "pending").otherwise(F.col("old_status")).alias("status"), F.when(new | changed, 0).otherwise(F.col("old_attempts")).alias("attempts"),
        F.col("old_content_id").alias("content_id"), F.when(gone, F.col("old_seen")).otherwise(F.lit(generation)).alias("seen"),
    )


def delete_unseen(files: DataFrame, generation: int, completed: bool = True) -> DataFrame:
    """Files that a completed scan has seen; a scan that broke off deletes nothing."""
    return files.where(F.col("seen") == generation) if completed else files


def contents_of(files: DataFrame) -> DataFrame:
    """One content for each (sha, kind): its smallest file id, newest file, number of copies."""
    newest = F.max_by(F.col("file_id"), F.struct("mtime_ms", "file_id"))
    return files.groupBy("sha", "kind").agg(F.min("file_id").alias("content_id"), newest.alias("newest_id"), F.count("*").alias("copies"), F.max("size").alias("size"))


def live_contents(files: DataFrame) -> DataFrame:
    return files.where("status = 'linked' and content_id is not null").select("content_id").distinct()


def copies(files: DataFrame) -> DataFrame:
    """Linked files with their place among the copies of a content: newest first, then by path."""
    order = Window.partitionBy("content_id").orderBy(F.desc("mtime_ms"), F.asc("path"))
    return files.where("status = 'linked'").withColumn("place", F.row_number().over(order))


def collect_garbage(contents: DataFrame, files: DataFrame, now_ms: int, grace_ms: int = ORPHAN_GRACE_MS) -> DataFrame:
    """Marks contents without files, unmarks those that have one again, drops those marked for longer than the grace."""
    used = files.where("content_id is not null").select("content_id").distinct().withColumn("used", F.lit(True))
    marked = contents.join(used, "content_id", "left").withColumn("orphaned_at", F.when(F.col("used").isNull(), F.coalesce("orphaned_at", F.lit(now_ms).cast("long"))))
    return marked.drop("used").where(F.col("orphaned_at").isNull() | (F.col("orphaned_at") > now_ms - grace_ms))


def cascade(contents: DataFrame, *dependents: DataFrame) -> list[DataFrame]:
    """Dependents whose content is still there."""
    ids = held(contents.select("content_id").distinct())
    return [d.join(ids, "content_id", "left_semi") for d in dependents]


def replace_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """All chunks of a content are replaced at once. Works for postings and vectors alike."""
    return chunks.join(held(fresh.select("content_id").distinct()), "content_id", "left_anti").unionByName(fresh)


def upsert_vectors(vectors: DataFrame, fresh: DataFrame) -> DataFrame:
    return vectors.join(held(fresh.select("chunk_id").distinct()), "chunk_id", "left_anti").unionByName(fresh)


def hash_failed(files: DataFrame, failed: DataFrame) -> DataFrame:
    """One more attempt for failed files (path_key); the fifth makes it an error."""
    bad = failed.select("path_key", F.lit(True).alias("bad")).distinct()
    both = files.join(bad, "path_key", "left")
    return both.withColumns({"status": F.when(F.col("bad") & (F.col("attempts") >= HASH_TRIES - 1), "error").otherwise(F.col("status")), "attempts": F.col("attempts") + F.coalesce(F.col("bad").cast("int"), F.lit(0))}).drop("bad")


def retry_failed(files: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Errors of files, timeouts and failures of contents and failed embeddings become pending; final results stay."""
    again = F.col("extract_status").isin(*RETRIED)
    contents = contents.withColumns({
        "extract_attempts": F.when(again, 0).otherwise(F.col("extract_attempts")), "extract_status": F.when(again, "pending").otherwise(F.col("extract_status")),
        "embed_status": F.when(F.col("embed_status") == "failed", "pending").otherwise(F.col("embed_status")),
    })
    error = F.col("status") == "error"
    return files.withColumns({"attempts": F.when(error, 0).otherwise(F.col("attempts")), "status": F.when(error, "pending").otherwise(F.col("status"))}), contents


def failure_reason(status: Column, skip_reason: Column, error_code: Column, extract_status: Column, embed_status: Column) -> Column:
    return (
        F.when(status == "skipped", F.concat(F.lit("skipped: "), F.coalesce(skip_reason, F.lit("unknown")))).when(status == "error", F.concat(F.lit("unreadable: "), F.coalesce(error_code, F.lit("unknown"))))
        .when(~extract_status.isin("ok", "pending"), F.concat(F.lit("not extracted: "), extract_status)).when(embed_status == "failed", "not embedded")
    )


def status_label(extract_status: Column, embed_status: Column, chunk_count: Column) -> Column:
    return F.when(extract_status == "pending", "waiting").when(extract_status != "ok", F.replace(extract_status, F.lit("_"), F.lit(" "))).when(chunk_count == 0, "empty").when(embed_status == "done", "searchable by meaning").when(embed_status == "failed", "searchable by words only").otherwise("searchable by words")


def progress(files: DataFrame, contents: DataFrame) -> DataFrame:
    """One row of counters. Failures count files, of which a content may have several."""
    state = contents.select("content_id", "extract_status", "embed_status", "chunk_count")
    both = files.join(state, "content_id", "left")
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    per_file = both.agg(
        F.count("*").alias("files"), is_("status", "pending").alias("to_hash"), is_("status", "linked").alias("linked"), is_("status", "skipped").alias("skipped"),
        F.count_if((F.col("status") == "error") | ((F.col("status") == "linked") & ~F.col("extract_status").isin("ok", "pending"))).alias("failed"),
    )
    live = state.join(live_contents(files), "content_id", "left_semi")
    per_content = live.agg(
        F.count("*").alias("contents"), is_("extract_status", "pending").alias("to_extract"), is_("embed_status", "pending").alias("to_embed"), is_("embed_status", "done").alias("embedded"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks")
    )
    return per_file.crossJoin(per_content)  # one row each


def folder_counters(folders: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """(folder, found, skipped, failed); folders without files have zeros."""
    both = files.join(contents.select("content_id", "extract_status"), "content_id", "left")
    counted = both.groupBy("folder").agg(
        F.count_if(F.col("status").isin("linked", "pending")).alias("found"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if((F.col("status") == "error") | ~F.col("extract_status").isin("ok", "pending")).alias("failed"),
    )
    return folders.join(counted, "folder", "left").select("folder", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("found", "skipped", "failed")))


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def invariants(files: DataFrame, contents: DataFrame, chunks: DataFrame, vectors: DataFrame, posting_ids: DataFrame) -> DataFrame:
    """(rule, violations) of a consistent store: every count is 0."""
    counts = chunks.groupBy("content_id").agg(F.count("*").alias("n"))
    rules = {
        "chunk without content": chunks.join(contents, "content_id", "left_anti"),
        "vector without chunk": vectors.join(chunks, "chunk_id", "left_anti"),
        "file without content": files.where("content_id is not null").join(contents, "content_id", "left_anti"),
        "linked file without content": files.where("status = 'linked' and content_id is null"),
        "chunk count differs": contents.join(counts, "content_id", "left").where("chunk_count <> coalesce(n, 0)"),
        "chunk without postings": chunks.join(posting_ids, "chunk_id", "left_anti"),
    }
    out = None
    for rule, rows in rules.items():
        part = rows.agg(F.lit(rule).alias("rule"), F.count("*").alias("violations"))
        out = part if out is None else out.unionByName(part)
    return out.select("rule", "violations")


def overlapping_roots(roots: DataFrame, added: DataFrame) -> DataFrame:
    """(path, known, verdict) of added folders against known ones: same, inside (of one) or absorbs.

    Each side's paths are spread out into the folders above them, and both are joined by equality: no path meets all others.
    """
    up = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda n: F.array_join(F.slice(F.split(c, "/"), 1, n), "/"))
    known = roots.select(F.lower("path").alias("known")).distinct()
    fresh = added.select("path", F.lower("path").alias("low"))
    inside = fresh.withColumn("known", F.explode(up(F.col("low")))).join(known, "known").select("path", "known", F.when(F.col("known") == F.col("low"), "same").otherwise("inside").alias("verdict"))
    absorbed = known.withColumn("low", F.explode(up(F.col("known")))).where("low <> known").join(fresh, "low").select("path", "known", F.lit("absorbs").alias("verdict"))
    return inside.unionByName(absorbed)


def work_queue(rows: DataFrame, n: int, id_col: str, code_last: Column | None = None) -> DataFrame:
    """The newest n rows, those for which code_last holds behind the others; each task sends n at most."""
    first = [] if code_last is None else [code_last]
    return rows.orderBy(*first, F.desc("mtime_ms"), F.asc(id_col)).limit(n)


def failures(rows: DataFrame, n: int = 500) -> DataFrame:
    """The first n rows (file_id, name, reason) by name."""
    return rows.where("reason is not null").orderBy("name", "file_id").limit(n)


def embedded_contents(contents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Contents whose embedding is done: extracted, pending, and without a chunk that lacks a vector."""
    lacking = missing_vectors(chunks, vectors).select("content_id").distinct()
    return contents.where("extract_status = 'ok' and embed_status = 'pending'").join(lacking, "content_id", "left_anti")


def upsert_settings(settings: DataFrame, fresh: DataFrame) -> DataFrame:
    """settings (key, value) with those of fresh put in or over them."""
    return settings.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def changed_since(indexed: DataFrame, listing: DataFrame) -> DataFrame:
    """(path_key, changed) of indexed files (path_key, size, mtime_ms): another size or time now, or gone."""
    now = listing.select("path_key", F.col("size").alias("now_size"), F.col("mtime_ms").alias("now_ms"))
    same = F.coalesce((F.col("size") == F.col("now_size")) & (F.col("mtime_ms") == F.col("now_ms")), F.lit(False))
    return indexed.join(now, "path_key", "left").select("path_key", (~same).alias("changed"))


def is_partial(counters: DataFrame) -> DataFrame:
    """progress() with `partial`: whether something is still to be read or embedded."""
    return counters.withColumn("partial", (F.col("to_hash") > 0) | (F.col("to_extract") > 0) | (F.col("to_embed") > 0))


def remove_folder(files: DataFrame, contents: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Files without those of the folder, and contents without those that nothing uses any more, at once."""
    left = files.where(F.col("folder") != folder)
    return left, collect_garbage(contents, left, 0, grace_ms=0)
