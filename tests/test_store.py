"""Snapshots: merges, deletes, garbage, retries, invariants; incremental work equals a rebuild."""

import pytest

import random

from pyspark.sql import functions as F

from quern.operators import chunking, store
from quern.operators.snapshots import Snapshots

FILES = "path_key string, size long, mtime_ms long, status string, attempts int, content_id long, seen int"


def test_merge_and_delete(spark):
    old = spark.createDataFrame([("a", 1, 1, "linked", 2, 10, 1), ("b", 1, 1, "linked", 2, 11, 1), ("c", 1, 1, "error", 5, None, 1)], FILES)
    scan = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 3, 3)], "path_key string, size long, mtime_ms long")
    merged = store.merge_scan(old, scan, 2)
    got = {r["path_key"]: (r["status"], r["attempts"], r["content_id"], r["seen"]) for r in merged.collect()}
    assert got == {"a": ("linked", 2, 10, 2), "b": ("pending", 0, 11, 2), "c": ("error", 5, None, 1), "d": ("pending", 0, None, 2)}
    assert {r["path_key"] for r in store.delete_unseen(merged, 2).collect()} == {"a", "b", "d"}
    assert store.delete_unseen(merged, 2, completed=False).count() == 4


def test_incremental_equals_rebuild(spark):
    rng = random.Random(5)
    scans = [[(f"p{i}", rng.randint(1, 3), rng.randint(1, 2)) for i in range(30) if rng.random() < 0.7] for _ in range(4)]
    files = spark.createDataFrame([], FILES)
    for n, rows in enumerate(scans):
        files = spark.createDataFrame(store.delete_unseen(store.merge_scan(files, spark.createDataFrame(rows, "path_key string, size long, mtime_ms long"), n), n).collect(), FILES)
    fresh = store.delete_unseen(store.merge_scan(files.limit(0), spark.createDataFrame(scans[-1], "path_key string, size long, mtime_ms long"), 3), 3)
    key = ["path_key", "size", "mtime_ms", "status"]
    assert sorted(map(tuple, files.select(key).collect())) == sorted(map(tuple, fresh.select(key).collect()))


def test_garbage_and_cascade(spark):
    contents = spark.createDataFrame([(1, None), (2, None), (3, 100), (4, 900_000), (5, 5)], "content_id long, orphaned_at long")
    files = spark.createDataFrame([(1,), (5,), (None,)], "content_id long")
    left = {r["content_id"]: r["orphaned_at"] for r in store.collect_garbage(contents, files, 1_000_000).collect()}
    assert left == {1: None, 2: 1_000_000, 4: 900_000, 5: None}
    assert {r["content_id"] for r in store.collect_garbage(contents, files, 1_000_000, grace_ms=0).collect()} == {1, 5}
    chunks = spark.createDataFrame([(1, 11), (2, 21), (9, 91)], "content_id long, chunk_id long")
    (kept,) = store.cascade(contents.where("content_id < 2"), chunks)
    assert [r["chunk_id"] for r in kept.collect()] == [11]
    fresh = spark.createDataFrame([(1, 12), (1, 13)], "content_id long, chunk_id long")
    assert sorted(r["chunk_id"] for r in store.replace_chunks(chunks, fresh).collect()) == [12, 13, 21, 91]
    vectors = spark.createDataFrame([(11, "a"), (21, "b")], "chunk_id long, vec string")
    assert sorted(map(tuple, store.upsert_vectors(vectors, spark.createDataFrame([(11, "c")], "chunk_id long, vec string")).collect())) == [(11, "c"), (21, "b")]


def test_attempts_and_retries(spark):
    files = spark.createDataFrame([("a", 1, 1, "pending", 4, None, 1), ("b", 1, 1, "pending", 3, None, 1), ("c", 1, 1, "error", 5, None, 1)], FILES)
    failed = store.hash_failed(files, spark.createDataFrame([("a",), ("b",)], "path_key string"))
    assert {r["path_key"]: (r["status"], r["attempts"]) for r in failed.collect()} == {"a": ("error", 5), "b": ("pending", 4), "c": ("error", 5)}
    contents = spark.createDataFrame([(1, "timeout", 3, "failed"), (2, "corrupt", 3, "done"), (3, "ok", 1, "failed")], "content_id long, extract_status string, extract_attempts int, embed_status string")
    files, contents = store.retry_failed(files, contents)
    assert {r["path_key"]: (r["status"], r["attempts"]) for r in files.collect()} == {"a": ("pending", 4), "b": ("pending", 3), "c": ("pending", 0)}
    assert [tuple(r) for r in contents.orderBy("content_id").collect()] == [(1, "pending", 0, "pending"), (2, "corrupt", 3, "done"), (3, "ok", 1, "pending")]


def test_invariants_find_each_fault(spark):
    files = spark.createDataFrame([("linked", 1), ("linked", None), ("linked", 7)], "status string, content_id long")
    contents = spark.createDataFrame([(1, 2), (2, 0)], "content_id long, chunk_count long")
    chunks = spark.createDataFrame([(1, 11), (3, 31)], "content_id long, chunk_id long")
    vectors, postings = spark.createDataFrame([(11,), (99,)], "chunk_id long"), spark.createDataFrame([(11,)], "chunk_id long")
    got = {r["rule"]: r["violations"] for r in store.invariants(files, contents, chunks, vectors, postings).collect()}
    assert got == dict.fromkeys(got, 1) and len(got) == 6


def test_roots(spark):
    roots = spark.createDataFrame([("/home/me",)], "path string")
    added = spark.createDataFrame([("/Home/me",), ("/home/me/docs",), ("/home",), ("/home/meadow",)], "path string")
    assert {r["path"]: r["verdict"] for r in store.overlapping_roots(roots, added).collect()} == {"/Home/me": "same", "/home/me/docs": "inside", "/home": "absorbs"}


def test_copies_newest_first(spark):
    rows = spark.createDataFrame([(1, 10, "linked", 5, "b"), (2, 10, "linked", 9, "a"), (3, 10, "pending", 99, "c"), (4, 10, "linked", 5, "a")], "file_id long, content_id long, status string, mtime_ms long, path string")
    assert [r["file_id"] for r in store.copies(rows).orderBy("place").collect()] == [2, 4, 1]
    assert store.live_contents(rows.withColumn("status", F.lit("pending"))).count() == 0


def test_documents_queues_and_settings(spark):
    indexed = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 5)], "path_key string, size long, mtime_ms long")
    now = spark.createDataFrame([("a", 1, 5), ("b", 2, 5)], "path_key string, size long, mtime_ms long")
    assert {r["path_key"]: r["changed"] for r in store.changed_since(indexed, now).collect()} == {"a": False, "b": True, "c": True}
    settings = spark.createDataFrame([("x", "1"), ("y", "2")], "key string, value string")
    assert sorted(map(tuple, store.upsert_settings(settings, spark.createDataFrame([("y", "3"), ("z", "4")], "key string, value string")).collect())) == [("x", "1"), ("y", "3"), ("z", "4")]
    rows = spark.createDataFrame([(1, "code", 9), (2, "text", 8), (3, "text", 7)], "id long, kind string, mtime_ms long")
    assert [r["id"] for r in store.work_queue(rows, 2, "id", F.col("kind") == "code").collect()] == [2, 3]
    contents = spark.createDataFrame([(1, "ok", "pending"), (2, "ok", "pending"), (3, "ok", "done")], "content_id long, extract_status string, embed_status string")
    chunks, vectors = spark.createDataFrame([(1, 11), (2, 21), (2, 22)], "content_id long, chunk_id long"), spark.createDataFrame([(11,), (21,)], "chunk_id long")
    assert [r["content_id"] for r in store.embedded_contents(contents, chunks, vectors).collect()] == [1]
    files = spark.createDataFrame([("/a", 1), ("/b", 2)], "folder string, content_id long")
    whole = spark.createDataFrame([(1, None), (2, None)], "content_id long, orphaned_at long")
    left, kept = store.remove_folder(files, whole, "/a")
    assert left.count() == 1 and [r["content_id"] for r in kept.collect()] == [2]
    pieces = spark.createDataFrame([(1, 0, "ab cd", 0, 5), (1, 1, "cd ef", 3, 8)], "content_id long, ord int, text string, start long, stop long")
    views = chunking.document_views(contents, pieces, F.lit("fine"), spark.createDataFrame([(1, False)], "content_id long, changed boolean"))
    assert {r["content_id"]: (r["text"], r["changed"]) for r in views.collect()} == {1: ("ab cd ef", False), 2: ("", True), 3: ("", True)}


def test_snapshots(spark, tmp_path):
    root = Snapshots(spark, str(tmp_path / "store"))
    files = lambda n: spark.range(n).withColumnRenamed("id", "file_id")
    assert root.open(1).problem == "missing"
    root.write({"files": files(3), "folders": files(1)}, 1, clean=False)
    assert root.open(1).tables["files"].count() == 3 and root.open(0).problem == "newer"
    assert root.open(1, lambda t: t["files"].count() == 4).problem == "inconsistent"
    with pytest.raises(ZeroDivisionError):
        root.migrate({2: lambda t: 1 / 0}, 2)
    assert root.open(1).version == 1
    moved = root.migrate({2: lambda t: t | {"files": t["files"].where("file_id > 0")}, 3: lambda t: t}, 3)
    assert (moved.version, moved.tables["files"].count(), root.numbers()) == (3, 2, [1, 2])
    root.keep(1)
    assert root.numbers() == [2] and set(root.clear("folders")) == {"folders"} and set(root.open(3).tables) == {"folders"}
    for f in (tmp_path / "store" / "s3").glob("snapshot.json"):
        f.write_text("{broken")
    assert root.open(3).problem.startswith("damaged")
