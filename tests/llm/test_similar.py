"""Similarity join, exact duplicates and benchmark windows against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import decontaminate, exact_dedup, jaccard_join

LOWER = {i: i + 32 for i in range(65, 91)}


def noisy(seed: int, n: int = 90) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [a + b for a in "th on er in AN".split() for b in "e s ä ing 日".split()]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.7:
            words = rng.choice(out).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 8, 15, 30, 60, 140, 400]))
        out.append(rng.choice([" ", "\n", "\t "]).join(words))
    rows = [(i, t) for i, t in enumerate(out)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (None, out[3]), (4, out[4]), (n + 3, out[5].upper())]


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def joined(spark, rows, k, percent):
    docs = spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in rows], "doc_id long, text string, id string, n long, n1 long, component_id long")
    found = jaccard_join.jaccard_join(docs, words=k, percent=percent).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str)


def test_components_equal_brute_force(spark):
    for seed, k, percent in ((1, 3, 90), (2, 5, 80)):
        rows = noisy(seed)
        assert joined(spark, rows, k, percent) == brute_components(rows, k, percent)


def test_large_regions_are_divided_exactly(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "REGION", 6)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    rows = noisy(3, 120)
    assert joined(spark, rows, 3, 90) == brute_components(rows, 3, 90)


def test_dense_regions_are_tied_by_stars(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "REGION", 8)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 3)
    monkeypatch.setattr(jaccard_join, "MEETING", 10)
    rng = random.Random(9)
    template, rows = [f"w{i}" for i in range(120)], []
    for i in range(90):
        words = list(template)
        for _ in range(rng.choice([1, 2, 3, 6])):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    assert joined(spark, rows, 3, 90) == brute_components(rows, 3, 90)


def test_cells_hold_all_linked_pairs_and_part_the_others():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 6, (40, 64))
    counts = np.concatenate([base, np.maximum(base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.1), 0)]).astype(np.int16)
    n = counts.sum(1)
    cell = jaccard_join.cells(counts, n * 10 // 90)
    apart = np.abs(counts[:, None].astype(int) - counts[None]).sum(2)
    together = (cell[:, :, None] & cell[:, None, :]).any(0)
    assert together[apart * 190 <= 10 * (n[:, None] + n[None, :])].all()
    assert together.sum() < 0.1 * together.size  # without cells each set would meet all others


def test_join_without_its_cells_finds_nothing(spark, monkeypatch):
    rows = [(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k l"), (3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    links = jaccard_join.jaccard_join(docs, words=3, percent=80).where("group_size > 1").count()
    batch = {"meeting": [1, 1], "node": [5, 6], "n": [9, 10]}
    classes = jaccard_join.class_counts(np.repeat([0, 1], [9, 10]), np.arange(19, dtype=np.uint64) % 10, np.array([9, 10]))
    table = pa.RecordBatch.from_pydict(batch | {"classes": classes})
    assert links == 2 and sum(b.num_rows for b in jaccard_join._near([table], 80)) == 1
    monkeypatch.setattr(jaccard_join, "cells", lambda counts, reach: np.zeros((1, len(counts)), bool))
    assert sum(b.num_rows for b in jaccard_join._near([table], 80)) == 0


def test_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_join(docs).count() == 0
    assert jaccard_join.keep_one(docs).count() == 0


def test_one_of_each_group_stays(spark):
    rows = noisy(4, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in jaccard_join.keep_one(docs).collect()}
    assert kept == {c for d, _, c in brute_components(rows, 5, 80) if d == c}


def test_repeated_ids_and_clashing_columns_lose_no_document(spark):
    a, b = "one two three four five six seven", "a text that nobody else has written"
    rows = [(1, a), (5, a), (5, b), (1, a), (None, a), (7, None), (7, ""), (None, b)]
    docs = spark.createDataFrame([(d, t, 0, "x", "y") for d, t in rows], "doc_id long, text string, row long, __gone string, id string")
    got = jaccard_join.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, a), (5, b), (7, None), (7, "")], key=str)


def test_partitions_of_empty_texts_and_one_very_long_text(spark):
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert {tuple(r) for r in jaccard_join.jaccard_join(empty).collect()} == {(1, 0, 1, 1), (2, 0, 2, 1)}
    assert {(r["n_words"], r["n_hit"]) for r in decontaminate.scan(empty, bench).collect()} == {(0, 0)}
    assert decontaminate.remove_documents(empty, bench).count() == jaccard_join.keep_one(empty).count() == 2
    text = " ".join(f"w{i}" for i in range(300_000))
    long = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short")], "doc_id long, text string")
    assert {tuple(r)[:3] for r in jaccard_join.jaccard_join(long).collect()} == {(1, 299_996, 1), (2, 299_997, 1), (3, 1, 3)}
    assert {r["n_words"] for r in decontaminate.scan(long, bench).collect()} == {300_000, 300_001, 1}


def test_exact_dedup(spark):
    long = "A sentence of some length. " * 800
    rows = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, long), (8, long.upper()), (9, long + "!"), (9, long + "!"), (None, "ab"), (10, "x" * 9000), (11, "x" * 9001)]
    docs = spark.createDataFrame([(d, t, 0, "k") for d, t in rows], "doc_id long, text string, keep_id long, recipe string")
    got = sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()), key=str)
    norm = [(d, (t or "").translate(LOWER)) for d, t in rows]
    want = []
    for d, t in norm:
        same = [x for x, y in norm if y == t]
        keep = max((x for x in same if x is not None), default=None)
        want.append((d, keep, len(same), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    clashing = exact_dedup.exact_dedup(docs, bits=4)  # identifiers that stand for several chunks are split
    assert sorted(map(tuple, clashing.collect()), key=str) == got


def test_a_third_of_all_rows_in_one_group(spark):
    rows = [(i, "the very same text" if i % 3 == 0 else f"text number {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.exact_dedup(docs).where("group_size > 1").collect()
    assert len(got) == 1000 and {(r["keep_id"], r["group_size"]) for r in got} == {(2997, 1000)} and sum(r["kept"] for r in got) == 1
    near = jaccard_join.jaccard_join(docs, words=3, percent=90).where("group_size > 1").collect()
    assert len(near) == 1000 and {(r["component_id"], r["group_size"]) for r in near} == {(0, 1000)}


def test_chunks_rebuild_the_text_and_follow_content(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abc .\n日") for _ in range(20000))
    df = spark.createDataFrame([(text,), ("zz" + text,)], "text string")
    a, b = (r[0] for r in df.select(exact_dedup.chunks(F.col("text"))).collect())
    assert "".join(a) == text and max(map(len, a)) <= exact_dedup.MOST
    assert len(set(a) & set(b)) > len(a) // 2


def brute_windows(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = [(str(n), w) for n, t in items for ws in [words(t)] if ws for size in [min(10, len(ws))] for i in range(len(ws) - size + 1) for w in [tuple(ws[i : i + size])]]
    out = []
    for d, t in rows:
        ws, hit, found = words(t), set(), set()
        for n, w in windows:
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(n)
        out.append((d, len(ws), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_windows_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = ["un", "Deux", "drei", "été", "4", "x"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([3, 4, 9, 10, 12, 25, 30, 6])] + [(20, ""), (21, None), (3, text(11))]
    filled = [x for x in items if x[1]]
    rows = [(i, text(rng.choice([0, 2, 20, 60])) + (rng.choice(filled)[1] if i % 2 else text(30))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, items[5][1]), (102, items[4][1] + items[5][1]), (102, items[4][1] + items[5][1])]
    docs = spark.createDataFrame([(d, t, 1, []) for d, t in rows], "doc_id long, text string, n_hit long, items array<string>")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_windows(rows, items)
    for block in (1 << 20, 200):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = decontaminate.scan(docs, bench).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == want
        clean = {d for d, _, hit, _ in want if not hit}
        assert {r["doc_id"] for r in decontaminate.remove_documents(docs, bench).collect()} == clean
        cleaned = decontaminate.remove_spans(docs, bench)
        assert cleaned.columns == docs.columns
        by = {(r["doc_id"], r["text"]) for r in cleaned.collect()}
        assert {(d, t) for d, t in rows if d in clean} <= by
    assert decontaminate.scan(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.scan(docs.limit(0), bench).count() == 0


def test_class_counts_bound_differences_and_part_long_texts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (5000, 5000, 4200, 3, 2047, 2100, 40000)]
    sets.append(np.sort(np.concatenate([sets[0][200:], rng.integers(0, 2**63, 100, dtype=np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    apart = jaccard_join.least_apart(jaccard_join.class_counts(np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets), sizes))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert apart[i, j] == apart[j, i] <= len(np.setxor1d(a, b))
    assert apart[0, 1] * 180 > 20 * 10000 > apart[0, 7] * 180
