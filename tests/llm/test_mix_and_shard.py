"""Mixing, sharding and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import mixing, sharding, toxicity
from test_similar import brute_components, brute_windows

SF = "/root/testdata/sf0.001"


def filled(sizes: dict) -> dict:
    """Targets, by sharing out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        free -= over
    return target


def rows_of(n=400):
    texts = ["w " * (i * 7919 % 60) for i in range(n)]
    return [(i, t, [None, "b", "a", "ü", "C", "c"][i % 6 if i % 3 else 1]) for i, t in enumerate(texts)] + [(1000, None, "a"), (1001, "", None), (7, texts[7], "b"), (7, texts[7], "b"), (None, "x y z", "b")]


def test_mix(spark):
    rows = rows_of()
    df = spark.createDataFrame([(d, t, s, 5, 6) for d, t, s in rows], "doc_id long, text string, source string, size long, target long")
    got = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    want, taken = filled(total), Counter()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((d, s, size(t)) for d, t, s in rows)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == total[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 8 for s in total), (taken, want)
    again = mixing.mix(df.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    copies = mixing.mixed_documents(df)
    assert copies.columns == df.columns
    assert Counter((r["doc_id"], r["source"]) for r in copies.collect()) == Counter({k: v for k, v in sum((Counter({(r["doc_id"], r["source"]): r["copies"]}) for r in got), Counter()).items() if v})
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(df.where("text is null or text = ''")).collect()} == {0}


def test_a_document_too_long_for_the_budget_is_passed_over(spark):
    rows = [(0, "w " * 6000, "a")] + [(i, "w " * 100, "a") for i in range(1, 41)] + [(100 + i, "w " * 50, "b") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 100 for s in target), (taken, target)


def test_longer_documents_are_likelier_and_ranks_follow_their_odds(spark, monkeypatch):
    rows = [(i, f"t{i} " + "w " * (9 if i % 2 else 399), "a" if i < 2000 else "b") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).where("source = 'b'").collect()
    rate = got[0]["target"] / got[0]["source_size"]
    extra = lambda size: sum(r["copies"] - int(rate) for r in got if r["size"] == size) / sum(r["size"] == size for r in got)
    assert 5 < extra(400) / extra(10) < 8  # the square root of 40, drawn
    monkeypatch.setattr(mixing, "TILT", 0.0)
    flat = mixing.mix(docs).where("source = 'b'").collect()
    assert {r["doc_id"] for r in flat if r["copies"] > int(rate)} != {r["doc_id"] for r in got if r["copies"] > int(rate)}


def test_mixed_documents_may_have_any_columns(spark):
    rows = [(i % 50, "w " * (i % 7), "s", "own", i, 1.0) for i in range(200)] + [(None, "same", "s", "own", i, 1.0) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __mix string, whole long, rank double")
    got = mixing.mixed_documents(docs)
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"]] += r["copies"]
    assert got.columns == docs.columns and Counter(r["doc_id"] for r in got.collect()) == Counter({d: n for d, n in plan.items() if n})


def test_shards(spark):
    rows = [(i, f"é{i}" * (i % 5)) for i in range(4000)] + [(9999, None), (None, "x"), (3, "dup"), (3, "dup")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, shard long")
    got = sharding.shard(df).collect()
    assert len(got) == len(rows)
    slots, home = defaultdict(list), {}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        home.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 40)
    assert set(slots) == set(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, home.values())) == 1
    moved = sum(r["grown_shard"] == 40 for r in got)
    assert 0.5 * len(got) / 41 < moved < 1.6 * len(got) / 41
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sharding.shard(df.limit(0)).count() == 0 and sharding.sharded(df).where("shard = 1 and shard_ between 0 and 39").count() == len(rows)


def test_tree_equals_a_walk_in_plain_python(spark):
    def child(key, weights):
        u = {n: (int(hashlib.md5(f"{key}:{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for n in weights}
        return min(weights, key=lambda n: (-math.log(u[n]) / weights[n], n))

    leaves = [x._replace(weight=1.0 + x.shard % 3) for x in sharding.tree(11, 9, 3, 2)]

    def walk(key):
        below = defaultdict(lambda: defaultdict(float))
        for x in leaves:
            for at, n in (("", x.region), (x.region, x.rack), (x.rack, str(x.shard))):
                below[at][n] += x.weight
        return int(child(key, below[child(key, below[child(key, below[""])])]))

    keys = spark.range(500).select(F.col("id").cast("string").alias("k"))
    assert {r["k"]: r["s"] for r in keys.select("k", sharding.shard_of(F.col("k"), leaves).alias("s")).collect()} == {str(i): walk(str(i)) for i in range(500)}


def test_weights_confine_movement(spark):
    keys = spark.range(6000).withColumn("k", F.col("id").cast("string"))
    old = sharding.tree(12, 12, 3, 2)
    new = [x._replace(weight=2.0) if x.shard == 5 else x for x in old]
    rows = keys.select(sharding.shard_of(F.col("k"), old).alias("a"), sharding.shard_of(F.col("k"), new).alias("b")).collect()
    region = {x.shard: x.region for x in old}
    for r in rows:
        if r["a"] != r["b"]:
            assert region[r["b"]] == region[5]  # only the subtree whose weight rose takes rows
    share = Counter(r["b"] for r in rows)
    assert 1.5 < share[5] / (sum(v for k, v in share.items() if k != 5) / 11) < 2.6


def toxic_ids(spark, docs):
    """By the trained field's own score, one document at a time."""
    found = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    return {r["doc_id"] for r in found if r["toxic_score"] >= 0.5}


def test_pipeline_stages_equal_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages, kept, seen = dict(pipeline.STAGES), {}, docs
    for name, stage in pipeline.STAGES:
        kept[name] = seen
        seen = pipeline.cut(stage(spark, seen, SF))
        kept[f"{name} out"] = seen
        assert seen.columns == docs.columns or name == "sharding"
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert ids(kept["toxicity out"]) == sorted(set(ids(docs)) - toxic_ids(spark, docs))
    groups = brute_components(rows(kept["near_duplicates"]), 5, 80)
    assert ids(kept["near_duplicates out"]) == sorted(d for d, _, c in groups if d == c)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(kept["decontamination out"]) == sorted(d for d, _, hit, _ in brute_windows(rows(kept["decontamination"]), items) if not hit)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    size, taken = Counter(), Counter()
    for df, out in ((kept["mixing"], size), (seen, taken)):
        for r in df.select("source", "text").collect():
            out[r["source"]] += words(r["text"])
    longest = max(words(t) for _, t in rows(kept["mixing"]))
    assert all(abs(taken[s] - t) <= longest for s, t in filled(size).items()) and set(ids(seen)) <= set(ids(kept["mixing"]))
    assert max(Counter(ids(seen)).values()) <= 2 and seen.where("shard is null").isEmpty()
    whole = pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, seen.collect()), key=str)
    assert stages["sharding"](spark, whole, SF).columns[-1] == "shard_"


def test_pipeline_stages_on_odd_tables(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(1, None, "s", 1), (None, "", "s", 2), (1, None, "s", 1)], "doc_id long, text string, shard string, row long").coalesce(1).withColumn("source", F.lit(None).cast("string"))
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == (0 if name == "mixing" else 3), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
