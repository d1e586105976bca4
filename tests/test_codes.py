"""Two-stage vector search against brute force, and how much of the table it reads."""

import re

import numpy as np
import pytest

from quern.operators import codes, rank


def unit(rng, n, d):
    m = rng.normal(size=(n, d)).astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def table(spark, m, ids=None):
    return spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids if ids is not None else range(len(m)), m, strict=True)], "id long, vec array<float>")


def found(df):
    return {q: [i for _, i in sorted(rows)] for q, rows in _by_query(df).items()}


def _by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    return out


@pytest.mark.parametrize("scale", [1.0, 1e-6, 3e4])
def test_equals_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(codes, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    m = unit(rng, 800, 24) * rng.uniform(0.1, 9, (800, 1)).astype(np.float32) * np.float32(scale)
    m[9] = 0
    coded = codes.encode(table(spark, m).repartition(5), block_rows=50)
    asked = table(spark, m[:70:10], range(0, 70, 10)).withColumnRenamed("id", "query_id")
    got = found(codes.nearest(coded, asked, 12))
    for q in range(0, 70, 10):
        scores = m.astype(np.float64) @ m[q].astype(np.float64)
        assert got[q] == np.lexsort((np.arange(800), -scores))[:12].tolist()


def test_bounds_hold_and_few_rows_stay_open(spark):
    rng = np.random.default_rng(3)
    m = unit(rng, 4000, 64)
    coded = codes.encode(table(spark, m), block_rows=500)
    asked = table(spark, m[:4]).withColumnRenamed("id", "query_id")
    rows = codes.open_rows(coded, asked, 20).collect()
    exact = m.astype(np.float64) @ m[:4].astype(np.float64).T
    assert all(r["low"] <= exact[r["id"], r["query_id"]] <= r["high"] for r in rows)
    for q in range(4):
        still = {r["id"] for r in rows if r["query_id"] == q}
        assert set(np.argsort(-exact[:, q])[:20].tolist()) <= still and len(still) < 60


def test_bytes_read(spark):
    """Codes, and the blocks that one query opens, are at most a third of the vectors' bytes. The blocks' part falls as the table grows: of 6,000 rows it is 8 %."""
    rng = np.random.default_rng(4)
    m = unit(rng, 16000, 256)
    coded = codes.encode(table(spark, m), block_rows=64)
    asked = table(spark, m[:1]).withColumnRenamed("id", "query_id")
    result = codes.nearest(coded, asked, 3)
    assert [r["id"] for r in result.collect()][0] == 0
    sizes = {f: spark.sparkContext._jvm.java.io.File(re.sub("^file:/*", "/", f)).length() for d in coded for f in d.inputFiles()}
    blocks = {r["block"] for r in codes.open_rows(coded, asked, 3).collect()}
    whole = sum(sizes[f] for f in coded.vectors.inputFiles())
    opened = sum(sizes[f] for f in coded.vectors.inputFiles() if int(re.search(r"block=(\d+)", f)[1]) in blocks)
    assert sum(sizes[f] for f in coded.codes.inputFiles()) + opened <= whole / 3
    assert "dynamicpruning" in result._jdf.queryExecution().optimizedPlan().toString()


def test_nothing_nulls_copies_and_filters(spark):
    rng = np.random.default_rng(5)
    m = np.repeat(unit(rng, 1, 8), 40, 0)
    df = table(spark, m).unionByName(spark.createDataFrame([(99, None)], "id long, vec array<float>"))
    coded = codes.encode(df, block_rows=10)
    asked = table(spark, m[:1]).withColumnRenamed("id", "query_id")
    assert found(codes.nearest(coded, asked, 5)) == {0: [0, 1, 2, 3, 4]}
    assert found(codes.nearest(coded._replace(codes=coded.codes.where("id >= 30")), asked, 5)) == {0: [30, 31, 32, 33, 34]}
    assert len(found(codes.nearest(coded, asked, 100))[0]) == 40
    assert codes.nearest(coded, asked.limit(0), 5).count() == 0
    assert codes.nearest(codes.encode(df.limit(0)), asked, 5).count() == 0


def test_same_rows_as_one_stage(spark):
    rng = np.random.default_rng(6)
    m = unit(rng, 900, 16)
    asked = table(spark, m[::100], range(0, 900, 100)).withColumnRenamed("id", "query_id")
    assert found(codes.nearest(codes.encode(table(spark, m)), asked, 30)) == found(rank.nearest(table(spark, m), asked, 30))
