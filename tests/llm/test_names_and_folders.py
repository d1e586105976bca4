"""Columns of any names, and who owns the folders that steps write."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from test_mix_and_shard import filled

from quern.llm import decontaminate, exact_dedup, html_extract, jaccard_join, license_scan, mixing, secret_scan, sharding, toxicity, warc
from quern.llm.common import cut, owned, shared_folder, tidy

SF = "/root/testdata/sf0.001"
ODD = {"my col": "1", "x.y": "'v'", "a`b": "2.0D", "row": "3", "whole": "'w'", "place": "5", "1;drop": "array(1)"}


def odd(df, **renamed):
    """df with columns of odd names, and some of its own renamed to such."""
    return df.withColumns({n: F.expr(e) for n, e in ODD.items()}).withColumnsRenamed(renamed)


def test_stages_keep_columns_of_any_name(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = odd(docs)
    for name, stage in pipeline.STAGES:
        plain, got = stage(spark, docs, SF), stage(spark, more, SF)
        assert got.columns == [*more.columns, *plain.columns[len(docs.columns) :]], name
        assert sorted(map(tuple, got.select("doc_id", "text", "`my col`", "`x.y`", "`a``b`").collect())) == sorted((*r, 1, "v", 2.0) for r in plain.select("doc_id", "text").collect()), name


def test_operators_take_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnsRenamed({"doc_id": "x.y", "text": "my text", "source": "a`b"}).withColumn("row", F.lit(1))
    names = {"id_col": "x.y", "text_col": "my text"}
    n = docs.count()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").withColumnsRenamed({"item_id": "i.d", "text": "its text"})
    assert decontaminate.scan(docs, items, **names, item_col="i.d", item_text_col="its text").columns[0] == "x.y"
    assert decontaminate.remove_spans(docs, items.withColumnsRenamed({"i.d": "item_id", "its text": "text"}), "my text").columns == docs.columns
    assert decontaminate.remove_spans(docs, items.withColumnsRenamed({"i.d": "item_id", "its text": "text"}), "my text").count() == n
    assert exact_dedup.exact_dedup(docs, **names).count() == jaccard_join.jaccard_join(docs, **names).count() == n
    assert mixing.mix(docs, **names, source_col="a`b").count() == sharding.shard(docs, **names).count() == license_scan.scan(docs, **names).count() == secret_scan.scan(docs, None, **names).count() == n
    assert set(jaccard_join.keep_one(docs, **names).columns) == set(docs.columns) == set(mixing.mixed_documents(docs, **names, source_col="a`b").columns)
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("doc_id", "x.y")
    field = toxicity.train(docs, labels, "x.y", "my text")
    assert toxicity.score(docs, field, "my text").columns == [*docs.columns, "toxic_score", "toxic_spans"]
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumnsRenamed({"page_id": "x.y", "url": "a`b", "html": "the html"})
    weights = html_extract.train(pages, "the html")
    assert html_extract.extract(pages, weights, "the html").columns == ["x.y", "a`b", "main_text"] and html_extract.extract(pages.select("the html"), weights, "the html").count() == pages.count()
    folder = shared_folder(spark)
    assert warc.read(warc.write(pages, folder, "x.y", "a`b", "the html"), folder).count() == pages.count()


def test_stages_composed_without_writing_between(spark):
    """What a stage's result reads stays while others run: in a row, twice, and from two threads."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    key = lambda df: sorted(map(str, df.select("doc_id", "shard").collect()))

    def composed():
        seen = docs
        for _, stage in pipeline.STAGES:
            seen = stage(spark, seen, SF)
        return seen

    want = key(pipeline.run(spark, SF))
    assert key(composed()) == want
    stage = dict(pipeline.STAGES)["mixing"]
    one, two = stage(spark, docs.where("doc_id % 2 = 0"), SF), stage(spark, docs.where("doc_id % 2 = 1"), SF)
    assert one.count() and two.count() and one.where("doc_id % 2 = 1").isEmpty()
    with ThreadPoolExecutor(2) as pool:
        both = [*pool.map(lambda n: stage(spark, docs.where(f"doc_id % 2 = {n}"), SF), range(2))]
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    assert [ids(x) for x in both] == [ids(one), ids(two)]


def written(spark):
    return {d for d in os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) if d.startswith("quern-")}


def test_folders_go_when_nothing_reads_them(spark):
    rows = spark.range(20).withColumn("k", F.col("id") % 3)

    @tidy
    def step(spark, rows):
        lost = cut(rows)
        return cut(lost.groupBy("k").count()).join(cut(rows.limit(5)), "k")

    before = written(spark)
    out = step(spark, rows)
    assert len(written(spark) - before) == 2 and out.count() == 5  # of three
    with owned(spark) as own:
        more = step(spark, rows)
        assert len(own.paths) == 2 and more.count() == 5
        own.only()
    assert len(written(spark) - before) == 2 and out.count() == 5

    @tidy
    def broken(spark, rows):
        cut(rows)
        raise KeyError

    with pytest.raises(KeyError):
        broken(spark, rows)
    assert len(written(spark) - before) == 2
    with ThreadPoolExecutor(1) as pool, owned(spark) as own:
        kept = pool.submit(cut, rows).result()  # not of this thread
        assert not own.paths
    assert kept.count() == 20


def test_mix_looks_digit_by_digit_into_ranks_and_equal_rows(spark, monkeypatch):
    """With few words filled at a time, budgets end deep inside ranks, and inside rows that are all alike."""
    rows = [(i, f"t{i} " + "w " * (i * 31 % 13), "a" if i % 2 else "b") for i in range(60)] + [(7, "one two three", "c")] * 500 + [(8, "w", "c")] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).persist()
    first = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "NEAR", 40)
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got)) == first
    size, taken = {}, {}
    for r in got:
        size[r["source"]], taken[r["source"]] = r["source_size"], taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - t) < 14 for s, t in filled(size).items())
    assert len({r["copies"] for r in got if r["source"] == "c" and r["doc_id"] == 7}) == 2  # a part of the rows that are alike
    docs.unpersist()
