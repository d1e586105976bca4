"""A corpus pipeline: toxic documents out, near copies out, benchmark leaks out, sources mixed, documents sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import cut, owned, table, tidy
from quern.llm.decontaminate import remove_documents
from quern.llm.jaccard_join import keep_one
from quern.llm.mixing import mixed_documents
from quern.llm.sharding import sharded
from quern.llm.toxicity import clean_documents


@tidy
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that a field trained on them and the labels doesn't reject. Null and empty texts stay; no rows give no rows."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of near copies (five words, 0.8), the first by id. Texts without words all stay."""
    return keep_one(docs, words=5, percent=80)


@tidy
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a window of a benchmark item. Null and empty texts stay."""
    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


@tidy
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix of sources takes them. Texts without words come as often as their source's certain copies."""
    return mixed_documents(docs)


@tidy
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with their shard in one more column. Null ids are one id; no rows give no rows."""
    return sharded(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: A trained score and exact similarity joins are beyond SQL here: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage: the columns of documents, and the shard. Every stage is written and read again, and what it wrote besides goes."""
    docs = table(spark, sf_dir, "documents")
    with owned(spark) as own:
        for _, step in STAGES:
            docs = cut(step(spark, docs, sf_dir))
            own.only(docs)
    return docs
