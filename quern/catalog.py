"""Registry of the library's queries and of the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.plans import search_queries, source_queries, store_queries, text_queries, voice_queries

PLANS = (store_queries, text_queries, search_queries, source_queries, voice_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of every benchmark text."""
    return search_queries.hybrid_top30(spark, sf_dir)


def queries() -> dict:
    return {name: query for plan in PLANS for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.SQL.items()}
