"""Retrieval quality, thresholds, percentiles and error rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_item_metrics(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row: queries with relevant contents, MRR@10, Hit@5, and the share of them that is among the first five. results: (query_id, content_id, rank), relevant: (query_id, content_id)."""
    wanted = relevant.distinct()
    total = wanted.groupBy("query_id").agg(F.count("*").alias("total"))
    hits = results.join(wanted, ["query_id", "content_id"])
    per = hits.groupBy("query_id").agg(F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first"), F.count_if(F.col("rank") <= 5).alias("top5"))
    both = total.join(per, "query_id", "left")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    return both.agg(F.count("*").alias("queries"), mean(1 / F.col("first")).alias("mrr_10"), mean((F.col("top5") > 0).cast("double")).alias("hit_5"), mean(F.col("top5") / F.col("total")).alias("found_5"))


def threshold_rates(top: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, flagged_relevant, flagged_other) of first results (cosine, is_relevant): shares below each threshold."""
    taus = F.explode(F.array(*map(F.lit, thresholds)))
    return top.withColumn("threshold", taus).groupBy("threshold").agg(
        F.round(F.avg(F.when(F.col("is_relevant"), (F.col("cosine") < F.col("threshold")).cast("double"))), 6).alias("flagged_relevant"),
        F.round(F.avg(F.when(~F.col("is_relevant"), (F.col("cosine") < F.col("threshold")).cast("double"))), 6).alias("flagged_other"),
    )


def nearest_rank(rows: DataFrame, value: str, shares: list[float], by: str) -> DataFrame:
    """(by, share, value) at index floor(n * share) of the sorted values: not interpolated.

    Values are counted first, so a window holds distinct values, not rows.
    """
    from pyspark.sql import Window

    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(value)
    upto = counted.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    asked = upto.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    place = F.least(F.floor(F.col("total") * F.col("share")), F.col("total") - 1)
    return asked.where((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place)).select(by, "share", value)


def word_errors(said: Column, heard: Column) -> Column:
    """Edits of words between two texts; Arrow batches. Time goes with the product of the lengths, memory with one of them: a row of the table is one numpy step."""

    def distance(a: list[str], b: list[str]) -> int:
        numbers: dict[str, int] = {}
        x, y = ([numbers.setdefault(w, len(numbers)) for w in words] for words in (a, b))
        heard, at = np.array(y, np.int64), np.arange(len(y) + 1)
        row = at
        for i, word in enumerate(x, 1):
            best = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (heard != word))])
            row = np.minimum.accumulate(best - at) + at  # words left out: one more for each place to the right
        return int(row[-1])

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([distance((x or "").lower().split(), (y or "").lower().split()) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, "long")(said, heard)


def word_error_rate(pairs: DataFrame, said: str, heard: str) -> DataFrame:
    words = F.size(F.filter(F.split(F.lower(F.coalesce(said, F.lit(""))), r"\s+"), lambda w: w != ""))
    return pairs.select(word_errors(F.col(said), F.col(heard)).alias("e"), words.alias("n")).agg(F.round(F.sum("e") / F.sum("n"), 6).alias("wer"))
