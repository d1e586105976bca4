"""Folder requests matched to folder names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import base_name
from quern.operators.joins import cut, small

# Words that requests for folders leave out.
STOP = ("the", "a", "an", "my", "our", "of", "for", "with", "and", "in", "on", "to", "from", "about", "all", "some", "stuff", "things")


def stems(text: Column) -> Column:
    kept = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: (F.char_length(w) > 1) & ~w.isin(*STOP))
    return F.transform(kept, lambda w: F.regexp_replace(F.regexp_replace(w, "(ies)$", "y"), "(es|s)$", ""))


def match(queries: DataFrame, folders: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, folder, score, place): two points for a stem in the name, one for a beginning of three letters or more.

    Candidates come from an equi-join, not from all pairs: a name can only score by an equal stem, or by stems that
    share their first letter pair or one-letter stem, so both sides are exploded by the beginnings that decide.
    """
    q = queries.select("query_id", stems(F.col("query")).alias("qs"))
    n = folders.select("folder", stems(base_name(F.col("folder"))).alias("ns")).distinct()
    starts = lambda c: F.array_distinct(F.transform(F.filter(c, lambda w: w != ""), lambda w: F.substring(w, 1, 1)))
    names = cut(n.select("folder", "ns", F.explode(starts(F.col("ns"))).alias("letter")))
    # a stem that lost all its letters is a beginning of any word
    blank = cut(n.where(F.exists("ns", lambda w: w == "")))
    asked = q.select("query_id", F.explode(F.array_distinct("qs")).alias("w"), "qs").select("query_id", "w", F.size(F.filter("qs", lambda x: x == F.col("w"))).alias("times"))
    hits = asked.withColumn("letter", F.substring("w", 1, 1)).join(small(names), "letter").select("query_id", "w", "times", "folder", "ns")
    loose = asked.join(small(blank), F.char_length("w") >= 0).select("query_id", "w", "times", "folder", "ns")
    point = F.when(F.array_contains("ns", F.col("w")), 2).when((F.char_length("w") >= 3) & F.exists("ns", lambda x: F.startswith(x, F.col("w")) | F.startswith(F.col("w"), x)), 1).otherwise(0)
    points = hits.unionByName(loose).distinct().select("query_id", "folder", (point * F.col("times")).alias("points"))
    scored = points.groupBy("query_id", "folder").agg(F.sum("points").cast("int").alias("score")).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.size(F.split("folder", "/")), F.asc("folder"))
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
