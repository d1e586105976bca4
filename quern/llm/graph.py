"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, spread_join


def components(edges: DataFrame) -> DataFrame:
    """(node, root): of each node of the edges (a, b) the smallest node that it reaches.

    Each round shortens the paths by a constant factor; the edges left are a star to each root. Rounds
    are written to the shared folder, so no lineage grows and a lost executor costs one round. The centre of a
    large star is a hot key of both joins of a round: spread_join() sees to it. No edges give no rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = cut(spread_join(both, least, ["a"], "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = spread_join(large, low, ["a"], "n").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = cut(small.where("a <> b").distinct())
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty():
            break  # only stars are left
    roots = now.groupBy("b").agg(F.lit(1)).select(F.col("b").alias("node"), F.col("b").alias("root"))
    return cut(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots))
