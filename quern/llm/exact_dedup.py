"""Exact duplicates by recipes of content-defined chunks, with DataFrame functions only.

A text is cut where its content says so (a line break or sentence end after at least LEAST characters, and at MOST at
the latest), so equal stretches give equal chunks wherever they stand. Chunks are deduplicated to identifiers
(SHA-256); every identifier is verified to stand for one string, and is split where it stands for several. Documents
are then compared by their ordered lists of identifiers alone: a long text is cut and moved once, as chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, column, cut, spread_join, table, tidy

LEAST, MOST = 512, 4096
#: Bits of SHA-256 that name a chunk.
BITS = 256


def chunks(text: Column) -> Column:
    """Content-defined chunks, in order; together they are the text."""
    pattern = rf"(?s).{{{LEAST},{MOST - 1}}}?[\n.!?]|.{{1,{MOST}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(pieces: DataFrame, bits: int = BITS) -> DataFrame:
    """(id, recipe, text_sha256) of rows (id, row, chunks, text_sha256): lists of verified identifiers.

    Chunks are grouped by their bytes, partly before the shuffle. Where an identifier stands for several chunks, their
    order numbers them, and the number goes behind the identifier in the recipes of the rows that hold them.
    """
    name = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, bits // 4))
    distinct = pieces.select(F.explode("chunks").alias("chunk")).groupBy("chunk").agg(F.lit(1).alias("one")).select(name("chunk").alias("name"), "chunk")
    shared = cut(distinct.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"))
    plain = F.transform("chunks", name)
    if shared.isEmpty():
        return pieces.select("id", plain.alias("recipe"), "text_sha256")
    order = Window.partitionBy("name").orderBy("chunk")
    numbers = distinct.join(shared, "name", "left_semi").select("chunk", F.row_number().over(order).cast("string").alias("number"))
    placed = pieces.select("row", F.posexplode("chunks").alias("at", "chunk")).join(numbers, "chunk")
    split = placed.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "number"))).alias("numbers"))  # of one text
    numbered = F.transform("chunks", lambda c, i: F.concat(name(c), F.encode(F.coalesce(F.try_element_at("numbers", i), F.lit("")), "UTF-8")))
    both = pieces.join(split, "row", "left")
    return both.select("id", F.when(F.col("numbers").isNull(), plain).otherwise(numbered).alias("recipe"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256) of every row, copies included.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id is kept.
    Null counts as empty; empty texts are equal. Null ids are smaller than any other; rows that repeat the kept
    id are all kept. An empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select(column(id_col).alias("id"), ascii_lower(F.coalesce(column(text_col), F.lit(""))).alias("text"))
    pieces = cut(rows.select("id", F.monotonically_increasing_id().alias("row"), chunks(F.col("text")).alias("chunks"), F.sha2("text", 256).alias("text_sha256")))
    listed = cut(recipes(pieces, bits).withColumn("key", F.xxhash64("recipe")))
    groups = cut(listed.groupBy("key", "recipe").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))
    joined = spread_join(listed, groups, ["key", "recipe"], "group_size")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )


@tidy
def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """exact_dedup() of all documents; the cases are those of exact_dedup()."""
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
