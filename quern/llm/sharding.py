"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws -ln(u) / weight, u from a hash of the key and the child's name; the least draw
wins. A child's draw depends on nothing but itself, so rows leave or enter a subtree only if its weight
changes. New shards come as regions of their own (grow), so that one more shard takes rows only into itself.
Columns only: no row leaves the JVM, and rows are shuffled only to number them inside their shards, without texts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import column, cut, free_name, small, table, tidy

SHARDS = 40
#: Hexadecimal digits of the hash by whose ranges the rows of a shard are numbered: 16 to this power ranges.
SLOT_DIGITS = 2


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(shards: int, base: int = SHARDS, regions: int = 4, racks: int = 5) -> list[Leaf]:
    """The tree of `shards` shards: the first `base` in regions of racks, each later one in a region of its own."""
    each = -(-base // regions)
    per_rack = -(-each // racks)
    leaves = [Leaf(f"g{i // each}", f"g{i // each}.k{i % each // per_rack}", i) for i in range(min(shards, base))]
    for i in range(base, shards):
        leaves = grow(leaves, i)
    return leaves


def grow(leaves: list[Leaf], shard: int, weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, as a region of its own: no other subtree's weight changes."""
    return [*leaves, Leaf(f"g+{shard}", f"g+{shard}.k", shard, weight)]


def _draw(key: Column, name: Column, weight: Column) -> Column:
    """From 52 bits of an MD5, the same on every engine."""
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), name)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    return -F.log(u) / weight


def _choice(key: Column, children: Column) -> Column:
    """The name of the child with the least draw; children: array<struct<name, weight>>."""
    return F.array_min(F.transform(children, lambda c: F.struct(_draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name"))))["name"]


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of each key in the tree."""
    held: dict[str, dict[str, dict[str, float]]] = {"": {}}
    for x in leaves:
        regions, racks, shards = held[""], held.setdefault(x.region, {}), held.setdefault(x.rack, {})
        shards[str(x.shard)] = x.weight
        for up, name in ((regions, x.region), (racks, x.rack)):
            up[name] = up.get(name, 0.0) + x.weight
    array = lambda by: F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in by.items()))
    below = F.create_map(*(x for name, by in held.items() if name for x in (F.lit(name), array(by))))
    rack = _choice(key, F.element_at(below, _choice(key, array(held[""]))))
    return _choice(key, F.element_at(below, rack)).cast("int")


def _key(id_col: str) -> Column:
    return F.coalesce(column(id_col).cast("string"), F.lit("null"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot, grown_shard) of every row; size is UTF-8 bytes plus 16.

    The id and the number of shards alone decide; repeated ids stand together, null ids as one id. Null and empty
    texts have 16 bytes and the checksum 0. Slots number each shard's rows from 0 without gaps, by ranges of a hash
    of id and checksum and then by id, checksum and size: the same in every run. No rows give no rows.
    """
    text = F.encode(F.coalesce(column(text_col), F.lit("")), "UTF-8")
    sized = docs.select(column(id_col).alias("id"), _key(id_col).alias("key"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("crc"))
    placed = cut(sized.select(
        "id", "size", "crc", shard_of(F.col("key"), tree(shards)).alias("shard"), shard_of(F.col("key"), tree(shards + 1)).alias("grown"),
        F.substring(F.md5(F.concat_ws(":", "key", F.col("crc").cast("string"))), 1, SLOT_DIGITS).alias("range"),
    ))
    counts = cut(placed.groupBy("shard", "range").agg(F.count("*").alias("n")))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # at most so many rows as shards times ranges
    inside = Window.partitionBy("shard", "range").orderBy("id", "crc", "size")
    return placed.withColumn("nth", F.row_number().over(inside) - 1).join(small(cut(starts)), ["shard", "range"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("nth")).alias("slot"), F.col("grown").alias("grown_shard")
    )


def sharded(docs: DataFrame, id_col: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """docs with their shard as the last column, `shard`, or if docs has such a column, that name and "_"; no row moves.

    Null ids are one id, repeated rows stand together, texts aren't looked at. No rows give no rows.
    """
    return docs.withColumn(free_name(docs, "shard"), shard_of(_key(id_col), tree(shards)))


@tidy
def op5_hash_tree_shards(spark, sf_dir: str) -> DataFrame:
    """shard() of all documents, law `key`; the cases are those of shard()."""
    rows = shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _level_sql(name: str, above: str, own: str, parent: str | None, shards: int) -> str:
    """The child with the least draw below each document's parent."""
    weights: dict[tuple, float] = {}
    for leaf in tree(shards):
        at = (getattr(leaf, parent) if parent else "", str(getattr(leaf, own)))
        weights[at] = weights.get(at, 0.0) + leaf.weight
    children = ", ".join(f"('{p}', '{n}', {w})" for (p, n), w in weights.items())
    on = f"{above}.at = c.parent" if parent else "true"
    return f"""{name} AS (
    SELECT rid, any_value(key) AS key, min({{'d': -ln((('0x' || substr(md5(key || ':' || c.name), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / c.w, 'n': c.name}}).n AS at
    FROM {above} JOIN (VALUES {children}) c(parent, name, w) ON {on} GROUP BY rid)"""


def _tree_sql(name: str, shards: int) -> str:
    levels = (("region", "d", None), ("rack", f"{name}_region", "region"), ("shard", f"{name}_rack", "rack"))
    return ", ".join(_level_sql(f"{name}_{own}", above, own, parent, shards) for own, above, parent in levels)


SQL = rf"""
WITH b AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, coalesce(text, '') AS text FROM documents),
r AS (SELECT list(c ORDER BY i) AS r FROM (
    SELECT i, list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT) AS c FROM range(256) t(i))),
d AS (
    SELECT rid, doc_id, key, strlen(text) + 16 AS size,
           xor(list_reduce([('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(encode(text)), '..')], lambda c, x: xor(c // 256, r[xor(c, x) % 256 + 1]), 4294967295::BIGINT), 4294967295) AS crc
    FROM b, r),
{_tree_sql("now", SHARDS)}, {_tree_sql("then", SHARDS + 1)}
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, n.at::INTEGER AS shard,
       row_number() OVER (PARTITION BY n.at ORDER BY substr(md5(d.key || ':' || crc), 1, {SLOT_DIGITS}), doc_id NULLS FIRST, crc, size) - 1 AS slot, t.at::INTEGER AS grown_shard
FROM d JOIN now_shard n USING (rid) JOIN then_shard t USING (rid)
"""
