"""URL filter: a blocked Bloom filter passes possible hits, an exact hash join takes out the false ones.

The list has entries of two kinds, both as canonical URLs (host, path): rules, which hold for a host with all its subdomains and for
all paths that begin with theirs, and whole URLs, which hold for themselves. A URL asks for a handful of keys: its canonical form, and
for each shape of a rule (labels of the host, characters of the path) the part of it that such a rule would be.

The filter has a block of 256 bits for each two dozen entries; an entry sets two bits in each of the four words of one block, which its hash
names. Blocks are put together by bit_or before the shuffle, 64 of them lie in one row, and there are never more than MOST_SEGMENTS
such rows, so what is broadcast is at most 32 MB however long the list gets. A list beyond that only makes more false hits, and these
are removed by the join with the list itself, which is broadcast if it has been counted to be short and shuffled with hot keys spread otherwise.
Columns only: no row leaves the JVM, and only ids, hosts and paths of hits are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import UPPER, column, cut, small, spread_join, table, tidy

#: Fixed by the contract: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Entries a block of 256 bits is made for, blocks in a row of the filter, and rows of the filter.
PER_BLOCK, BLOCKS, MOST_SEGMENTS = 20, 64, 1 << 14


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://"."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("rule "), host, F.lit(" "), path)


def _url_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("url "), host, F.lit(" "), path)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def listed_urls(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(key, rule, verdict, labels, letters) of rules (host, path, verdict) and of whole URLs (host, path), which are blocked.

    Repeated entries are one; of rules alike in host and path the one that blocks holds. Entries without a host are none.
    """
    of_rules = rules.select(_rule_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict", _labels(F.col("host")).alias("labels"), F.char_length("path").alias("letters"), F.col("host").alias("host"))
    of_urls = urls.select(_url_key(F.col("host"), F.col("path")).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(None).cast("int").alias("labels"), F.lit(None).cast("int").alias("letters"), F.col("host").alias("host"))
    entries = of_rules.unionByName(of_urls).where("host <> ''")
    return entries.groupBy("key").agg(F.max("verdict").alias("verdict"), *(F.first(c).alias(c) for c in ("rule", "labels", "letters")))


def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and the bits that it sets in the block's four words."""
    bits = F.xxhash64(key, F.lit("bits"))
    slot = lambda i: F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    one = F.lit(1).cast("long")
    shifted = [F.call_function("shiftleft", one, slot(i)) for i in range(8)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long"), [shifted[2 * w].bitwiseOR(shifted[2 * w + 1]) for w in range(4)]


def blocks_for(entries: int) -> int:
    """A power of two."""
    blocks = BLOCKS
    while blocks * PER_BLOCK < entries and blocks < BLOCKS * MOST_SEGMENTS:
        blocks *= 2
    return blocks


def bloom_filter(entries: DataFrame, blocks: int) -> DataFrame:
    """(segment, words) of the keys of entries: the four words of each of the segment's BLOCKS blocks."""
    block, words = _places(F.col("key"), blocks)
    filled = entries.select(block.alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(words))).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)))
    zero = F.array_repeat(F.lit(0).cast("long"), 4)
    at = F.map_from_entries(F.collect_list(F.struct(F.pmod("block", F.lit(BLOCKS)).cast("int"), F.array(*(f"w{i}" for i in range(4))))))
    held = filled.groupBy(F.floor(F.col("block") / BLOCKS).alias("segment")).agg(at.alias("at"))
    return held.select("segment", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda i: F.coalesce(F.try_element_at("at", i), zero))).alias("words"))


def possible(asked: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows of asked whose key may be in the filter; no key of the list is lost."""
    block, words = _places(F.col("key"), blocks)
    first = (F.pmod(block, F.lit(BLOCKS)) * 4).cast("int")
    hit = F.lit(True)
    for w, mask in enumerate(words):
        hit = hit & (F.get("words", first + w).bitwiseAND(mask) == mask)
    return asked.join(F.broadcast(bloom), F.floor(block / BLOCKS) == F.col("segment")).where(hit).select(*asked.columns)


def url_verdicts(pages: DataFrame, rules: DataFrame, urls: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, listed, verdict) of every row.

    The rule with the longest host and path of those that fit decides, of equally long ones that with the longer host, then one that blocks;
    without a rule a URL is blocked if it is listed and allowed if not. rules: (host, path, verdict); urls: (host, path). A null URL and one without
    "://" have an empty host and path, fit no rule and are never listed. Rules of other than "/"-led or empty paths fit nothing.
    Repeated rows and null ids are judged alike; no rows give no rows, and an empty list allows all. Other columns aren't looked at.
    """
    entries = cut(listed_urls(rules, urls))
    shapes = [(r["labels"], r["letters"]) for r in entries.where("labels is not null").select("labels", "letters").distinct().collect()]  # lengths, not entries
    base = cut(pages.select(F.monotonically_increasing_id().alias("row"), column(id_col).alias("id"), host_of(column(url_col)).alias("host"), path_of(column(url_col)).alias("path")))
    labels = _labels(F.col("host"))
    asks = [F.when((labels >= n) & (F.char_length("path") >= k), _rule_key(F.substring_index("host", ".", -n), F.substring("path", 1, k))) for n, k in sorted(shapes)]
    asked = base.where("host <> ''").select("row", F.explode(F.array_compact(F.array(_url_key(F.col("host"), F.col("path")), *asks))).alias("key"))
    blocks = blocks_for(entries.count())
    hits = cut(possible(asked, cut(bloom_filter(entries, blocks)), blocks))
    listing = entries.select("key", "rule", "verdict", F.char_length("rule").alias("length"), F.char_length("rule") - F.col("letters"))
    listing = listing.toDF("key", "rule", "verdict", "length", "of_host")
    if entries.limit(SHORT + 1).count() <= SHORT:
        exact = hits.join(F.broadcast(listing), "key")
    else:
        counted = cut(hits.groupBy("key").agg(F.count("*").alias("asked")).join(listing, "key"))
        exact = spread_join(hits, counted, ["key"], "asked").where("asked is not null")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct("length", "of_host", "verdict", "rule")))
    judged = exact.groupBy("row").agg(best.alias("best"), F.bool_or(F.col("rule").isNull()).alias("listed"))
    both = base.join(judged, "row", "left")
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return both.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("listed", F.lit(False)).alias("listed"), verdict.alias("verdict"))


#: Entries of the list that may be broadcast: at most some 20 MB.
SHORT = 100_000


def repeated_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """(host, path) of canonical URLs that more than one row has: pages which a crawl has fetched again and again."""
    named = pages.select(host_of(column(url_col)).alias("host"), path_of(column(url_col)).alias("path")).where("host <> ''")
    return named.groupBy("host", "path").agg(F.count("*").alias("n")).where("n > 1").select("host", "path")


@tidy
def op12_url_filter(spark, sf_dir: str) -> DataFrame:
    """url_verdicts() of all pages, for the contract's rules and a list of the URLs that several pages have; the cases are those of url_verdicts()."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_verdicts(pages, rules, repeated_urls(pages))


SQL = r"""
WITH p AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
j AS (
    SELECT *, host <> '' AND count(*) OVER (PARTITION BY host, path) > 1 AS listed,
           (SELECT max({'n': length(h || p), 'h': length(h), 'v': v, 'r': h || p}) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best
    FROM (SELECT page_id, host, path FROM p))
SELECT page_id, host, path, best.r AS rule, listed, coalesce(best.v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""
