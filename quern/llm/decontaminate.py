"""Benchmark decontamination: a broadcast hash set of the test n-grams, scanned over training token windows.

The set is flat arrays: sorted 64-bit hashes of the distinct windows, the place and the items of each, and the items' normalised
words, by which every distinct window of a text that is hit is verified once. It takes some five bytes for each byte of the items, so a block of BLOCK_BYTES bounds
what the driver builds and what a task holds. A larger benchmark is scanned for block by block; the passes write row numbers and hits of those rows alone that have any,
and these are joined to the rows at the end. Texts are never written again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.bytewords import ALNUM, Words, slices
from quern.llm.common import column, cut, fields, parts, small, table, tidy, whole_row

WINDOW = 10
#: Bytes of item texts in one broadcast; a larger benchmark is scanned for block by block.
BLOCK_BYTES = 16 << 20
#: Runs of hit words: first word and the one behind the last, and the same in code points.
RUNS = "array<struct<word:long,end:long,start:long,stop:long>>"


class NgramSet:
    """Windows of items by their number of words: sorted hashes, the item of each, and where its words start and end in `data`.

    data holds the items' words, one space between two. Equal windows of one item stand there once.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.names = [n for n, _ in items]
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        data, base = [], 0
        for first, raw, off in slices(pa.array([t or "" for _, t in items], pa.string())):
            words = Words(raw, off, ALNUM)
            length = words.end - words.start
            start = base + np.concatenate([[0], np.cumsum(length + 1)])[:-1] if len(length) else length
            stop = start + length
            data.append(_joined(words))
            base += len(data[-1])
            for size in {min(window, int(c)) for c in words.counts if c}:
                at, value = words.windows(size)
                own = np.ones(len(at), bool) if size == window else words.counts[words.text[at]] == size
                at, value = at[own], value[own]
                found.setdefault(size, []).append((value, first + words.text[at], start[at], stop[at + size - 1]))
        self.data = np.concatenate([np.zeros(0, np.uint8), *data])
        self.sizes = {}
        for size, pieces in found.items():
            value, item, start, stop = (np.concatenate(x) for x in zip(*pieces, strict=True))
            numbers: dict[bytes, int] = {}  # equal windows once
            name = np.array([numbers.setdefault(self.data[a:b].tobytes(), len(numbers)) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], np.int64)
            order = np.lexsort((item, name, value))
            value, item, name, start, stop = value[order], item[order].astype(np.int32), name[order], start[order], stop[order]
            fresh = np.append(True, (name[1:] != name[:-1]) | (item[1:] != item[:-1]))[: len(name)]
            value, item, name, start, stop = (v[fresh] for v in (value, item, name, start, stop))
            first = np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)])
            self.sizes[size] = (value[first], np.append(first, len(name)), item, start[first], stop[first])

    def matches(self, size: int, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words of the verified occurrences of windows of so many words; text and item of each pair of a text and an item that meet."""
        hashes, bounds, items, start, stop = self.sizes[size]
        at, value = words.windows(size)
        low, high = np.searchsorted(hashes, value, "left"), np.searchsorted(hashes, value, "right")
        hit = np.flatnonzero(high > low)
        count = (high - low)[hit]
        which = np.repeat(low[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)  # one, unless hashes collide
        at = np.repeat(at[hit], count)
        kept = np.zeros(len(at), bool)
        for i, (a, w) in enumerate(zip(at.tolist(), which.tolist(), strict=True)):
            kept[i] = self.data[start[w] : stop[w]].tobytes() == b" ".join(words.data[words.start[j] : words.end[j]].tobytes() for j in range(a, a + size))
        at, which = at[kept], which[kept]
        met = np.unique(np.stack([words.text[at], which], 1), axis=0).reshape(-1, 2)  # a window that a text repeats, once
        count = bounds[met[:, 1] + 1] - bounds[met[:, 1]]
        own = np.repeat(bounds[met[:, 1]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return at, np.repeat(met[:, 0], count), items[own]


def _joined(words: Words) -> np.ndarray:
    """The words' bytes in order, each followed by a space."""
    length = words.end - words.start
    out = np.full(int(length.sum()) + len(length), 32, np.uint8)
    to = np.repeat(np.cumsum(length + 1) - length - 1, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[to] = words.data[np.repeat(words.start, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)]
    return out


def _scan(batches: Iterator[pa.RecordBatch], grams: Broadcast, every: bool) -> Iterator[pa.RecordBatch]:
    """(id, n_words, runs, items) of every row, or of those with hits."""
    sets: NgramSet = grams.value
    for batch in batches:
        for first, data, off in slices(batch.column("text")):
            words = Words(data, off, ALNUM)
            step = np.zeros(len(words.hash) + 1, np.int64)
            items: dict[int, set[str]] = {}
            for size in sets.sizes:
                at, text, item = sets.matches(size, words)
                np.add.at(step, at, 1)
                np.add.at(step, at + size, -1)
                for t, i in zip(text.tolist(), item.tolist(), strict=True):
                    items.setdefault(t, set()).add(sets.names[i])
            hit = np.cumsum(step[:-1]) > 0
            edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
            new = np.zeros(len(hit) + 1, bool)
            new[words.bounds[:-1]] = True
            start, stop = np.flatnonzero((edge == 1) | (new & np.append(hit, False) & np.append(False, hit))), np.flatnonzero((edge == -1) | (new & np.append(False, hit) & np.append(hit, False)))
            owner = words.text[start] if len(start) else np.zeros(0, np.int64)
            points = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)]) if len(start) else np.zeros(1, np.int64)
            place = (points[words.start[start]], points[words.end[stop - 1]]) if len(start) else (start, stop)
            columns = [start - words.bounds[owner], stop - words.bounds[owner], *(v - points[off[owner]] for v in place)]
            lists = pa.array(np.searchsorted(owner, np.arange(words.texts + 1)), pa.int32())
            runs = pa.ListArray.from_arrays(lists, pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["word", "end", "start", "stop"]))
            named = pa.array([sorted(items.get(i, ())) for i in range(words.texts)], pa.list_(pa.string()))
            out = pa.RecordBatch.from_arrays([batch.column("id").slice(first, words.texts), pa.array(words.counts.astype(np.int64)), runs, named], ["id", "n_words", "runs", "items"])
            yield out if every else out.filter(pa.array(np.bincount(owner, minlength=words.texts) > 0))


def _together(runs: Column) -> Column:
    """Runs that overlap or touch, made one."""

    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["word"].alias("word"), F.greatest(last["end"], run["end"]).alias("end"), last["start"].alias("start"), F.greatest(last["stop"], run["stop"]).alias("stop"))
        return F.when(F.size(done) == 0, F.array(run)).when(run["word"] > last["end"], F.concat(done, F.array(run))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer)))

    return F.aggregate(F.array_sort(runs), F.array().cast(RUNS), add)


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id_col, n_words, n_hit, items, spans) of every row: spans are code points (start, stop) of runs of hit words.

    The benchmark is grouped into blocks of at most BLOCK_BYTES (one item may be longer and stands alone). Each block is one
    broadcast and one narrow pass over the documents, which are never shuffled. With several blocks, rows are numbered in a table of ids and texts written once.
    Null and empty texts have no words. Items with null text have no windows; a null item id is named "".
    Items that repeat an id count once; repeated rows get equal results. Empty documents give no rows, an empty benchmark no hits.
    """
    spark = docs.sparkSession
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    items = benchmark.select(F.coalesce(column(item_col).cast("string"), F.lit("")).alias("item"), column(item_text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // (BLOCK_BYTES // 2)) or 1  # half as a margin for uneven hashing
    own = lambda b: items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else items
    made = lambda b: spark.sparkContext.broadcast(NgramSet([(r["item"], r["text"]) for r in own(b).collect()], window))
    more = f"n_words long, runs {RUNS}, items array<string>"
    if blocks == 1:
        found = rows.mapInArrow(partial(_scan, grams=made(0), every=True), fields(rows, ["id"], more))
    else:
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        numbered, hits = rows.select(F.struct("id", "row").alias("id"), "text"), None
        for b in range(blocks):
            grams = made(b)
            part = cut(numbered.mapInArrow(partial(_scan, grams=grams, every=b == 0), fields(numbered, ["id"], more)))
            grams.destroy()
            hits = part if hits is None else hits.unionByName(part)
            found = part if b == 0 else found
        hits = hits.where("size(items) > 0").select("id.row", "runs", "items").groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("all_runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("all_items"))  # one row a block
        both = found.select("id.id", "id.row", "n_words").join(small(cut(hits)), "row", "left")
        found = both.select("id", "n_words", F.when(F.col("all_runs").isNotNull(), _together(F.col("all_runs"))).otherwise(F.array().cast(RUNS)).alias("runs"), F.coalesce("all_items", F.array().cast("array<string>")).alias("items"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["word"])
    spans = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop")))
    return found.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", spans.alias("spans"))


def _whole(docs: DataFrame, benchmark: DataFrame, text_col: str, window: int) -> DataFrame:
    """scan() of docs with each whole row in the column `whole`."""
    return scan(docs.select(whole_row(docs.columns).alias("whole"), column(text_col).alias("text")), benchmark, "whole", window=window)


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without those that hold a benchmark window; one narrow pass, nothing joined.

    Null and empty texts hold none and stay; repeated rows stay or go together. An empty benchmark removes nothing,
    empty docs give no rows. Columns may have any names.
    """
    return _whole(docs, benchmark, text_col, window).where("n_hit = 0").select(*parts(docs.columns))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the hit spans cut out of the text; each cut leaves one space. Nulls, repeated rows and empty tables as in remove_documents()."""
    found = _whole(docs, benchmark, text_col, window)
    text = F.col("whole").getField(text_col)
    at = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.stop"))
    to = F.concat(F.col("spans.start"), F.array(F.char_length(text).cast("long")))
    kept = F.when(F.col("n_hit") == 0, text).otherwise(F.array_join(F.zip_with(at, to, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))), " "))
    return found.select(*(kept.alias(c) if c == text_col else own for c, own in zip(docs.columns, parts(docs.columns), strict=True)))


@tidy
def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """scan() of all documents for all benchmark items, with the items' digest; the cases are those of scan()."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
    FROM documents),
b AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
    FROM benchmark),
bw AS (
    SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS gram
    FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (
    SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS gram
    FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
hits AS (SELECT rid, i, n, item FROM dw JOIN bw USING (n, gram)),
per AS (
    SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS w FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid),
base AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN per USING (rid) LEFT JOIN its USING (rid))
SELECT * FROM base
"""
