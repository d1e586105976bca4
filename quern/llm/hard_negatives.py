"""Hard negatives by vantage-point trees over norm-augmented vectors.

A row x gets one more coordinate, sqrt(M^2 - |x|^2), M the largest norm, and an anchor a gets 0 there. Then |x' - a'|^2 = M^2 + |a|^2 - 2 * score: the highest
scores are the nearest rows, and a window of scores is an annulus around the anchor. Distances only choose where to look; scores are exact integers.

1. Upper tree: vantage points and median radii, fitted on SAMPLE rows, deal every row to a cell. Large cells (a vector may be a third of the
   table) are dealt on by row into blocks of about the same size, so no task gets a group that grows with the table.
2. Each block becomes a vantage-point tree of its own: halves by distance from a vantage point, down to leaves, with the least and largest
   distance of each half. A block is one row of a written table.
3. Anchors go in packs of neighbours. Packs meet blocks by the triangle inequality alone: summaries hold the ranges of distances to the upper
   vantage points. A pack first searches the blocks of its own cells, which gives each anchor a radius, and then those others that the radius reaches.
4. In a block, leaves are taken nearest first, beginning at the annulus' inner edge; the radius shrinks to the k-th row found, and an anchor ends
   with its first leaf outside. A task goes through several blocks of one pack, nearest first, with the same radii.

The search runs twice: for the first rows of the anchor's own label, and for those of other labels inside the windows that these give. It is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import column, cut, small, table, tidy

#: Rows that the upper tree is fitted on, its most cells, and vantage points that the summaries use.
SAMPLE, CELLS, PIVOTS = 8192, 1024, 15
#: Least and most rows of a block; between them a SPREAD-th of the table.
LEAST_BLOCK, MOST_BLOCK, SPREAD = 1 << 10, 1 << 16, 64
#: Rows of a leaf in small blocks, anchors of a pack, and blocks that a task goes through for one pack.
LEAF, PACK, WALK = 64, 512, 16
#: Products of whole numbers below this are exact in doubles.
EXACT = 2.0**53
#: Rows with a larger square norm have scores that no long holds.
MOST_NORM = 2.0**62
NONE = -(1 << 63)


class Space(NamedTuple):
    """What all vectors share: length, bytes of a component, largest square norm."""

    dims: int
    kind: str
    top: float

    def read(self, data: bytes) -> np.ndarray:
        """The vectors as numbers whose products are exact."""
        whole = np.frombuffer(data, self.kind).reshape(-1, self.dims)
        return whole.astype(np.float64 if self.top < EXACT else np.int64)

    def heights(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))

    def between(self, x: np.ndarray, hx: np.ndarray, v: np.ndarray, hv: np.ndarray) -> np.ndarray:
        """Distances of rows x to rows v, their heights given."""
        return np.sqrt(np.maximum(2 * self.top - 2 * (x.astype(np.float64) @ v.astype(np.float64).T + np.outer(hx, hv)), 0))

    def radius(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a row has this score to an anchor of this square norm."""
        return np.sqrt(np.maximum(self.top + square - 2 * score.astype(np.float64), 0))

    @property
    def slack(self) -> float:
        """More than distances are wrong by."""
        return 1e-6 * np.sqrt(self.top) + 1e-9


class Upper(NamedTuple):
    """The upper tree in heap order: vantage points, their heights, radii."""

    points: np.ndarray
    heights: np.ndarray
    radii: np.ndarray

    def cells(self, space: Space, x: np.ndarray) -> np.ndarray:
        at, hx = np.zeros(len(x), np.int64), space.heights(x)
        x = x.astype(np.float64)
        while len(self.radii) and len(at) and at[0] < len(self.radii):
            near = 2 * space.top - 2 * ((x * self.points[at]).sum(1) + hx * self.heights[at])
            at = 2 * at + 1 + (np.sqrt(np.maximum(near, 0)) > self.radii[at])
        return at - len(self.radii)


def fitted(space: Space, sample: np.ndarray, depth: int) -> Upper:
    """A tree of 2 ** depth cells from sample rows; each vantage point is the row furthest from its set's mean."""
    x = sample.astype(np.float64)
    h, nodes = space.heights(x), (1 << depth) - 1
    points, heights, radii = np.zeros((nodes, space.dims)), np.zeros(nodes), np.zeros(nodes)
    held = {0: np.arange(len(x))}
    for node in range(nodes):
        own = held.pop(node)
        if len(own):
            v = own[np.argmax(((x[own] - x[own].mean(0)) ** 2).sum(1))]
            points[node], heights[node] = x[v], h[v]
            away = space.between(x[own], h[own], x[[v]], h[[v]])[:, 0]
            radii[node] = np.median(away)
            held[2 * node + 1], held[2 * node + 2] = own[away <= radii[node]], own[away > radii[node]]
        else:
            held[2 * node + 1] = held[2 * node + 2] = own
    return Upper(points, heights, radii)


def _placed(batches: Iterator[pa.RecordBatch], space: Space, upper: Upper) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("q")
        size = np.diff(lists.offsets.to_numpy())
        whole = np.zeros((batch.num_rows, space.dims), np.int64)
        row = np.repeat(np.arange(batch.num_rows), size)
        whole[row, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy(zero_copy_only=False)
        stored = whole.astype(space.kind)
        vectors = pa.array([r.tobytes() for r in stored], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "label", "anchor")), vectors, pa.array(upper.cells(space, whole), pa.int64())], ["row", "id", "label", "anchor", "vector", "cell"])


def _halves(space: Space, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, vantage places, ranges) of a block's tree: node i of level l holds the places from i * n >> l to (i + 1) * n >> l of order."""
    n = len(x)
    depth = max(0, min(int(np.ceil(np.log2(max(n / LEAF, 1)))), int(np.ceil(np.log2(max(n, 1)) / 2))))
    h, order, vantage, ranges = space.heights(x), np.arange(n), [], []
    for level in range(depth):
        for i in range(1 << level):
            own = order[i * n >> level : (i + 1) * n >> level]
            y = x[own].astype(np.float64)
            v = own[np.argmax(((y - y.mean(0)) ** 2).sum(1))]
            away = space.between(x[own], h[own], x[[v]], h[[v]])[:, 0]
            by = np.argsort(away, kind="stable")
            order[i * n >> level : (i + 1) * n >> level] = own[by]
            middle = ((2 * i + 1) * n >> (level + 1)) - (i * n >> level)
            away = away[by]
            vantage.append(v)
            ranges.append([[away[0], away[middle - 1]], [away[middle], away[-1]]])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place[np.array(vantage, np.int64)], np.array(ranges, np.float64).reshape(-1, 2, 2)


BLOCK = "block long, cell long, least array<double>, most array<double>, rows binary, ids binary, void binary, labels binary, vectors binary, vantage binary, ranges binary"


def _block(rows: pd.DataFrame, space: Space, upper: Upper) -> pd.DataFrame:
    x = space.read(b"".join(rows["vector"]))
    order, vantage, ranges = _halves(space, x)
    away = space.between(x, space.heights(x), upper.points[:PIVOTS], upper.heights[:PIVOTS])
    rows = rows.iloc[order]
    whole = np.frombuffer(b"".join(rows["vector"]), space.kind)
    void = rows["id"].isna().to_numpy()
    ids = rows["id"].fillna(0).to_numpy(np.int64)
    packed = [a.tobytes() for a in (rows["row"].to_numpy(np.int64), ids, void, rows["label"].to_numpy(np.int64), whole, vantage, ranges)]
    return pd.DataFrame([[rows["block"].iloc[0], rows["cell"].iloc[0], away.min(0).tolist(), away.max(0).tolist(), *packed]], columns=[c.split()[0] for c in BLOCK.split(", ")])


PACKED = "pack long, cell long, least array<double>, most array<double>, reach double, inner double, anchors binary, windows binary, queries binary, vectors binary"
#: Of each query: label, least and largest score, and the score that it has k rows of already.
QUERY = np.dtype([("label", "i8"), ("lo", "i8"), ("hi", "i8"), ("bound", "i8")])


def _pack(rows: pd.DataFrame, space: Space, upper: Upper) -> pd.DataFrame:
    x = space.read(b"".join(rows["vector"])).astype(np.float64)
    square = (x * x).sum(1)
    queries = np.zeros(len(rows), QUERY)
    for name in QUERY.names:
        queries[name] = rows[name].to_numpy(np.int64)
    least = np.maximum(queries["lo"], queries["bound"])
    reach = np.where(least == NONE, np.inf, space.radius(square, np.where(least == NONE, 0, least))).max() + space.slack
    inner = np.where(queries["hi"] == -NONE - 1, 0, space.radius(square, np.where(queries["hi"] == -NONE - 1, 0, queries["hi"]))).min() - space.slack
    away = np.sqrt(np.maximum(square[:, None] + space.top - 2 * x @ upper.points[:PIVOTS].T, 0))
    packed = [rows["anchor_row"].to_numpy(np.int64).tobytes(), rows["w"].to_numpy(np.int64).tobytes(), queries.tobytes(), b"".join(rows["vector"])]
    return pd.DataFrame([[rows["pack"].iloc[0], rows["group"].iloc[0], away.min(0).tolist(), away.max(0).tolist(), reach, inner, *packed]], columns=[c.split()[0] for c in PACKED.split(", ")])


class Walk:
    """One pack on its way through blocks: for each query the best k rows so far, and the score that a further row needs."""

    def __init__(self, pack: dict, space: Space, k: int, same: bool) -> None:
        self.space, self.k, self.same = space, k, same
        self.anchors, self.windows, self.queries = np.frombuffer(pack["anchors"], np.int64), np.frombuffer(pack["windows"], np.int64), np.frombuffer(pack["queries"], QUERY)
        self.x = space.read(pack["vectors"])
        self.square = (self.x.astype(np.float64) ** 2).sum(1)
        n = len(self.queries)
        self.least = np.maximum(self.queries["lo"], self.queries["bound"]).copy()
        self.held = np.zeros(n, np.int64)
        self.best = {name: np.zeros((n, k), kind) for name, kind in (("score", np.int64), ("void", bool), ("id", np.int64), ("row", np.int64))}
        hi = self.queries["hi"]
        self.inner = np.where(hi == -NONE - 1, 0.0, space.radius(self.square, np.where(hi == -NONE - 1, 0, hi)) - space.slack)

    def outer(self) -> np.ndarray:
        return np.where(self.least == NONE, np.inf, self.space.radius(self.square, np.where(self.least == NONE, 0, self.least)) + self.space.slack)

    def leaves(self, block: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance of each query to a row of each leaf, by the triangle inequality."""
        vantage, ranges = np.frombuffer(block["vantage"], np.int64), np.frombuffer(block["ranges"], np.float64).reshape(-1, 2, 2)
        away = self.space.radius(self.square[:, None], self.x @ x[vantage].T) if len(vantage) else None
        low, high, node = np.zeros((len(self.x), 1)), np.full((len(self.x), 1), np.inf), 0
        while node < len(vantage):
            d, r = away[:, node : node + low.shape[1], None], ranges[node : node + low.shape[1]][None]
            node += low.shape[1]
            low = np.maximum(low[:, :, None], np.maximum(d - r[..., 1], r[..., 0] - d)).reshape(len(self.x), -1)
            high = np.minimum(high[:, :, None], d + r[..., 1]).reshape(len(self.x), -1)
        return low, high

    def search(self, block: dict) -> None:
        x = self.space.read(block["vectors"])
        rows, ids, void, labels = (np.frombuffer(block[c], t) for c, t in (("rows", np.int64), ("ids", np.int64), ("void", bool), ("labels", np.int64)))
        low, high = self.leaves(block, x)
        count, n = low.shape[1], len(x)
        key = np.where(high < self.inner[:, None], np.inf, np.maximum(low, self.inner[:, None]))  # leaves inside the annulus' inner edge come never
        order = np.argsort(key, axis=1, kind="stable")
        key = np.take_along_axis(key, order, 1)
        for step in range(count):
            active = np.flatnonzero((key[:, step] <= self.outer()) & np.isfinite(key[:, step]))
            if not len(active):
                break
            found = []
            leaf_of = order[active, step]
            for leaf in np.unique(leaf_of):
                own, start, stop = active[leaf_of == leaf], leaf * n // count, (leaf + 1) * n // count
                score = (self.x[own] @ x[start:stop].T).astype(np.int64)
                fits = (score >= self.least[own, None]) & (score <= self.queries["hi"][own, None])
                alike = labels[None, start:stop] == self.queries["label"][own, None]
                fits &= (alike & (rows[None, start:stop] != self.anchors[own, None])) if self.same else ~alike
                q, at = np.nonzero(fits)
                if len(q):
                    found.append((own[q], score[q, at], at + start))
            if found:
                q, score, at = (np.concatenate(c) for c in zip(*found, strict=True))
                self.take(q, score, void[at], ids[at], rows[at])

    def take(self, q: np.ndarray, score: np.ndarray, void: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Merges further rows into the best of their queries."""
        touched = np.unique(q)
        old = np.repeat(touched, self.held[touched])
        place = np.arange(len(old)) - np.repeat(np.cumsum(self.held[touched]) - self.held[touched], self.held[touched])
        both = {name: np.concatenate([self.best[name][old, place], new]) for name, new in (("score", score), ("void", void), ("id", ids), ("row", rows))}
        q = np.concatenate([old, q])
        by = np.lexsort((both["row"], both["id"], both["void"], -both["score"], q))
        q = q[by]
        nth = np.arange(len(q)) - np.searchsorted(q, q, "left")
        by, q, nth = by[nth < self.k], q[nth < self.k], nth[nth < self.k]
        for name, values in both.items():
            self.best[name][q, nth] = values[by]
        self.held[touched] = np.bincount(q, minlength=len(self.held))[touched]
        full = touched[self.held[touched] == self.k]
        self.least[full] = np.maximum(self.least[full], self.best["score"][full, self.k - 1])

    def rows(self) -> pa.RecordBatch:
        q = np.repeat(np.arange(len(self.held)), self.held)
        nth = np.arange(len(q)) - np.repeat(np.cumsum(self.held) - self.held, self.held)
        ids = pa.array(self.best["id"][q, nth], pa.int64(), mask=self.best["void"][q, nth])
        columns = [self.anchors[q], self.windows[q], self.best["row"][q, nth], ids, self.best["score"][q, nth]]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], ["anchor_row", "w", "row", "id", "score"])


def _walked(batches: Iterator[pa.RecordBatch], space: Space, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    at, walk = None, None
    for batch in batches:
        packs, slices = batch.column("pack").to_pylist(), batch.column("slice").to_pylist()
        for i, key in enumerate(zip(packs, slices, strict=True)):
            if key != at:
                if walk is not None:
                    yield walk.rows()
                at, walk = key, Walk(batch.column("own")[i].as_py(), space, k, same)
            walk.search(batch.column("held")[i].as_py())
    if walk is not None:
        yield walk.rows()


FOUND = "anchor_row long, w long, row long, id long, score long"


class Index(NamedTuple):
    space: Space
    upper: Upper
    depth: int
    blocks: DataFrame
    count: int
    anchors: DataFrame
    packs: int


def _index(base: DataFrame) -> Index | None:
    """The written tree over rows (row, id, label, anchor, q); None if there are none."""
    biggest = F.array_max(F.transform("q", lambda c: F.abs(c)))
    n, dims, top, widest, anchors = base.agg(F.count("*"), F.max(F.size("q")), F.max("norm"), F.max(biggest), F.count_if("anchor")).first()
    if not n:
        return None
    kind = "<i2" if (widest or 0) < 1 << 15 else "<i4" if widest < 1 << 31 else "<i8"
    space = Space(max(dims, 1), kind, float(top))
    each = min(MOST_BLOCK, max(LEAST_BLOCK, n // SPREAD))
    depth = int(np.log2(min(max(1, -(-n // each)), CELLS)))
    sample = np.zeros((min(n, SAMPLE), space.dims))
    for i, r in enumerate(base.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("q").collect()):
        sample[i, : len(r["q"])] = r["q"]
    upper = fitted(space, sample, depth)
    placed = cut(base.select("row", "id", "label", "anchor", "q").mapInArrow(partial(_placed, space=space, upper=upper), "row long, id long, label long, anchor boolean, vector binary, cell long"))
    counts = placed.groupBy("cell").agg(F.ceil(F.count("*") / each).cast("int").alias("parts"))
    number = F.struct("cell", F.pmod(F.xxhash64("row"), F.col("parts")))
    blocks = cut(placed.join(F.broadcast(counts), "cell").withColumn("block", F.xxhash64(number)).groupBy("block").applyInPandas(lambda rows: _block(rows, space, upper), BLOCK))  # at most CELLS counts
    packs = max(1, anchors // PACK)
    shift = depth - min(depth, int(np.log2(packs)))
    group = F.shiftright("cell", shift)
    own = placed.where("anchor").select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"), "label", "vector", group.alias("group"))
    counted = own.groupBy("group").agg(F.ceil(F.count("*") / PACK).cast("int").alias("parts"))
    own = own.join(F.broadcast(counted), "group").withColumn("pack", F.xxhash64("group", F.pmod(F.xxhash64("anchor_row"), F.col("parts")))).drop("parts")
    return Index(space, upper, shift, blocks, blocks.count(), cut(own), packs)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "w").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """The best k rows of each query (pack, group, anchor_row, w, vector, label, lo, hi) with their rank."""

    space, upper = index.space, index.upper

    def packed(rows: DataFrame) -> DataFrame:
        return cut(rows.groupBy("pack").applyInPandas(lambda rows: _pack(rows, space, upper), PACKED))

    def walked(packs: DataFrame, home: bool) -> DataFrame:
        own = F.shiftright(F.col("b.cell"), index.depth) == F.col("p.cell")
        zipped = lambda f: F.array_max(F.transform(F.sequence(F.lit(0), F.size("b.least") - 1), f)) if len(upper.radii) else F.lit(0.0)
        gap = F.greatest(F.lit(0.0), zipped(lambda i: F.greatest(F.get("b.least", i) - F.get("p.most", i), F.get("p.least", i) - F.get("b.most", i))))
        span = -zipped(lambda i: -(F.get("b.most", i) + F.get("p.most", i))) if len(upper.radii) else F.lit(float("inf"))
        near = own if home else ~own & (gap <= F.col("p.reach")) & (span >= F.col("p.inner"))
        summary = index.blocks.select("block", "cell", "least", "most")
        met = packs.select("pack", "cell", "least", "most", "reach", "inner").alias("p").join(small(summary).alias("b"), near)  # a set of queries in packs against all rows in blocks
        slices = -(-index.count // WALK)
        pairs = met.select("pack", "block", gap.alias("gap"), F.pmod("block", F.lit(slices)).alias("slice"))
        whole = pairs.join(packs.select("pack", F.struct("anchors", "windows", "queries", "vectors").alias("own")), "pack").join(index.blocks.select("block", F.struct("rows", "ids", "void", "labels", "vectors", "vantage", "ranges").alias("held")), "block")
        return whole.repartition("pack", "slice").sortWithinPartitions("pack", "slice", "gap").select("pack", "slice", "own", "held").mapInArrow(partial(_walked, space=space, k=k, same=same), FOUND)

    queries = cut(queries)
    first = cut(_best(walked(packed(queries.withColumn("bound", F.lit(NONE))), True), k).drop("rank"))
    bounds = first.groupBy("anchor_row", "w").agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
    again = queries.join(bounds, ["anchor_row", "w"], "left").withColumn("bound", F.coalesce("bound", F.lit(NONE)))
    return cut(_best(first.unionByName(walked(packed(again), False)), k))


def hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    Components become floor(scale * x), a score is the inner product. An anchor's positives are its first other rows of the same label, a positive's
    negatives the first rows of other labels whose score is from low to high percent of the positive's; higher scores come first, ties by smaller id.
    ids and labels are whole numbers. Rows with a null label or vector, or a null or not finite component, take no part, nor do those whose square norm
    is 2^62 or more. Shorter vectors count as if zeros followed. A null id comes after all others; rows that repeat an id are rows of their own, and
    each of them that `anchors` holds for is an anchor. Positives with a score below 0 have no negatives. An empty table gives no rows; other columns aren't looked at.
    """
    spark = rows.sparkSession
    vector = column(vector_col)
    ok = F.coalesce(~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    q = F.transform(vector, lambda c: F.floor(c.cast("double") * scale))
    base = rows.where(column(label_col).isNotNull() & ok).select(column(id_col).cast("long").alias("id"), column(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), q.alias("q"))
    norm = F.aggregate("q", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    base = cut(base.withColumn("norm", norm).where(F.col("norm") < MOST_NORM).withColumn("row", F.monotonically_increasing_id()))
    index = _index(base)
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    own = index.anchors
    asked = own.select("pack", "group", "anchor_row", F.lit(0).cast("long").alias("w"), "vector", "label", F.lit(NONE).alias("lo"), F.lit(-NONE - 1).alias("hi"))
    found = _search(index, asked, positives, True).select("anchor_row", F.col("rank").cast("long").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    exact = F.col("positive_score").cast("decimal(20,0)")
    windows = found.where("positive_score >= 0").select("anchor_row", "w", F.ceil(exact * low / 100).cast("long").alias("lo"), F.floor(exact * high / 100).cast("long").alias("hi"))
    asked = own.join(windows, "anchor_row").select("pack", "group", "anchor_row", "w", "vector", "label", "lo", "hi")
    chosen = _search(index, asked, negatives, False)
    named = found.join(own.select("anchor_row", "anchor_id"), "anchor_row")
    return chosen.join(named, ["anchor_row", "w"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


@tidy
def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """hard_negatives() of all embeddings, labels shifted where vec_id is divisible by 7; the cases are those of hard_negatives()."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


SQL = r"""
WITH e AS (
    SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
    SELECT a.rid AS arid, a.vec_id AS anchor_id, b.vec_id, b.rid, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM e AS a JOIN e AS b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id NULLS LAST, rid) AS w FROM s WHERE alike) WHERE w <= 5),
n AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.arid, p.w ORDER BY s.score DESC, s.vec_id NULLS LAST, s.rid)::INTEGER AS rank
    FROM p JOIN s ON p.arid = s.arid AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
