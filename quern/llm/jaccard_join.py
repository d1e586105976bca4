"""Exact Jaccard self-join of word-shingle sets as a metric-space join.

Sets live in the metric space of the Jaccard distance, of which the size of the symmetric difference is the plain form; sets at
most 1 - t apart are linked: |x ^ y| <= (1 - t) / (1 + t) * (|x| + |y|).

1. Pivots "the empty set" and "single shingles". The distance to the empty set is |x|: shells of sizes are its regions,
   and a set is replicated to the next shell only if the triangle inequality lets a linked set lie there. Of single
   shingles, rare ones first, a set's home is its rarest one, and it is replicated to as many further ones as a linked set
   may lack (|x| - ceil(t * |x|)). Linked sets meet in a region. Any fixed order of shingles is exact; a bounded
   table of frequent ones only makes it fast. Documents can't be pivots yet: nearly all pairs of texts lie at
   distance one, so that every window would hold every document.
2. In each region documents are the pivots. Distances are taken between counts of shingles in residue classes, a
   metric that is nowhere larger than the symmetric difference. A pivot is any set that no earlier pivot has within its reach r(x) =
   |x| * (1 - t) / t, the furthest that a linked set may lie. Each set goes to its home, the nearest pivot, and to all
   pivots at most 2 * r(x) further (triangle inequality: a linked set may have its home there). Sets that share a cell and
   whose counts differ by no more than linked sets may differ belong together.
3. Cells that overlap form one region of whole shingle sets; every link lies inside one. A region of more than REGION sets is divided again
   by document pivots, now by their Jaccard distances, with windows of 2 * (1 - t). This recurs LEVELS times. In a region
   that is too dense for it (more than COPIES homes a set) the pivots' links already make stars: of sets
   tied to one star no two need comparing, so only the others are compared, in blocks, with all.
4. Each region, now bounded, is joined in memory exactly; of its links a spanning forest is returned.

Shingles are compared by 64-bit hashes: exact means up to their collisions, of which some 10^-3 are to be expected in 10^8 shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bytewords import NOT_SPACE, Words, mix, slices, sums
from quern.llm.common import HOT_SHARE, column, cut, fields, free_name, small, spread_join, tidy
from quern.llm.graph import components

SHELL, REGION, LEVELS, PIVOTS, COPIES = 2.0, 256, 2, 12, 1.6
#: Shingles that are counted together in memory; those met LOCAL times there are candidates for the table of at most FREQUENT.
COUNTED, LOCAL, FREQUENT = 1 << 20, 3, 200_000
#: Least and most classes of shingles, both powers of two, and shingles of a set for each of its classes.
CLASSES, MOST_CLASSES, PER_CLASS = 128, 8192, 16
#: Sets of one meeting that are dealt to cells; the sets of a larger one all belong together until whole sets are compared.
MEETING = 1024
#: Parts in which the sets of a very frequent shingle are dealt out, and pivots of a region at most.
SALTS, MOST_PIVOTS = 1024, 48
#: Columns of the dense 0/1 matrix by which a region's common shingles are counted.
COLUMNS = 2048
_ONE, _TWO, _THREE = np.uint64(0x1234567DEADBEEF1), np.uint64(0x9876543CAFEF00D3), np.uint64(0x5A5A5C3F1E2D3B49)


def identity(text: np.ndarray, value: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set."""
    return tuple(mix(sums(text, mix(value ^ seed), texts)).view(np.int64) for seed in (_ONE, _TWO))


def shells(largest: int, num: int) -> np.ndarray:
    """Lower bounds of the shells, up to one above the largest size."""
    low = [1]
    while low[-1] <= largest:
        low.append(max(low[-1] + 1, int(np.ceil(low[-1] * max(SHELL, 100 / num)))))
    return np.array([*low, int(np.ceil(low[-1] * max(SHELL, 100 / num))) + 1], np.int64)


class Rarity:
    """How often frequent shingles are met; all others count 0."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(shingles)
        self.shingles, self.counts = shingles[order], counts[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(shingles >> np.uint64(42)).astype(np.int64)] = True

    def of(self, value: np.ndarray) -> np.ndarray:
        out = np.zeros(len(value), np.int64)
        some = np.flatnonzero(self.maybe[(value >> np.uint64(42)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.shingles, value[some]), len(self.shingles) - 1)
            out[some] = np.where(self.shingles[at] == value[some], self.counts[at], 0)
        return out


def rarest(text: np.ndarray, value: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, rarity: Rarity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, how often it is met) of the `wanted` rarest shingles of each set; ties by value. text, value: sorted, as Words.shingles gives them."""
    often = rarity.of(value)
    rare = often == 0
    seen = np.cumsum(rare)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    before = np.append(0, seen)[starts[:-1]]
    chosen = rare & (seen - before[text] <= wanted[text])
    for i in np.flatnonzero(np.append(0, seen)[starts[1:]] - before < wanted):
        own = slice(starts[i], starts[i + 1])
        chosen[own] = False
        chosen[starts[i] + np.lexsort((value[own], often[own]))[: wanted[i]]] = True
    return text[chosen], value[chosen], often[chosen]


def region_keys(text: np.ndarray, value: np.ndarray, sizes: np.ndarray, num: int, rarity: Rarity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, how often its shingle is met) of the regions that each set enters."""
    low = shells(int(sizes.max(initial=0)), num)
    own = np.searchsorted(low, sizes, "right") - 1
    # where no difference is allowed only equal sets link
    wanted = np.where(2 * (sizes * 100 // num) * (100 - num) // (100 + num) > 0, sizes - -(-sizes * num // 100) + 1, 0)
    row, shingle, often = rarest(text, value, sizes, wanted, rarity)
    further = sizes * 100 // num >= low[np.minimum(own + 1, len(low) - 1)]
    keys = mix(shingle ^ mix(own[row].astype(np.uint64) + np.uint64(1)))
    again = further[row]
    next_keys = mix(shingle[again] ^ mix(own[row[again]].astype(np.uint64) + np.uint64(2)))
    return np.concatenate([row, row[again]]), np.concatenate([keys, next_keys]), np.concatenate([often, often[again]])


def class_counts(text: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Each set's counts, up to 255, in as many classes as its size asks for. Two classes of one number make one of half that number."""
    bits = np.ceil(np.log2(np.clip(sizes / PER_CLASS, CLASSES, MOST_CLASSES))).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(1 << bits)])
    own = (mix(value ^ _THREE) >> (64 - bits[text]).astype(np.uint64)).astype(np.int64)
    whole = np.minimum(np.bincount(first[text] + own, minlength=first[-1]), 255).astype(np.uint8).tobytes()
    return [whole[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def folded(classes: bytes, n: int) -> np.ndarray:
    """The counts in n classes, up to 255."""
    return np.minimum(np.frombuffer(classes, np.uint8).reshape(n, -1).sum(1), 255).astype(np.int16)


def least_apart(classes: list[bytes]) -> np.ndarray:
    """For each two sets a lower bound of how many shingles one of them lacks: their counts' differences, in the classes of the one with fewer."""
    lengths = np.array([len(c) for c in classes])
    apart = np.zeros((len(classes), len(classes)), np.int64)
    for n in np.unique(lengths):
        more = np.flatnonzero(lengths >= n)
        counts = np.stack([folded(classes[i], n) for i in more])
        for i, row in zip(more, counts, strict=True):
            if lengths[i] == n:
                apart[i, more] = apart[more, i] = np.abs(counts - row).sum(1, dtype=np.int64)
    return apart


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple]:
    """(batch, first row, sizes, names, and of those sets that this task meets for the first time: rows, set of each shingle, shingles, sizes) of slices of rows."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for first, data, off in slices(batch.column("text")):
            words = Words(data, off, NOT_SPACE)
            text, value = words.shingles(k)
            sizes = np.bincount(text, minlength=words.texts).astype(np.int64)
            n1, n2 = identity(text, value, words.texts)
            fresh = np.zeros(words.texts, bool)
            for i, name in enumerate(zip(n1.tolist(), n2.tolist(), strict=True)):
                if sizes[i] and name not in seen:
                    seen.add(name)
                    fresh[i] = True
            picked = fresh[text]
            yield batch, first, sizes, (n1, n2), np.flatnonzero(fresh), (np.cumsum(fresh) - 1)[text[picked]], value[picked], sizes[fresh]


def _names(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Size and name of each text's set; its class counts only where the task meets the set first."""
    for batch, first, sizes, (n1, n2), rows, own, value, n in _sets(batches, k):
        classes: list[bytes | None] = [None] * len(sizes)
        for i, c in zip(rows, class_counts(own, value, n), strict=True):
            classes[i] = c
        yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(sizes)) for c in ("row", "id")), pa.array(sizes), pa.array(n1), pa.array(n2), pa.array(classes, pa.binary())], ["row", "id", "n", "n1", "n2", "classes"])


def _counted(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(shingle, met) of shingles that are met at least LOCAL times in COUNTED of them."""
    held, n = [], 0

    def often() -> pa.RecordBatch:
        shingle, met = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(shingle[met >= LOCAL].view(np.int64)), pa.array(met[met >= LOCAL])], ["shingle", "met"])

    for *_, value, _ in _sets(batches, k):
        held.append(value)
        n += len(value)
        if n >= COUNTED:
            yield often()
            held, n = [], 0
    if n:
        yield often()


def _regions(batches: Iterator[pa.RecordBatch], k: int, num: int, held: Broadcast, hot: int) -> Iterator[pa.RecordBatch]:
    """(key, salt, node): the regions that each set enters. Sets are dealt to parts of a region whose shingle is met more than `hot` times."""
    rarity = Rarity(*held.value)
    for _, _, _, (n1, _), rows, own, value, n in _sets(batches, k):
        at, keys, often = region_keys(own, value, n, num, rarity)
        node = n1[rows[at]]
        salt = np.where(often > hot, 1 + (node & (SALTS - 1)), 0)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(salt), pa.array(node)], ["key", "salt", "node"])


def _wanted(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Whole sets, each once a task."""
    for _, _, _, (n1, n2), rows, _, value, n in _sets(batches, k):
        ends = np.concatenate([[0], np.cumsum(n)])
        items = pa.array([value[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(n1[rows]), pa.array(n2[rows]), items], ["n1", "n2", "items"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, salt, node): (meeting, node, star) of keys with several nodes; meetings of the same nodes have one name.

    A key with more than MEETING nodes, or dealt out in parts, is a star around its own name: all its nodes belong
    together for now. Holds the last key's nodes between batches, MEETING at most.
    """
    last, held, large = (0, 0), np.zeros(0, np.int64), False

    def rows(meeting: np.ndarray, node: np.ndarray, star: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(meeting), pa.array(node), pa.array(star)], ["meeting", "node", "star"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, salt, node = (batch.column(c).to_numpy() for c in ("key", "salt", "node"))
        key, salt = (np.concatenate([np.full(len(held), v), new]) for v, new in zip(last, (key, salt), strict=True))
        node = np.concatenate([held, node])
        fresh = np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1]))
        key, salt, node = key[fresh], salt[fresh], node[fresh]
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
        size = np.diff(np.append(starts, len(key)))
        name = np.add.reduceat(mix(node.view(np.uint64)), starts).view(np.int64)
        star = (size > MEETING) | (salt[starts] > 0)
        star[0] = star[0] or (large and (key[0], salt[0]) == last)
        name[star] = mix(key[starts[star]].view(np.uint64)).view(np.int64)
        out = (size > 1) | star
        last, held = (key[-1], salt[-1]), node[starts[-1] :]
        large = bool(star[-1])
        if large:
            held = held[:0]
        else:
            out[-1] = False
        pick = np.repeat(out, size)
        yield rows(np.repeat(name, size)[pick], node[pick], np.repeat(star, size)[pick])
    if not large and len(held) > 1:
        yield rows(np.full(len(held), np.add.reduce(mix(held.view(np.uint64))).view(np.int64)), held, np.zeros(len(held), bool))


def cells(counts: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """(pivots, sets): which sets each pivot's cell holds, homes and windows, in the metric of summed differences of counts."""
    apart, covered = [], np.zeros(len(counts), bool)
    for i in range(len(counts)):
        if not covered[i]:
            apart.append(np.abs(counts - counts[i]).sum(1))
            covered |= apart[-1] <= reach
    apart = np.stack(apart)
    return apart <= apart.min(0) + 2 * reach


def _near(batches: Iterator[pa.RecordBatch], num: int) -> Iterator[pa.RecordBatch]:
    """Of rows (meeting, node, n, classes) sorted by meeting: a forest (a, b) of the nodes that may be linked."""
    held: list[tuple] = []
    last = None

    def solve() -> tuple[np.ndarray, np.ndarray]:
        node = np.array([r[0] for r in held], np.int64)
        if any(r[2] is None for r in held):  # two sets have one node number: all may be near
            return np.full(len(node) - 1, node[0]), node[1:]
        n = np.array([r[1] for r in held], np.int64)
        classes = [r[2] for r in held]
        least = min(map(len, classes))
        counts = np.stack([folded(c, least) for c in classes])
        cell = cells(counts, n * (100 - num) // num).astype(np.float32)
        together = cell.T @ cell > 0
        own = np.flatnonzero(together.sum(1) > 1)
        size = n[own]
        allowed = together[np.ix_(own, own)] & (least_apart([classes[i] for i in own]) * (100 + num) <= (100 - num) * (size[:, None] + size[None, :]))
        allowed &= (100 * size[:, None] >= num * size[None, :]) & (100 * size[None, :] >= num * size[:, None])
        root, far = _forest(allowed) if len(own) else (own, own)
        return node[own[root]], node[own[far]]

    for batch in batches:
        meeting, node, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("meeting", "node", "n"))
        classes = batch.column("classes").to_pylist()
        pairs = []
        for i, name in enumerate(meeting):
            if name != last:
                if len(held) > 1:
                    pairs.append(solve())
                held.clear()
                last = name
            held.append((node[i], n[i], classes[i]))
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in pairs])) for k in (0, 1)], ["a", "b"])
    if len(held) > 1:
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in solve()], ["a", "b"])


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) of all nodes that aren't the smallest of their component."""
    g = len(linked)
    root = np.arange(g, dtype=np.int32)
    while True:
        least = np.minimum(np.where(linked, root[None, :], np.int32(g)).min(1), root)
        if (least == root).all():
            break
        root = least
    far = np.flatnonzero(root != np.arange(g))
    return root[far], far


def _homes(batches: Iterator[pa.RecordBatch], num: int) -> Iterator[pa.RecordBatch]:
    """The Voronoi regions that each set enters, its nearest pivot's and those within the window, and, as bits, the pivots that it links with."""
    for batch in batches:
        items = [np.frombuffer(v, np.int64) for v in batch.column("items").to_pylist()]
        pivots = [[np.frombuffer(p, np.int64) for p in own] for own in batch.column("pivots").to_pylist()]
        homes, bits = [], []
        for x, own in zip(items, pivots, strict=True):
            if not own:  # no set was drawn as a pivot: one home, no links known
                homes.append([0])
                bits.append(0)
                continue
            common = np.array([len(np.intersect1d(x, p, assume_unique=True)) for p in own])
            union = np.array([len(x) + len(p) for p in own]) - common
            apart = 1 - common / union
            homes.append(np.flatnonzero(apart <= apart.min() + 2 * (100 - num) / 100 + 1e-9).tolist())
            bits.append(sum(1 << int(i) for i in np.flatnonzero(100 * common >= num * union)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("region", "n1", "n2", "items", "members")), pa.array(homes, pa.list_(pa.int32())), pa.array(bits, pa.int64())], ["region", "n1", "n2", "items", "members", "homes", "bits"])


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, members, stuck, tied) of rows (region, members, stuck, near, met): the pivots that sets tie to the one with most links, as bits."""
    for batch in batches:
        tied = []
        for near, met in zip(batch.column("near").to_pylist(), batch.column("met").to_pylist(), strict=True):
            bits, last = 1 << int(np.argmax(met)), 0
            while bits != last:
                last = bits
                for i, b in enumerate(near):
                    if bits >> i & 1:
                        bits |= b or 0
            tied.append(bits)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("region", "members", "stuck")), pa.array(tied, pa.int64())], ["region", "members", "stuck", "tied"])


def _joined(items: list[np.ndarray], num: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links of a region's sets."""
    g, n = len(items), np.array([len(v) for v in items], np.int64)
    value, column, often = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(g), n)
    place = np.cumsum(often > 1) - 1
    shared = often[column] > 1
    member, column = member[shared], place[column[shared]]
    common = np.zeros((g, g), np.int32)
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        dense = np.zeros((g, min(COLUMNS, int(column[hi - 1]) - a + 1)), np.float32)
        dense[member[lo:hi], column[lo:hi] - a] = 1
        common += (dense @ dense.T).astype(np.int32)
    linked = 100 * common >= num * (n[:, None] + n[None, :] - common)
    return _forest(linked)


def _regions_joined(batches: Iterator[pa.RecordBatch], num: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by region and set: the links' forest in each region. Holds one region between batches, each set once."""
    held: list[tuple[int, int, bytes]] = []

    def solve() -> tuple[np.ndarray, ...]:
        n1, n2 = (np.array([h[c] for h in held], np.int64) for c in (0, 1))
        a, b = _joined([np.frombuffer(h[2], np.int64) for h in held], num)
        held.clear()
        return n1[a], n2[a], n1[b], n2[b]

    last, found = None, []
    for batch in batches:
        for region, a, b, items in zip(*(batch.column(c).to_pylist() for c in ("region", "n1", "n2", "items")), strict=True):
            if region != last:
                if len(held) > 1:
                    found.append(solve())
                held.clear()
                last = region
            if not held or held[-1][:2] != (a, b):
                held.append((a, b, items))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*found, strict=True)], ["a1", "a2", "b1", "b2"])
            found = []
    if len(held) > 1:
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in solve()], ["a1", "a2", "b1", "b2"])


def _grouped(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(row, id, n, component, group_size, keep) of rows (row, id, text); keep: the row of its component that comes first by id."""
    names = cut(rows.mapInArrow(partial(_names, k=words), fields(rows, ["row", "id"], "n long, n1 long, n2 long, classes binary")))
    full = names.where("n > 0").select("row", "id", "n", "n1", "n2")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row")))
    nodes = cut(full.groupBy("n1", "n2").agg(first.alias("first"), F.count("*").alias("copies")))
    roots = cut(components(_links(rows, names, words, percent)).select("node.n1", "node.n2", "root"))
    grouped = nodes.join(small(roots), ["n1", "n2"]).groupBy("root").agg(F.min("first").alias("least"), F.sum("copies").alias("size"))
    linked = roots.join(small(cut(grouped)), "root")
    placed = nodes.join(small(cut(linked.drop("root"))), ["n1", "n2"], "left").withColumn("least", F.coalesce("least", "first")).withColumn("size", F.coalesce("size", "copies"))
    many = cut(placed.where("size > 1").select("n1", "n2", "least", "size", "copies"))
    alone = F.struct(F.lit(False).alias("none"), F.col("id"), F.col("row"))
    joined = spread_join(full, many, ["n1", "n2"], "copies").select("row", "id", "n", F.when(F.col("size").isNull(), alone).otherwise(F.col("least")).alias("least"), F.coalesce("size", F.lit(1)).alias("group_size"))
    both = joined.unionByName(names.where("n = 0").select("row", "id", "n", alone.alias("least"), F.lit(1).cast("long").alias("group_size")))
    return both.select("row", "id", "n", F.col("least.id").alias("component"), "group_size", F.col("least.row").alias("keep"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, group_size) of every row.

    Shingles are distinct runs of `words` words of the ASCII-lower-cased text (a shorter text is one shingle);
    rows link when 100 * |common| >= percent * |union|. component_id is the smallest id reachable by links.

    Null and empty texts have no shingles and link with nothing: component_id is their own id. Equal sets,
    repeated rows included, are one node. A null id is never a component_id unless all of a component are null.
    Other columns are not looked at. An empty table gives no rows. A text of any length is one set.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), column(id_col).alias("id"), column(text_col).alias("text"))
    found = _grouped(rows, words, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "group_size")


def _large(members: DataFrame) -> DataFrame:
    """(region, members) of regions that need dividing."""
    return cut(members.groupBy("region").agg(F.count("*").alias("members")).where(F.col("members") > REGION))


def _links(rows: DataFrame, names: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges (a, b) between (n1, n2) that hold all components of the linked nodes."""
    first = names.where("classes is not null")  # each set once a task
    often = rows.select("text").mapInArrow(partial(_counted, k=words), "shingle long, met long").groupBy("shingle").agg(F.sum("met").alias("met"))
    frequent = often.orderBy(F.desc("met"), "shingle").limit(FREQUENT).toPandas()  # bounded, and exactness doesn't rest on it
    held = rows.sparkSession.sparkContext.broadcast((frequent["shingle"].to_numpy(np.int64).view(np.uint64), frequent["met"].to_numpy(np.int64)))
    hot = max(MEETING, names.count() // HOT_SHARE)
    entered = rows.select("text").mapInArrow(partial(_regions, k=words, num=percent, held=held, hot=hot), "key long, salt long, node long")
    met = cut(entered.repartition("key", "salt").sortWithinPartitions("key", "salt", "node").mapInArrow(_meetings, "meeting long, node long, star boolean").distinct())
    several = small(cut(met.where("not star").select(F.col("node").alias("n1")).distinct()))
    counted = first.select("n1", "n2", "n", "classes").join(several, "n1", "left_semi").groupBy(F.col("n1").alias("node")).agg(F.first("n").alias("n"), F.when(F.min("n2") == F.max("n2"), F.first("classes")).alias("classes"))
    near = met.where("not star").join(counted, "node").repartition("meeting").sortWithinPartitions("meeting").select("meeting", "node", "n", "classes").mapInArrow(partial(_near, num=percent), "a long, b long")
    edges = near.unionByName(met.where("star").select(F.col("meeting").alias("a"), F.col("node").alias("b")))
    meeting = components(edges).select(F.col("node").alias("n1"), F.col("root").alias("region"))
    # the texts of each set that may be linked with another, by one of its ids
    placed = small(cut(meeting))
    chosen = cut(first.select("id", "n1", "n2").join(placed, "n1").groupBy("n1", "n2").agg(F.min("id").alias("id"), F.first("region").alias("region")))
    ids = small(cut(chosen.select("id").distinct()))
    texts = rows.join(ids, rows["id"].eqNullSafe(ids["id"]), "left_semi")
    sets = texts.select("text").mapInArrow(partial(_wanted, k=words), "n1 long, n2 long, items binary").join(placed, "n1").select("region", "n1", "n2", "items")
    large = _large(chosen)
    parts, stars = [], []
    for level in range(LEVELS + 1):
        if large.isEmpty():
            parts.append(sets)
            break
        sets = cut(sets if level else sets.dropDuplicates(["n1", "n2"]))
        parts.append(sets.join(small(large), "region", "left_anti"))
        left = spread_join(sets, large, ["region"], "members").where("members is not null")
        pick = F.pmod(F.xxhash64("n1", "n2", F.lit(level)), F.ceil(F.col("members") / PIVOTS)) == 0
        chosen = cut(left.where(pick).groupBy("region", "members").agg(F.slice(F.sort_array(F.collect_list("items")), 1, MOST_PIVOTS).alias("pivots")))  # some PIVOTS
        divided = spread_join(left.drop("members"), chosen, ["region"], "members").withColumn("members", F.coalesce("members", F.lit(0))).withColumn("pivots", F.coalesce("pivots", F.array().cast("array<binary>")))
        homes = cut(divided.select("region", "n1", "n2", "items", "members", "pivots").mapInArrow(partial(_homes, num=percent), "region long, n1 long, n2 long, items binary, members long, homes array<int>, bits long"))
        bit = lambda i: F.col("bits").bitwiseAND(F.lit(1 << i)) != 0
        shape = homes.groupBy("region").agg(
            F.count("*").alias("members"), ((F.sum(F.size("homes")) > COPIES * F.count("*")) | (F.max(F.array_max("homes")) == 0) | F.lit(level == LEVELS)).alias("stuck"),
            F.array(*(F.bit_or(F.when(bit(i), F.col("bits"))) for i in range(MOST_PIVOTS))).alias("near"), F.array(*(F.count_if(bit(i)) for i in range(MOST_PIVOTS))).alias("met"),
        )
        shape = cut(shape.mapInArrow(_tied, "region long, members long, stuck boolean, tied long"))
        placed = cut(spread_join(homes.drop("members"), shape, ["region"], "members"))
        sets = placed.where("not stuck").withColumn("pivot", F.explode("homes")).select(F.xxhash64("region", "pivot").alias("region"), "n1", "n2", "items")
        large = _large(sets)
        stuck = placed.where("stuck")
        # links with pivots are edges to a node that stands for the pivot
        linked = stuck.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(MOST_PIVOTS - 1)))).where(F.expr("bits & shiftleft(1L, at) != 0"))
        stars.append(linked.select(F.struct(F.xxhash64("region", F.lit(level)).alias("n1"), F.col("at").cast("long").alias("n2")).alias("a"), F.struct("n1", "n2").alias("b")))
        loose = F.col("bits").bitwiseAND(F.col("tied")) == 0
        count = cut(stuck.where(loose).groupBy("region").agg(F.count("*").alias("loose")))
        blocks = lambda n: F.ceil(F.col(n) * 2 / REGION).cast("int")
        both = stuck.drop("homes", "stuck").join(small(count), "region").withColumn("is_loose", loose)
        number = F.xxhash64("n1", "n2", F.lit(level))
        whole = both.select("region", "n1", "n2", "items", F.explode(F.sequence(F.lit(0), blocks("loose") - 1)).alias("i"), F.pmod(number, blocks("members")).cast("int").alias("j"))
        single = both.where("is_loose").select("region", "n1", "n2", "items", F.pmod(number, blocks("loose")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), blocks("members") - 1)).alias("j"))
        parts.append(whole.unionByName(single).select(F.xxhash64("region", "i", "j", F.lit(level)).alias("region"), "n1", "n2", "items"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    found = whole.repartition("region").sortWithinPartitions("region", "n1", "n2").mapInArrow(partial(_regions_joined, num=percent), "a1 long, a2 long, b1 long, b2 long")
    out = found.select(F.struct(F.col("a1").alias("n1"), F.col("a2").alias("n2")).alias("a"), F.struct(F.col("b1").alias("n1"), F.col("b2").alias("n2")).alias("b"))
    for star in stars:
        out = out.unionByName(star)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near copies: the first by id, a null id last.

    Of rows that repeat the least id of a group one stays, unless they are of other groups: rows are told apart
    by a number of their own, not by their id. Texts without words stay, all of them. Columns may have any names.
    """
    name = free_name(docs, "row")
    held = cut(docs.withColumn(name, F.monotonically_increasing_id()))
    found = _grouped(held.select(F.col(name).alias("row"), column(id_col).alias("id"), column(text_col).alias("text")), words, percent)
    gone = cut(found.where("row <> keep").select(F.col("row").alias(name)))
    return held.join(small(gone), name, "left_anti").select(*map(column, docs.columns))


@tidy
def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """jaccard_join() of all documents, three words and nine tenths; the cases are those of jaccard_join()."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END AS shingles FROM d),
n AS MATERIALIZED (SELECT doc_id, len(shingles) AS n_shingles FROM g),
s AS MATERIALIZED (SELECT doc_id, unnest(shingles) AS shingle FROM g),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n_shingles + y.n_shingles - common)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, n_shingles, least(doc_id, coalesce(min(b), doc_id)) AS component_id FROM n LEFT JOIN r ON a = doc_id GROUP BY doc_id, n_shingles
"""
