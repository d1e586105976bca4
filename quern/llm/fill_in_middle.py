"""Fill-in-middle over ropes: texts are cut at two unit ranks and put together again in another order.

A rope is a balanced tree whose leaves hold pieces of the text and whose nodes cache how many units and code points stand
below them. A unit is a word with the white space before it, or white space at the end of the text. Splitting at a rank
goes down one path by the cached counts and shares every subtree beside it; only the two leaves at the cuts are
looked into. The new order joins the three trees with leaves for the sentinels between them. The inverse finds the sentinels in the output,
splits its rope there by code points, and joins the parts in the order of the text.

Rows never meet: one narrow pass of Arrow batches each way, in which a task holds one text and its rope at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial, reduce
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import column, fields, free_name, parts, table, whole_row

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: Where a leaf may end: before white space that follows a word.
BREAK = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
#: Code points after which a leaf ends at the next break; a single longer word is one leaf.
LEAF = 2048
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80
#: Code points of output that a task gathers before it hands them on.
BATCH = 4 << 20


class Rope(NamedTuple):
    """A subtree; a leaf has text and no children. units counts the units that end below it."""

    units: int
    points: int
    text: str | None = None
    left: Rope | None = None
    right: Rope | None = None


EMPTY = Rope(0, 0, "")


def leaf(text: str) -> Rope:
    words = len(text.encode("utf-8", "surrogatepass").split())  # bytes are split at exactly the white space of a unit
    return Rope(words + (text[-1:] in " \t\n\v\f\r" and text != ""), len(text), text)


def join(left: Rope, right: Rope) -> Rope:
    if not left.points:
        return right
    if not right.points:
        return left
    return Rope(left.units + right.units, left.points + right.points, None, left, right)


def rope(text: str) -> Rope:
    """The balanced rope of a text, its leaves ending with units."""
    leaves, start = [], 0
    while start < len(text):
        found = BREAK.search(text, start + LEAF) if start + LEAF < len(text) else None
        stop = found.start() if found else len(text)
        leaves.append(leaf(text[start:stop]))
        start = stop
    while len(leaves) > 1:
        leaves = [join(leaves[i], leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else EMPTY


def split_units(tree: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` units, and the rest."""
    if rank <= 0:
        return EMPTY, tree
    if rank >= tree.units:
        return tree, EMPTY
    if tree.text is not None:
        at = next(islice(UNIT.finditer(tree.text), rank - 1, None)).end()
        return leaf(tree.text[:at]), leaf(tree.text[at:])
    if rank <= tree.left.units:
        a, b = split_units(tree.left, rank)
        return a, join(b, tree.right)
    a, b = split_units(tree.right, rank - tree.left.units)
    return join(tree.left, a), b


def split_points(tree: Rope, at: int) -> tuple[Rope, Rope]:
    """The first `at` code points, and the rest."""
    if at <= 0:
        return EMPTY, tree
    if at >= tree.points:
        return tree, EMPTY
    if tree.text is not None:
        return leaf(tree.text[:at]), leaf(tree.text[at:])
    if at <= tree.left.points:
        a, b = split_points(tree.left, at)
        return a, join(b, tree.right)
    a, b = split_points(tree.right, at - tree.left.points)
    return join(tree.left, a), b


def flat(tree: Rope) -> str:
    out, todo = [], [tree]
    while todo:
        at = todo.pop()
        if at.text is not None:
            out.append(at.text)
        else:
            todo += (at.right, at.left)
    return "".join(out)


class Rearranged(NamedTuple):
    n: int
    form: str
    prefix: int | None
    middle: int | None
    output: str


def draws(key: str, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearrange(text: str, key: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> Rearranged:
    """text as it is, or with its middle moved to the end, as the draws of key decide."""
    h1, h2, h3, h4 = draws(key, seed)
    tree = rope(text)
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return Rearranged(tree.units, "plain", None, None, text)
    first, last = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
    head, suffix = split_units(tree, last)
    prefix, middle = split_units(head, first)
    p, s, m = map(leaf, (PREFIX, SUFFIX, MIDDLE))
    form, parts = ("spm", (s, suffix, p, prefix, m, middle)) if h4 % 100 < spm_rate else ("psm", (p, prefix, s, suffix, m, middle))
    return Rearranged(tree.units, form, prefix.points, middle.points, flat(reduce(join, parts)))


def restored(output: str, form: str) -> str:
    """The text of an output. Texts with sentinels are plain, so the first of each is the one that was put in."""
    if form == "plain":
        return output
    p, s, m = output.index(PREFIX), output.index(SUFFIX), output.index(MIDDLE)
    cuts = sorted(((p, p + len(PREFIX), "p"), (s, s + len(SUFFIX), "s"), (m, m + len(MIDDLE), "m")))
    tree, parts, done = rope(output), {}, 0
    for (_, start, name), stop in zip(cuts, [*(c[0] for c in cuts[1:]), len(output)], strict=True):
        _, tree = split_points(tree, start - done)
        parts[name], tree = split_points(tree, stop - start)
        done = stop
    return flat(reduce(join, (parts["p"], parts["m"], parts["s"])))


MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def _forward(batches: Iterator[pa.RecordBatch], seed: int, rate: int, spm_rate: int, inside: int | None) -> Iterator[pa.RecordBatch]:
    """inside: the place of the text in the whole row, if it is there."""
    for batch in batches:
        whole, keys = batch.column("whole"), batch.column("key")
        texts = batch.column("text") if inside is None else whole.field(inside)

        def made(first: int, rows: list[Rearranged]) -> pa.RecordBatch:
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([whole.slice(first, len(rows)), *columns], ["whole", "n", "form", "prefix_chars", "middle_chars", "output"])  # noqa: B023

        rows, held, first = [], 0, 0
        for i in range(batch.num_rows):
            rows.append(rearrange(texts[i].as_py() or "", keys[i].as_py(), seed, rate, spm_rate))
            held += len(rows[-1].output)
            if held >= BATCH or i == batch.num_rows - 1:
                yield made(first, rows)
                rows, held, first = [], 0, i + 1


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held, first = [], 0, 0
        for i in range(batch.num_rows):
            rows.append(restored(batch.column("output")[i].as_py(), batch.column("form")[i].as_py()))
            held += len(rows[-1])
            if held >= BATCH or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([batch.column("whole").slice(first, len(rows)), pa.array(rows, pa.string())], ["whole", "restored"])
                rows, held, first = [], 0, i + 1


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all of them) with n, form, prefix_chars, middle_chars and output: the training text of each row.

    A row's id and the seed alone decide: `rate` of 100 texts are rearranged, `spm_rate` of 100 of these with the suffix first. Null texts
    count as empty; empty texts and texts that hold a sentinel stay as they are, form plain, lengths null. A null id draws as "null";
    repeated rows come out alike; no rows give no rows. Columns may have any names; where one of docs has the name of
    an output, the output gets "_" behind its own.
    """
    keep = docs.columns if keep is None else keep
    inside = keep.index(text_col) if text_col in keep else None
    rows = docs.select(whole_row(keep).alias("whole"), F.coalesce(column(id_col).cast("string"), F.lit("null")).alias("key"), *([column(text_col).alias("text")] if inside is None else []))
    made = rows.mapInArrow(partial(_forward, seed=seed, rate=rate, spm_rate=spm_rate, inside=inside), fields(rows, ["whole"], MADE))
    return made.select(*parts(keep), *(F.col(n).alias(free_name(docs, n)) for n in made.columns[1:]))


def restore(made: DataFrame, output_col: str = "output", form_col: str = "form", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all but the output) and `restored`, the exact text of each output of fill_in_middle(). A null output counts as empty."""
    keep = [c for c in made.columns if c != output_col] if keep is None else keep
    rows = made.select(whole_row(keep).alias("whole"), F.coalesce(column(output_col), F.lit("")).alias("output"), F.coalesce(column(form_col), F.lit("plain")).alias("form"))
    return rows.mapInArrow(_backward, fields(rows, ["whole"], "restored string")).select(*parts(keep), F.col("restored").alias(free_name(made, "restored")))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """fill_in_middle() of all documents and back again, as digests; the cases are those of fill_in_middle()."""
    made = fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"]).withColumn("output_sha256", F.sha2("output", 256))
    return restore(made).withColumn("restored_sha256", F.sha2("restored", 256)).drop("restored")


SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
           sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h
    FROM documents),
e AS (SELECT *, len(u) AS n, [('0x' || h[i:i + 7])::BIGINT FOR i IN [1, 9, 17, 25]] AS k FROM d),
f AS (
    SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
           CASE WHEN text = '' OR k[3] % 100 >= 50 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN k[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM g
"""
