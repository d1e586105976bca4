"""Places of terms in texts and snippets around them: Arrow batches, as columns can't give offsets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import ELLIPSIS

SNIPPET = 320
WORD = r"[^\W_]"
RANGES = "array<struct<start:long,stop:long>>"


def places(text: str, terms: list[str]) -> list[tuple[int, int]]:
    """All words that begin with a term, sorted by start."""
    found = [m.span() for t in terms for m in re.finditer(rf"(?<!{WORD}){re.escape(t)}{WORD}*", text, re.I)]
    return sorted(found, key=lambda p: p[0])


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


#: A snippet begins so many characters before its first place, and up to so many later to begin with a word.
LEAD_IN, WORD_SLACK = 60, 30


def densest(found: list[tuple[int, int]], most: int) -> int:
    """Start of the place from which the most places in a row end within `most` characters; the first such. Two pointers, one walk."""
    best, at, stop = 0, found[0][0], 0
    for i, (begin, _) in enumerate(found):
        stop = max(stop, i)
        while stop < len(found) and found[stop][1] <= begin + most:
            stop += 1
        if stop - i > best:
            best, at = stop - i, begin
    return at


def _bounds(text: str, found: list[tuple[int, int]], most: int) -> tuple[int, int]:
    """The part of a text to show: whole words where one ends or begins near enough."""
    if len(text) <= most:
        return 0, len(text)
    low = max(0, densest(found, most) - LEAD_IN) if found else 0
    high = min(len(text), low + most)
    blanks = [i for i in range(low, high + 1) if text[i : i + 1] == " "]
    if low and blanks and blanks[0] < low + WORD_SLACK:
        low = blanks[0] + 1
    late = [i for i in blanks if i > low + most / 2]
    return low, late[-1] if late and high < len(text) else high


def snippet(text: str, terms: list[str], most: int = SNIPPET) -> tuple[str, list[tuple[int, int]]]:
    """The window with most places, white space collapsed, ellipses where it is cut; and the ranges in it."""
    low, high = _bounds(text, places(text, terms), most)
    body = re.sub(r"\s+", " ", text[low:high])
    marks = (ELLIPSIS * (low > 0), ELLIPSIS * (high < len(text)))
    shown = merged(places(body, terms))
    return body.join(marks), [(a + len(marks[0]), b + len(marks[0])) for a, b in shown]


def _frame(text: pd.Series, terms: pd.Series, make) -> pd.Series:
    return pd.Series([make(t or "", list(w) if w is not None else []) for t, w in zip(text, terms, strict=True)], dtype=object)


def ranges(text: Column, terms: Column) -> Column:
    def run(t: pd.Series, w: pd.Series) -> pd.Series:
        return _frame(t, w, lambda x, ws: [{"start": a, "stop": b} for a, b in merged(places(x, ws))])

    return F.pandas_udf(run, RANGES)(text, terms)


def snippets(text: Column, terms: Column) -> Column:
    """struct(snippet, highlights)."""

    def run(t: pd.Series, w: pd.Series) -> pd.DataFrame:
        made = [snippet(x or "", list(ws) if ws is not None else []) for x, ws in zip(t, w, strict=True)]
        return pd.DataFrame({"snippet": [m[0] for m in made], "highlights": [[{"start": a, "stop": b} for a, b in m[1]] for m in made]})

    return F.pandas_udf(run, f"snippet string, highlights {RANGES}")(text, terms)


def matches(views: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, of, start, stop, before, after): the places of terms in views (keys, text, terms), numbered from 1, with the numbers before and after them; the last leads on to the first."""
    found = views.select(*keys, ranges(F.col("text"), F.col("terms")).alias("ranges")).withColumn("of", F.size("ranges"))
    rows = found.select(*keys, "of", F.posexplode("ranges").alias("i", "r"))
    return rows.select(*keys, (F.col("i") + 1).alias("n"), "of", "r.start", "r.stop", ((F.col("i") - 1 + F.col("of")) % F.col("of") + 1).alias("before"), ((F.col("i") + 1) % F.col("of") + 1).alias("after"))
