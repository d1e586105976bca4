"""Text, path, intent and highlight functions by example."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import highlight, intent, paths, text, vectors
from quern.operators import chunking
from quern.sources import files


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_terms_and_names(spark):
    assert one(spark, "Where is the Acme payment, 50% OFF? a 7 payment", text.query_terms) == ["acme", "payment", "50", "off", "7"]
    assert one(spark, "Acme_ProposalV3-final (2).docx", text.tokenize_name) == "Acme Proposal V 3 final 2"
    assert one(spark, "my_docs/TaxForms2023\\x.pdf", text.tokenize_path) == "my docs Tax Forms 2023" and one(spark, "x.pdf", text.tokenize_path) == ""
    assert one(spark, "a/b/c.txt", lambda c: text.path_prefixes(F.lit("/r/"), c)) == ["/r", "/r/a", "/r/a/b"]
    assert one(spark, "Payments were made", lambda c: text.matched_terms(c, F.array(F.lit("pay"), F.lit("made"), F.lit("ade")))) == ["pay", "made"]


def test_display(spark):
    assert [one(spark, n, text.format_bytes, "long") for n in (5, 2048, 3 << 19, 5 << 30)] == ["5 B", "2 KB", "1.5 MB", "5.00 GB"]
    assert one(spark, "x" * 60, text.quoted) == "“" + "x" * 39 + "…”" and one(spark, 1, lambda c: text.plural(c, "file"), "long") == "1 file"
    assert one(spark, "C/Users/maya/Documents/Housing/Old", text.middle_ellipsis) == "C/Users/…/Housing/Old"
    assert one(spark, "C/Users/" + "m" * 40 + "/Housing/Old", text.middle_ellipsis) == "C/Users/…/Housing/Old"
    assert one(spark, "a/b/c/d/e.txt", text.short_folder) == "…/c/d" and one(spark, "a/b", text.short_dir) == "a/b"
    assert one(spark, "it is so [1]. Inferred: maybe [2, 3]. ok", text.spoken_answer) == "It is so. Maybe. Ok"
    assert one(spark, "lease.PDF", lambda c: text.spoken_copied(c, F.lit(False), F.lit(1))) == "Copied the second match, lease."
    assert one(spark, "&lt;a&gt; &amp;lt; &#233;&#128512;&nbsp;x", text.decode_entities) == "<a> &lt; é😀 x"
    labels = spark.createDataFrame([(3, 5, "x"), (3, 3, None), (0, None, "A › B"), (None, None, "")], "a int, b int, s string")
    assert [r[0] for r in labels.select(text.location_label(F.col("a"), F.col("b"), F.col("s"))).collect()] == ["pp. 3–5", "p. 3", "§ B", None]
    assert one(spark, "See [2], [9] and [9] but [0].", lambda c: text.invalid_citations(c, F.lit(3))) == [9, 0]
    parts = one(spark, "It is. Inferred: it may be.\nYes.", text.inferred_sentences)
    assert [tuple(p) for p in parts] == [("It is.", False), ("it may be.", True), ("Yes.", False)]


def test_paths(spark):
    check = lambda v, f: one(spark, v, f)
    assert [check(e, paths.kind_of) for e in ("md", "py", "pdf", "exe")] == ["markdown", "code", "pdf", None]
    assert [check(p, paths.is_excluded_path) for p in ("a/node_modules/x.js", "a/.git/x", "a/~$x.docx", "a/b.txt", "Dist/x.js")] == [True, True, True, False, True]
    assert [check(p, lambda c: paths.is_inside(c, F.lit("C:\\Users\\me"))) for p in ("c:/users/ME/x", "C:\\Users\\me", "C:\\Users\\mean\\x", "C:\\Users\\me\\..\\x")] == [True, False, False, False]
    assert [check(p, paths.is_safe_local) for p in ("C:\\a.txt", "\\\\srv\\a", "C:\\a.txt:b", "/etc", "c:/x")] == [True, False, False, False, True]
    assert [check(p, paths.blocked_reason) for p in ("C:\\", "C:\\Windows\\x", "C:\\Users\\me", "C:\\WindowsX")] == ["drive", "system", None, None]
    assert [check(h, paths.is_loopback) for h in ("localhost", "[::1]", "127.8.9.1", "127.evil.com", "example.com")] == [True, True, True, False, False]
    assert [check(n, paths.is_cloud_model) for n in ("gpt:cloud", "cloud", "x-cloud", "cloudy", "m:7b")] == [True, True, True, False, False]


@pytest.mark.parametrize(
    ("said", "kind", "query", "folder"),
    [
        ("Hey computer, find my lease", "file", "lease", False), ("open the folder with the design mockups, please", "file", "design mockups", True), ("What did we pay Acme?", "question", "what did we pay acme", None),
        ("No thanks.", "refuse", None, None), ("computer", "empty", None, None), ("yes please", "agree", None, None), ("Yes, could you show me the invoice", "file", "invoice", False),
        ("is there a document about taxes", "file", "is there a document about taxes", False), ("the Acme contract", "file", "acme contract", False), ("where’s the report", "file", "report", False),
    ],
)
def test_intents(spark, said, kind, query, folder):
    got = one(spark, said, intent.classify)
    assert (got["kind"], got["query"], got["folder"]) == (kind, query, folder)


def test_picks(spark):
    picks = {"the second one": "2", "number 3": "3", "Yes, the last match please": "last", "open 1st": "1", "sixth": None, "find it now": None}
    assert {k: one(spark, k, intent.ordinal) for k in picks} == picks
    assert one(spark, "Show it in the folder!", intent.is_reveal) and not one(spark, "show it", intent.is_reveal)
    heard = ["computer", "commuter", "compute her"]
    assert one(spark, "Hey commuter, find it", lambda c: intent.strip_heard_wake(c, heard)) == "Find it" and one(spark, "the commute is long", lambda c: intent.strip_heard_wake(c, heard)) == "the commute is long"
    assert one(spark, "Hey, Computer!", lambda c: intent.is_wake_alone(c, heard)) and not one(spark, "computer science", lambda c: intent.is_wake_alone(c, heard))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab pay,é\n😀", max_size=900), st.lists(st.sampled_from(["pay", "a", "é", "b"]), max_size=3, unique=True))
def test_snippet_marks_whole_words(body, terms):
    said, ranges = highlight.snippet(body, terms)
    assert len(said) <= highlight.SNIPPET + 2
    for a, b in ranges:
        assert any(said[a:b].lower().startswith(t) for t in terms)
    assert all(x[1] < y[0] for x, y in zip(ranges, ranges[1:], strict=False))
    assert bool(ranges) == bool(highlight.places(re.sub(r"\s+", " ", said.strip("…")), terms))


def test_snippet_takes_the_densest_window(spark):
    body = "lorem ipsum " * 60 + "payment payments paid payment " + "dolor " * 100 + "payment"
    said, ranges = highlight.snippet(body, ["payment"])
    assert said.startswith("…") and said.endswith("…") and len(ranges) == 3
    df = spark.createDataFrame([(body, ["payment"]), (None, None)], "t string, w array<string>")
    rows = df.select(highlight.snippets(F.col("t"), F.col("w")).alias("s"), highlight.ranges(F.col("t"), F.col("w")).alias("r")).collect()
    assert rows[0]["s"]["snippet"] == said and len(rows[0]["r"]) == 4 and rows[1]["s"]["snippet"] == ""
    assert df.limit(1).select(text.highlighted(F.lit("a pay b"), F.array(F.struct(F.lit(2).cast("long").alias("start"), F.lit(5).cast("long").alias("stop"))))).first()[0] == "a [pay] b"


def test_normalise_both_ways(spark):
    raw = "﻿a\r\nb\rc\x00\x07d\n\n\n\n\ne\tf"
    assert one(spark, raw, text.normalise) == files.normalise(raw) == "a\nb\ncd\n\n\ne\tf"
    page = "An exam-\nple of a\nline.\nNext  one"
    assert one(spark, page, text.reflow) == files.reflow(page) == "An example of a line.\nNext one"


def test_labels_modes_and_actions(spark):
    df = spark.createDataFrame([("pdf",), ("ts",), ("svelte",), ("markdown",)], "e string")
    assert [r[0] for r in df.select(text.badge(F.col("e"))).collect()] == ["PDF", "TS", "CODE", "MD"]
    now = F.lit("1970-01-02 10:00:00").cast("timestamp")
    assert [r[0] for r in spark.createDataFrame([(86_400_000 + 3_660_000,), (5,)], "ms long").select(text.when_label(F.col("ms"), now)).collect()] == ["01:01", "1970-01-01"]
    assert [r[0] for r in spark.createDataFrame([([1.0],), (None,)], "v array<double>").select(text.response_mode(F.col("v"))).collect()] == ["hybrid", "keyword"]
    raw = ['{"type":"dismiss"}', '{"type":"select","index":3}', '{"type":"select","index":11}', '{"type":"select","index":1.5}', '{"type":"hover","on":true}', '{"type":"hover"}', '{"type":"resize","height":900.2}', '{"type":"resize","height":-1}', '{"type":"open_source","file_id":7}', "broken", '{"type":"other"}', None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string").orderBy("i").select(text.valid_action(F.col("raw"))).collect()]
    assert [g and g["type"] for g in got] == ["dismiss", "select", None, None, "hover", None, "resize", None, "open_source", None, None, None]
    assert got[1]["index"] == 3 and got[6]["height"] == 480 and got[8]["file_id"] == 7 and got[4]["on"] is True


def test_matches_lead_round(spark):
    views = spark.createDataFrame([(1, "tax a taxes, Tax", ["tax"]), (2, "none", ["tax"]), (3, "one tax", ["tax", "on"]), (4, None, ["tax"]), (5, "tax", None)], "content_id int, text string, terms array<string>")
    got = sorted(tuple(r) for r in highlight.matches(views, "content_id").collect())
    assert got == [(1, 1, 3, 0, 3, 3, 2), (1, 2, 3, 6, 11, 1, 3), (1, 3, 3, 13, 16, 2, 1), (3, 1, 2, 0, 3, 2, 2), (3, 2, 2, 4, 7, 1, 1)]


def test_lengths_are_computed_once_a_vector(spark):
    """Once for each component, this took 1.8e9 steps."""
    rows = spark.range(200).select("id", F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda x: (x * (F.col("id") % 2)).cast("float")).alias("v"))
    made, began = rows.select("id", vectors.normalised(F.col("v")).alias("u")), time.perf_counter()
    got = {r["id"]: np.array(r["u"]) for r in made.collect()}
    assert time.perf_counter() - began < 25
    assert not got[0].any() and np.allclose(got[1], np.arange(1, 3001) / np.sqrt((np.arange(1, 3001.0) ** 2).sum()))
    assert spark.sql("select cast(null as array<float>) v").select(vectors.normalised(F.col("v"))).first()[0] is None


def test_words_of_batches_are_those_of_columns(spark):
    rng = random.Random(3)
    texts = ["", "", "ab", "cd", "", "é", "x", *("".join(rng.choice("aB9 _é\u0130ß٣²Ⅷ一😀-\u0301\U0002ebf8") for _ in range(rng.randrange(60))) for _ in range(2000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.lower("t").alias("low"), text.words(F.col("t")).alias("words"))
    rows = df.orderBy("i").collect()
    points = np.unpackbits(np.frombuffer(text.word_points(spark), np.uint8), count=text.POINTS).astype(bool)
    column = pa.array([r["low"] for r in rows])
    for part, wanted in ((column, rows), (column[3:900], rows[3:900]), (column[:0], []), (column[:2], rows[:2])):
        many, flat = text.split_words(part, points)
        assert many.tolist() == [len(r["words"]) for r in wanted] and flat.to_pylist() == [w for r in wanted for w in r["words"]]


def test_sentence_ends_of_ranges_are_those_of_the_text():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(["a", "bc ", ". ", '?"  ', ".' ", "\n", " \n \n", ".", ") ", "\r\n", "x" * 9]) for _ in range(rng.randrange(80)))
        found = [(m.start(), m.start(1), m.end()) for m in re.finditer(r"[.!?][\"')\]]?(\s+)", t)]
        low, high = sorted(rng.randrange(len(t) + 1) for _ in range(2))
        inside = [min(end, high) for mark, blank, end in found if mark >= low and blank < high]
        breaks = chunking.Breaks(t)
        assert (breaks.first(low, high), breaks.last(low, high)) == ((inside[0], inside[-1]) if inside else (None, None))
        assert [(b.start, b.stop) for b in chunking.paragraph_blocks(t)] == [(m.start(), m.start() + len(m[0].rstrip())) for m in re.finditer(r"\S[\s\S]*?(?=\n\s*\n|\Z)", t)]
