"""Hard negatives, URL verdicts and fill-in-middle against walks in plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import fill_in_middle as fim
from quern.llm import hard_negatives as hn
from quern.llm import url_filter as urls


def brute_negatives(rows):
    """rows: (vec_id, vector, label) in any order; anchors are ids divisible by 5."""
    ok = [(i, [math.floor(256 * float(x)) for x in v], la) for i, v, la in rows if la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda t: (-t[0], t[1] is None, t[1] or 0, t[2])
    out = Counter()
    for n, (aid, a, la) in enumerate(ok):
        if aid is None or aid % 5:
            continue
        all_ = sorted(((score(a, v), i, m, lb) for m, (i, v, lb) in enumerate(ok) if m != n), key=order)
        for p, pid, _, _ in [t for t in all_ if t[3] == la][:5]:
            inside = [t for t in all_ if t[3] != la and 30 * p <= 100 * t[0] <= 90 * p][:10]
            for rank, (s, i, _, _) in enumerate(inside, 1):
                out[(aid, pid, rank, i, p, s)] += 1
    return out


def vectors(n, seed=3):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = []
    for i in range(n):
        c = centres[i % 9]
        rows.append((i, [x + draw.gauss(0, 0.4) for x in c], i % 4))
    same = [0.5, -0.25, 1.0, 0.125, 0.0, -1.0]
    rows += [(n + i, same, i % 3) for i in range(n // 3)]  # one vector for a quarter of the rows
    rows += [(5, same[:3], 1), (10, [], 2), (None, same, 1), (15, None, 1), (20, [None, 1.0], 1), (25, [float("nan")], 0), (30, [float("inf")], 0), (35, same, None), (7, [-x for x in same], 2)]
    return rows


@pytest.mark.parametrize("block", [1 << 10, 64])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hn, "LEAST_BLOCK", block)
    monkeypatch.setattr(hn, "LEAF", 8)
    monkeypatch.setattr(hn, "PACK", 40)
    monkeypatch.setattr(hn, "WALK", 3)
    rows = vectors(700)
    df = spark.createDataFrame([(i, v, la, "x") for i, v, la in rows], "vec_id long, embedding array<double>, label int, `row` string").repartition(5)
    got = Counter(map(tuple, hn.hard_negatives(df, F.col("vec_id") % 5 == 0).collect()))
    assert got == brute_negatives(rows)


def test_hard_negatives_skip_leaves_and_blocks():
    """On vectors that lie in clusters the triangle inequality spares most leaves."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = (np.repeat(rng.normal(size=(16, 8)) * 300, 64, axis=0) + rng.normal(size=(1024, 8)) * 3).astype(np.int64)
    space = hn.Space(8, "<i8", float((x**2).sum(1).max()))
    order, vantage, ranges = hn._halves(space, x)
    x = x[order]
    queries = np.zeros(1, hn.QUERY)
    queries["lo"], queries["hi"], queries["bound"] = hn.NONE, -hn.NONE - 1, hn.NONE
    far = x[np.argmax((x**2).sum(1))]
    walk = hn.Walk({"anchors": np.array([-1], "i8").tobytes(), "windows": np.array([0], "i8").tobytes(), "queries": queries.tobytes(), "vectors": far.tobytes()}, space, 5, True)
    seen = []
    take = walk.take
    walk.take = lambda *a: (seen.append(len(a[0])), take(*a))
    block = {"rows": np.arange(1024), "ids": np.arange(1024), "void": np.zeros(1024, bool), "labels": np.zeros(1024, np.int64), "vectors": x, "vantage": vantage, "ranges": ranges}
    walk.search({k: v.tobytes() for k, v in block.items()})
    assert sorted(walk.best["score"][0].tolist()) == sorted((x @ far).tolist())[-5:]
    assert sum(seen) < 512, seen


def test_hard_negatives_of_large_numbers_and_no_rows(spark):
    rows = [(0, [1e6, 3.5e5], 1), (100, [9.9e5, 1.0], 1), (3, [3.0e5, 2.0], 2), (4, [5.0e5, 7.0], 2), (9, [1e300, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter(map(tuple, hn.hard_negatives(df, F.col("vec_id") % 5 == 0).collect()))
    assert got == brute_negatives(rows[:-1]) and got  # the last has no score that a long holds
    assert hn.hard_negatives(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert hn.hard_negatives(df, F.col("vec_id") < 0).count() == 0


def plain_verdict(url, rules, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    seen = host != "" and (host, path) in listed
    return host, path, best and best[3], seen, best[2] if best else "block" if seen else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.NET/en/x?q=1", "https://example.net/en", "http://example.net/de/1#t", "ftp://net/", "http://NET", "http://xnet/", "http://a.b.c.example.com/de/", "http://example.com/DE/",
    "http://w.org/fr/?x", "http://org/fr", "http://É.org/fr/é", "a://b://c.net/d", "http://.net/x", "http://net./x", "http://same.test/p?a", "http://same.test/p#b", "http://user@x.net:80/en/", "http://a.net?x/", "http://h.test/" + "a/" * 3000,
]


def test_url_verdicts_equal_plain_rules(spark):
    rules = [*urls.RULES, ("test", "/a", "allow"), ("h.test", "/a/a/", "block"), ("h.test", "", "allow"), ("", "/", "block"), ("same.test", "/q", "block")]
    rows = [(None if i == 3 else i, u, "h") for i, u in enumerate(URLS * 2)] + [(0, URLS[4], "h")]
    pages = spark.createDataFrame(rows, "`page.id` long, `the url` string, host string")
    named = Counter(plain_verdict(u, [], set())[:2] for _, u, _ in rows)
    again = {k for k, n in named.items() if n > 1 and k[0]}
    assert {tuple(r) for r in urls.repeated_urls(pages, "the url").collect()} == again
    held = again - {("w.org", "/fr/")} | {("nobody.test", "/")}
    listed = spark.createDataFrame(list(held), "host string, path string")
    rule_rows = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = Counter((i, *plain_verdict(u, [r for r in rules if r[0]], held)) for i, u, _ in rows)
    got = urls.url_verdicts(pages, rule_rows, listed, "page.id", "the url")
    assert Counter(map(tuple, got.collect())) == want
    assert urls.url_verdicts(pages.limit(0), rule_rows, listed, "page.id", "the url").count() == 0
    none = urls.url_verdicts(pages, rule_rows.limit(0), listed.limit(0), "page.id", "the url")
    assert {tuple(r) for r in none.select("rule", "verdict").distinct().collect()} == {(None, "allow")}


def test_url_filter_with_a_long_list_and_hot_keys(spark, monkeypatch):
    """A list that is joined by a shuffle gives the same; the filter loses no key and passes few false ones."""
    rows = [(i, f"http://h{i % 50}.net/en/{i % 7}" if i % 3 else f"http://other{i}.test/{i}") for i in range(3000)]
    pages, rules = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([(f"other{i}.test", f"/{i}") for i in range(0, 30000, 6)], "host string, path string")
    first = Counter(map(tuple, urls.url_verdicts(pages, rules, listed).collect()))
    monkeypatch.setattr(urls, "SHORT", 3)
    assert Counter(map(tuple, urls.url_verdicts(pages, rules, listed).collect())) == first
    entries = urls.listed_urls(rules, listed)
    blocks = urls.blocks_for(entries.count())
    bloom = urls.bloom_filter(entries, blocks)
    assert bloom.count() * urls.BLOCKS <= max(blocks, urls.BLOCKS)
    assert urls.possible(entries.select("key"), bloom, blocks).count() == entries.count()
    other = spark.range(20000).select(F.concat(F.lit("url x"), "id").alias("key"))
    assert urls.possible(other, bloom, blocks).count() < 400
    assert urls.blocks_for(10**12) == urls.BLOCKS * urls.MOST_SEGMENTS


TEXTS = [
    None, "", " ", "one", " one two ", "a\u00a0b c", "tab\tand\nline\x0b\x0c\r end \n", "ünïcödé 😀 words 😀😀 here", "has <P> in it", "has <M>", "ends <S", "<", "<S <M > P>", "w " * 5000, "x" * 9000, ("y" * 3000 + " ") * 5, "\x1cfile\x1dgroup\x85next",
]


def plain_fim(i, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or h[2] % 100 >= 50 or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_plain_cutting_and_comes_back(spark):
    rows = [(None if k % 29 == 3 else k, t, k, "q") for k, t in enumerate(TEXTS * 12)] + [(4, TEXTS[7], 0, "q")] * 2
    df = spark.createDataFrame(rows, "`doc.id` long, `my text` string, n int, `a``b` string").repartition(3)
    made = fim.fill_in_middle(df, "doc.id", "my text")
    assert made.columns == [*df.columns, "n_", "form", "prefix_chars", "middle_chars", "output"]
    want = Counter((i, t, k, q, *plain_fim(i, t)) for i, t, k, q in rows)
    assert Counter(map(tuple, made.collect())) == want
    assert {w[5] for w in want} == {"plain", "spm", "psm"}
    back = fim.restore(made)
    assert back.columns == [*(c for c in made.columns if c != "output"), "restored"]
    assert all((r["my text"] or "") == r["restored"] for r in back.collect())
    assert fim.fill_in_middle(df.limit(0), "doc.id", "my text").count() == 0 and fim.restore(made.limit(0)).count() == 0


def test_ropes_split_at_every_rank():
    text = "  a bb\tccc\n" + "word " * 40 + "😀 z  "
    fim_leaf, fim.LEAF = fim.LEAF, 7
    try:
        tree = fim.rope(text)
        units = fim.UNIT.findall(text)
        assert tree.units == len(units) and tree.points == len(text) and tree.text is None
        for rank in range(len(units) + 1):
            a, b = fim.split_units(tree, rank)
            assert (fim.flat(a), fim.flat(b)) == ("".join(units[:rank]), "".join(units[rank:])) and a.units == rank
        for at in range(len(text) + 1):
            a, b = fim.split_points(tree, at)
            assert (fim.flat(a), fim.flat(b)) == (text[:at], text[at:])
    finally:
        fim.LEAF = fim_leaf
