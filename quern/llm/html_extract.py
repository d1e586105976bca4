"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A classifier, trained here, prices each label of each block; the prices are the
terminal capacities of a graph whose other edges, between neighbouring blocks and between blocks that are close in the tree,
make unlike labels cost. The minimum cut is the cheapest labelling: its source side is the main text.

The classifier's features are those of the text, of the block's element, and the names above it (elements, classes, roles); what a
name is worth is learnt, from a weak prior. Training labels come from pages with an article or main element: what is in it, other than in
named parts such as comments, is main text, all else isn't. Every training block is used twice, once with all names hidden, so
that text and place are learnt as well and no weight of a name settles a block by itself.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import column, fields, free_name, parts, table

#: Pages that the classifier is trained on, of those of at most TRAIN_CHARS characters the ones with the least hashes.
TRAIN_PAGES, TRAIN_CHARS = 600, 1 << 16
#: Names that get a weight of their own, the commonest, each in so many training pages at least.
MOST_NAMES, NAME_PAGES = 250, 3
#: Names above a block that count, the nearest.
NAMES_ABOVE = 32
#: How much less each further name counts, of those that say anything.
FADE = 0.5
#: Capacities: a unit of log odds; unlike labels of neighbours with one parent (less the further apart in the tree), of siblings, of
#: cousins. All but the first are scaled by the one of SCALES that errs least on training pages kept back.
UNIT, NEIGHBOUR, SIBLING, COUSIN, MOST_ODDS = 1000, 1200, 600, 200, 4.0
SCALES = (2.0, 1.0, 0.5, 0.25)

SPACE = re.compile(r"[\x20\x09-\x0D]+")
NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
# Element names of HTML.
RAW = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in "script style noscript template textarea select iframe svg object title".split()}
HEAD = frozenset("head title meta link style script noscript base template".split())
PARENTS = frozenset("html body div section article main nav header footer aside form table tbody thead tfoot tr td th ul ol dl figure fieldset details blockquote dialog menu center".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption caption summary address legend option label hr".split())
TAGS = ("p", "h1", "h2", "li", "td", "div")
PAGE, MAIN = ("html", "body"), ("article", "main")
#: What names are worth before any training: elements, and classes by the whole word or its last part.
ELEMENTS = {"article": 2.0, "main": 2.0, "nav": -6.0, "header": -1.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "dialog": -6.0, "menu": -6.0, "fieldset": -2.0}
GOOD, BAD = 1.0, -6.0
GOOD_WORDS = frozenset("article post entry story content articlebody".split())
BAD_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice popup modal "
    "newsletter subscribe signup login share sharing social related recommended comment comments replies disqus widget toolbar pagination pager search contentinfo complementary".split()
)


class Block(NamedTuple):
    text: str
    parents: tuple[int, ...]  # numbers of its parent and that one's parent
    depth: int
    tag: str
    names: tuple[str, ...]  # of the elements above it, the nearest last
    links: int  # characters inside links


class Element(NamedTuple):
    name: str
    number: int
    names: tuple[str, ...]


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, stop, name, ends, attributes) of tags, comments (no name) and elements whose content is no text, in time linear in the page.

    A tag ends at the first ">" outside of quotes, or, once no such is left, at the next ">" of any kind.
    """
    at, quotes = 0, True
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else len(page)
            yield start, at, "", False, ""
        elif page.startswith(("<!", "<?"), start):
            stop = page.find(">", start)
            at = stop + 1 if stop >= 0 else len(page)
            yield start, at, "", False, ""
        elif m := TAG.match(page, start):
            first = page.find(">", m.end())
            if first < 0:
                return  # no tag ends any more
            stop = first
            if quotes:
                stop, i = -1, m.end()
                while stop < 0 and i < len(page):
                    i = min((x for x in (page.find(c, i, first + 1) for c in "\"'") if x >= 0), default=-1)
                    if i < 0:
                        stop = first
                        break
                    i = page.find(page[i], i + 1) + 1
                    first = page.find(">", i) if i else -1
                    if not i or first < 0:
                        break
                if stop < 0:
                    quotes, stop = False, page.find(">", m.end())
            name, at = m[1].lower(), stop + 1
            ends = page[start + 1] == "/"
            if name in RAW and not ends:
                close = RAW[name].search(page, at)
                at = close.end() if close else len(page)
                yield start, at, "", False, ""
            else:
                yield start, at, name, ends, page[m.end() : stop]


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack = [Element("", 0, ())]
    opened: Counter[str] = Counter()
    number, tag, in_head, anchor, linked = 0, "", False, False, 0
    parts: list[str] = []

    def close() -> None:
        nonlocal linked
        raw = "".join(parts)
        parts.clear()
        text = SPACE.sub(" ", entities.unescape(raw) if "&" in raw else raw).strip(" ")
        if text:
            top = stack[-1]
            out.append(Block(text, (top.number, stack[-2].number if len(stack) > 1 else 0), len(stack), tag or top.name, top.names, min(linked, len(text))))
        linked = 0

    at = 0
    for start, stop, name, ends, attributes in tokens(page):
        if start > at and not in_head:
            parts.append(page[at:start])
            linked += (start - at) * anchor
        at = stop
        if not name:
            continue
        if name == "head":
            in_head = not ends
        elif in_head and name not in HEAD:
            in_head = False
        if name == "br":
            parts.append(" ")
        elif name == "a":
            anchor = not ends
        elif name in LEAVES:
            close()
            tag = "" if ends else name
        elif name in PARENTS:
            close()
            tag = ""
            if not ends:
                names = stack[-1].names
                if name not in PAGE:
                    said = " ".join(x for m in NAMED.finditer(attributes) for x in m.groups() if x).lower().split() if attributes else []
                    fresh = [n for n in dict.fromkeys([name, *("." + w for w in said)]) if n not in names]
                    names = (*names, *fresh)[-NAMES_ABOVE:] if fresh else names
                number += 1
                stack.append(Element(name, number, names))
                opened[name] += 1
            elif opened[name]:
                while (gone := stack.pop()).name != name:
                    opened[gone.name] -= 1
                opened[name] -= 1
    if not in_head:
        parts.append(page[at:])
    close()
    return out


def features(found: list[Block]) -> np.ndarray:
    """(blocks, kinds): length, links, sentence ends, neighbours' text, place, shortness, elements."""
    n = len(found)
    size = np.array([len(b.text) for b in found], float)
    link = np.array([b.links for b in found], float) / np.maximum(size, 1)
    ends = np.array([b.text[-1] in ".!?:;\"')" for b in found], float)
    words = np.log1p(np.array([b.text.count(" ") + 1 for b in found], float))
    weight = np.where(link < 0.5, size, 0)
    around = np.log1p(np.append(0, weight[:-1]) + np.append(weight[1:], 0))
    place = (np.arange(n) + 0.5) / max(n, 1)
    short = (words < 1.7).astype(float)
    tags = np.array([[b.tag == t for t in TAGS] for b in found], float).reshape(n, len(TAGS))
    return np.column_stack([np.ones(n), words, link, ends, around, np.abs(place - 0.5), short, tags])


class Weights(NamedTuple):
    """Log odds of main text: of features() and of names (those without a weight have that of the prior); scale of smoothness."""

    text: np.ndarray
    names: dict[str, float]
    scale: float = 0.5


#: Without any training pages long blocks with few links are text.
PRIOR = Weights(np.array([-1.5, 0.6, -3.0, 0.5, 0.1, -0.5, -0.3, 0.5, 0.5, 0.3, -0.5, 0.0, 0.0]), {})


def worth(name: str) -> float:
    """The prior weight of a name; classes begin with a dot."""
    if not name.startswith("."):
        return ELEMENTS.get(name, 0.0)
    word = name[1:]
    last = re.split("[-_]", word)[-1]
    return BAD if word in BAD_WORDS or last in BAD_WORDS else GOOD if word in GOOD_WORDS or last in GOOD_WORDS else 0.0


def shares(names: tuple[str, ...], weighs: dict[str, float]) -> dict[str, float]:
    """How much each name above a block counts: the nearest that weighs anything most."""
    out, share = {}, 1.0
    for n in reversed(names):
        if (weighs[n] if n in weighs else worth(n)) != 0:
            out[n] = share
            share *= FADE
    return out


def log_odds(found: list[Block], weights: Weights) -> np.ndarray:
    known: dict[tuple[str, ...], float] = {}
    for b in found:
        if b.names not in known:
            known[b.names] = sum(share * weights.names.get(n, worth(n)) for n, share in shares(b.names, weights.names).items())
    return features(found) @ weights.text + np.array([known[b.names] for b in found])


def labels(found: list[Block]) -> np.ndarray | None:
    """Which blocks are main text, on a page with an article or main element: those in it, but not in a part whose name says otherwise."""
    if not any(n in MAIN for b in found for n in b.names):
        return None
    out = []
    for b in found:
        last = max((i for i, n in enumerate(b.names) if n in MAIN), default=None)
        out.append(last is not None and not any(worth(n) < 0 and n != "header" for n in b.names[last + 1 :]))
    return np.array(out)


def fit(pages: list[str]) -> Weights:
    """A logistic classifier, drawn to the prior where the pages say nothing; one page of five is kept back to choose the scale by."""
    taught = [(found, y) for found in map(blocks, pages) if found and (y := labels(found)) is not None]
    if not taught:
        return PRIOR
    part = _fit([t for i, t in enumerate(taught) if i % 5] or taught)
    errors = []
    for scale in SCALES:
        tried = part._replace(scale=scale)
        shown = sum(int((np.array(labelled(found, tried)[0]) != y).sum()) for found, y in taught[::5])
        hidden = sum(int((np.array(labelled([b._replace(names=()) for b in found], tried)[0]) != y).sum()) for found, y in taught[::5])
        errors.append(shown + hidden)
    return _fit(taught)._replace(scale=SCALES[int(np.argmin(errors))])


def _fit(taught: list[tuple[list[Block], np.ndarray]]) -> Weights:
    met = Counter(n for found, _ in taught for n in {n for b in found for n in b.names})
    names = [n for n, c in sorted(met.items(), key=lambda x: (-x[1], x[0])) if c >= NAME_PAGES and n not in PARENTS - ELEMENTS.keys()][:MOST_NAMES]
    number = {n: i for i, n in enumerate(names)}
    xs, ys, fixed = [], [], []
    for found, y in taught:
        shown, rest = np.zeros((len(found), len(names))), np.zeros(len(found))
        for i, b in enumerate(found):
            for n, share in shares(b.names, dict.fromkeys(names, 1.0)).items():
                if n in number:
                    shown[i, number[n]] = share
                else:
                    rest[i] += share * worth(n)
        x = features(found)
        xs += [np.hstack([x, shown]), np.hstack([x, np.zeros_like(shown)])]
        fixed += [rest, np.zeros(len(found))]
        ys += [y, y]
    x, y, fixed = np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(fixed)
    prior = np.concatenate([PRIOR.text, [worth(n) for n in names]])
    w, ridge = prior.copy(), 2e-3
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w + fixed, -30, 30)))
        bend = (x * (q * (1 - q))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(bend, x.T @ (q - y) / len(x) + ridge * (w - prior))
    return Weights(w[: len(PRIOR.text)], dict(zip(names, w[len(PRIOR.text) :].tolist(), strict=True)))


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut; source, sink: terminal capacities, edges: (a, b, capacity both ways).

    A node whose preference is no less than all its other capacities is settled first, which shifts its edges to its
    neighbours' terminals; the rest is Dinic's algorithm.
    """
    n = len(source)
    want = [a - b for a, b in zip(source, sink, strict=True)]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(want[i]) >= sum(near[i].values()):
            side[i] = want[i] > 0
            for j, c in near[i].items():
                want[j] += c if side[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        for i, s in zip(left, _flow([want[i] for i in left], {i: k for k, i in enumerate(left)}, [near[i] for i in left]), strict=True):
            side[i] = s
    return [bool(s) for s in side]


def _flow(want: list[int], number: dict[int, int], near: list[dict[int, int]]) -> list[bool]:
    n = len(want)
    s, t = n, n + 1
    cap: list[dict[int, int]] = [{number[j]: c for j, c in by.items()} for by in near] + [{}, {}]
    for i, w in enumerate(want):
        if w > 0:
            cap[s][i], cap[i][s] = w, 0
        elif w < 0:
            cap[i][t], cap[t][i] = -w, 0
    while True:
        level = {s: 0}
        queue = deque([s])
        while queue:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 0 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if t not in level:
            return [i in level for i in range(n)]
        arcs = {i: iter(list(cap[i])) for i in level}
        path = [s]
        while path:
            i = path[-1]
            if i == t:
                push = min(cap[a][b] for a, b in zip(path[:-1], path[1:], strict=True))
                for a, b in zip(path[:-1], path[1:], strict=True):
                    cap[a][b] -= push
                    cap[b][a] += push
                cut_at = next(k for k, (a, b) in enumerate(zip(path[:-1], path[1:], strict=True)) if cap[a][b] == 0)
                del path[cut_at + 1 :]
                arcs[path[-1]] = iter([j for j in cap[path[-1]]])
                continue
            for j in arcs[i]:
                if cap[i][j] > 0 and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
            else:
                path.pop()
                level[i] = -1


def labelled(found: list[Block], weights: Weights) -> tuple[list[bool], list[bool]]:
    """Which blocks are main text by the minimum cut, and which by the classifier alone."""
    odds = np.clip(log_odds(found, weights), -MOST_ODDS, MOST_ODDS)
    yes, no = np.log1p(np.exp(odds)), np.log1p(np.exp(-odds))  # prices of the labels "not text" and "text"
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            apart = 0 if a.parents[0] == b.parents[0] else 1 if b.parents[0] == a.parents[1] or a.parents[0] == b.parents[1] else 2 if a.parents[1] == b.parents[1] else 3 + abs(a.depth - b.depth)
            edges.append((i - 1, i, int(weights.scale * NEIGHBOUR / (1 + apart))))
        for parent, capacity in zip(b.parents, (SIBLING, COUSIN), strict=True):
            if (j := last.get((parent, capacity))) is not None and j < i - 1:
                edges.append((j, i, int(weights.scale * capacity)))
            last[parent, capacity] = i
    kept = minimum_cut((yes * UNIT).astype(int).tolist(), (no * UNIT).astype(int).tolist(), edges)
    return kept, (odds > 0).tolist()


def main_text(page: str, weights: Weights) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, k in zip(found, labelled(found, weights)[0], strict=True) if k) if found else ""


def _extracted(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            texts = [main_text(page or "", held.value) for page in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def train(pages: DataFrame, html_col: str = "html") -> Weights:
    """Weights from at most TRAIN_PAGES pages, none of more than TRAIN_CHARS characters: 40 MB at most, and executors send little more."""
    rows = pages.select(column(html_col).alias("html")).where(F.char_length("html").between(1, TRAIN_CHARS)).withColumn("h", F.xxhash64("html"))
    share = min(1.0, 2 * TRAIN_PAGES / max(rows.count(), 1))  # twice as many as are taken: fewer are as good as never found
    few = rows.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).orderBy("h", "html").limit(TRAIN_PAGES)
    return fit([r["html"] for r in few.select("html").collect()])


def extract(pages: DataFrame, weights: Weights, html_col: str = "html") -> DataFrame:
    """pages without html_col and with main_text as the last column: blocks of the main text in page order, joined by line feeds.

    One narrow pass. Null and empty html, and pages without main text, give "". Character references are decoded,
    white space inside a block becomes one space. Repeated rows get equal texts; no rows give no rows. Broken and very long
    pages take time in proportion to their length. If pages has a column main_text, the new one gets "_" behind its name.
    """
    held = pages.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in pages.columns if c != html_col]
    number = F.lit(0).alias(free_name(pages, "__none"))  # a row has one column at least
    rows = pages.select(F.struct(*map(column, kept), number).alias("row"), column(html_col).alias("html"))
    found = rows.mapInArrow(partial(_extracted, held=held), fields(rows, ["row"], "text string"))
    return found.select(*parts(kept, "row"), F.col("text").alias(free_name(pages, "main_text")))


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    """extract() of all pages with a classifier trained on some of them; the cases are those of extract()."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract(pages, train(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


SQL = r"""
WITH b AS (
    SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '</?(h1|p)[^>]*>', chr(1), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), chr(1)) AS parts
    FROM pages),
t AS (
    SELECT page_id, url, list_filter([trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '&(lt|gt|quot|amp|#x27)$', '&\1;'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '[\x20\x09-\x0D]+', ' ', 'g')) FOR x IN parts], lambda x: x <> '') AS parts
    FROM b)
SELECT page_id, url, coalesce(array_to_string(parts, chr(10)), '') AS text, length(coalesce(array_to_string(parts, chr(10)), '')) AS n_chars FROM t
"""
