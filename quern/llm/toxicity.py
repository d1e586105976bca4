"""Toxic spans by a linear-chain conditional random field, trained here on labelled documents.

Labels mark documents; token labels for training are those words and word beginnings of toxic training documents
that hardly occur in clean ones. The field tags runs of SEQUENCE words; forward-backward gives each word's
marginal of being toxic. Marginals give the offending offsets, and, through a calibrated logistic function of their
noisy-or and maximum, the document's score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.bytewords import ALNUM, Words, mix, slices
from quern.llm.common import column, cut, fields, free_name, parts, table, tidy, whole_row

#: Training rows of each label, those with the least hashes, and about how many of their runs with a cue are learnt from.
TRAIN_ROWS, TRAIN_RUNS = 1200, 8000
FEATURE_BITS, SEQUENCE, EPOCHS = 18, 64, 12
#: A word or beginning is a toxic cue if it is in so many, and such a share, of toxic training documents and so much likelier there.
CUE_DOCUMENTS, CUE_SHARE, CUE_LOG_ODDS = 5, 0.02, 3.5
PREFIXES = (3, 4, 5, 6)
#: Marginals up to here don't add up to evidence, however many words a text has.
FAINT = 0.1


class Field(NamedTuple):
    """weights of hashed features, log transition factors [from, to], calibration of (1, noisy-or, maximum)."""

    weights: np.ndarray
    steps: np.ndarray
    link: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 0


def _cues(words: Words) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings."""
    out = [words.hash]
    for k in PREFIXES:
        stop = np.minimum(words.end, words.start + k)
        out.append(mix(words.parts(words.start, stop) + np.uint64(k)))
    return out


def _features(words: Words) -> np.ndarray:
    """(words, kinds) of feature numbers: the word, its beginnings and its ending."""
    tail = np.maximum(words.start, words.end - 3)
    kinds = [*_cues(words), mix(words.parts(tail, words.end) + np.uint64(99))]
    return np.stack([(mix(h + np.uint64(7 * i + 1)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32) for i, h in enumerate(kinds)], 1)


def _sequences(words: Words) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and column of each word in a table of runs of SEQUENCE words of one text, and its rows."""
    within = np.arange(len(words.hash)) - words.bounds[words.text]
    runs = -(-words.counts // SEQUENCE)
    first = np.concatenate([[0], np.cumsum(runs)])
    return first[words.text] + within // SEQUENCE, within % SEQUENCE, int(first[-1])


def _marginals(score: np.ndarray, full: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) for each place of each run, and expected steps [from, to]; score: log odds of toxic, full: places with a word."""
    rows, n = score.shape
    a = np.exp(steps)
    psi = np.exp(np.clip(score, -30, 30))
    fwd, back = np.empty((n, rows, 2)), np.ones((n, rows, 2))
    fwd[0, :, 0], fwd[0, :, 1] = 1, psi[:, 0]
    fwd[0] /= fwd[0].sum(1, keepdims=True)
    for t in range(1, n):
        x = fwd[t - 1] @ a
        x[:, 1] *= psi[:, t]
        fwd[t] = x / x.sum(1, keepdims=True)
    for t in range(n - 2, -1, -1):
        x = back[t + 1].copy()
        x[:, 1] *= psi[:, t + 1]
        x = x @ a.T
        x /= x.sum(1, keepdims=True)
        back[t] = np.where(full[:, t + 1, None], x, 0.5)
    both = fwd * back
    p = both[:, :, 1] / both.sum(2)
    pairs = np.zeros((2, 2))
    for t in range(1, n):
        right = back[t].copy()
        right[:, 1] *= psi[:, t]
        joint = fwd[t - 1][:, :, None] * a[None] * right[:, None, :]
        joint *= (full[:, t] / joint.sum((1, 2)))[:, None, None]
        pairs += joint.sum(0)
    return p.T, pairs


def _word_marginals(words: Words, field: Field) -> np.ndarray:
    if not len(words.hash):
        return np.zeros(0)
    row, col, rows = _sequences(words)
    score = np.zeros((rows, SEQUENCE))
    full = np.zeros((rows, SEQUENCE), bool)
    score[row, col] = field.weights[_features(words)].sum(1)
    full[row, col] = True
    return _forward_backward(score, full, field.steps)[row, col]


def _forward_backward(score: np.ndarray, full: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The marginals alone, with odds in place of pairs: r = weight(toxic) / weight(clean)."""
    rows, n = score.shape
    a = np.exp(steps)
    psi = np.exp(np.clip(score, -30, 30)).T.copy()
    fwd, back = np.empty((n, rows)), np.ones((n, rows))
    fwd[0] = psi[0]
    for t in range(1, n):
        fwd[t] = psi[t] * (a[0, 1] + fwd[t - 1] * a[1, 1]) / (a[0, 0] + fwd[t - 1] * a[1, 0])
    there = full.T
    for t in range(n - 2, -1, -1):
        x = psi[t + 1] * back[t + 1]
        back[t] = np.where(there[t + 1], (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x), 1.0)
    odds = fwd * back
    return (odds / (1 + odds)).T


def _evidence(words: Words, p: np.ndarray) -> np.ndarray:
    """(texts, 3): 1, noisy-or in logs, maximum."""
    total = np.concatenate([[0], np.cumsum(np.where(p > FAINT, -np.log1p(-np.minimum(p, 1 - 1e-6)), 0))])
    out = np.zeros((words.texts, 3))
    out[:, 0] = 1
    out[:, 1] = np.minimum(total[words.bounds[1:]] - total[words.bounds[:-1]], 20.0)
    some = np.flatnonzero(words.counts)
    if len(some):
        out[some, 2] = np.maximum.reduceat(p, words.bounds[some])
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """Words, keys and labels of each slice of rows (key, toxic, text)."""
    for batch in batches:
        key, label = batch.column("key").to_numpy(), batch.column("toxic").to_numpy().astype(bool)
        for first, data, off in slices(batch.column("text")):
            words = Words(data, off, ALNUM)
            yield words, key[first : first + words.texts], label[first : first + words.texts]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three least hashes of the shingles of each text."""
    for words, key, label in _labelled(batches):
        text, value = words.shingles(5)
        bounds = np.searchsorted(text, np.arange(words.texts + 1))
        least = np.zeros((3, words.texts), np.uint64)
        for i in np.flatnonzero(np.diff(bounds)):
            h = value[bounds[i] : bounds[i + 1]]
            least[:, i] = [mix(h + np.uint64(s)).min() for s in range(3)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, (key, label.astype(np.int32), np.diff(bounds) > 0, *least.view(np.int64)))], ["key", "toxic", "some", "a", "b", "c"])


def _cue_documents(batches: Iterator[pa.RecordBatch], own: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean texts of own keys each word and beginning is in, by slice."""
    for words, key, label in _labelled(batches):
        pick = np.isin(key, own)[words.text]
        for kind, h in enumerate(_cues(words)):
            pairs = np.unique(np.stack([words.text[pick].astype(np.uint64), h[pick]], 1), axis=0)
            value, at = np.unique(pairs[:, 1], return_inverse=True)
            bad = np.bincount(at, label[pairs[:, 0].astype(np.int64)], len(value)).astype(np.int64)
            clean = np.bincount(at, minlength=len(value)) - bad
            yield pa.RecordBatch.from_arrays([*map(pa.array, (np.full(len(value), kind, np.int32), value.view(np.int64), bad, clean))], ["kind", "hash", "bad", "clean"])


def _marked(words: Words, label: np.ndarray, cues: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Row and column of each word, the tokens that are cues of toxic texts, runs with one, runs of clean texts, and the text of each run."""
    mark = np.zeros(len(words.hash), bool)
    for kind, h in enumerate(_cues(words)):
        if len(cues[kind]):
            mark |= cues[kind][np.minimum(np.searchsorted(cues[kind], h), len(cues[kind]) - 1)] == h
    mark &= label[words.text]
    row, col, rows = _sequences(words)
    y, text = np.zeros((rows, SEQUENCE), bool), np.zeros(rows, np.int64)
    y[row, col], text[row] = mark, words.text
    return row, col, y, y.any(1), ~label[text], text


def _run_counts(batches: Iterator[pa.RecordBatch], cues: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Runs with a cue of each text."""
    for words, _, label in _labelled(batches):
        *_, with_cue, _, text = _marked(words, label, cues)
        yield pa.RecordBatch.from_arrays([pa.array(np.bincount(text[with_cue], minlength=words.texts))], ["cue"])


def _runs(batches: Iterator[pa.RecordBatch], cues: list[np.ndarray], most: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """Features, labels and places of about most[0] runs with a cue of each toxic text and most[1] of each clean one; hashes of key and place choose."""
    for words, key, label in _labelled(batches):
        row, col, y, with_cue, clean, text = _marked(words, label, cues)
        name = np.zeros(len(y), np.uint64)
        within = (np.arange(len(words.hash)) - words.bounds[words.text]) // SEQUENCE
        name[row] = mix(mix(key[words.text].view(np.uint64)) + within.astype(np.uint64))
        u = name / 2.0**64
        count = [np.bincount(text[of], minlength=words.texts)[text] for of in (with_cue, clean)]
        keep = np.flatnonzero((with_cue & (u * count[0] < most[0])) | (clean & (u * count[1] < most[1])))
        new = np.full(len(y), -1)
        new[keep] = np.arange(len(keep))
        pick = new[row] >= 0
        feats, full = np.zeros((len(keep), SEQUENCE, len(PREFIXES) + 2), np.int32), np.zeros((len(keep), SEQUENCE), bool)
        feats[new[row[pick]], col[pick]], full[new[row[pick]], col[pick]] = _features(words)[pick], True
        columns = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (feats, y[keep], full)]
        yield pa.RecordBatch.from_arrays([pa.array(name[keep].view(np.int64)), *columns], ["name", "feats", "y", "full"])


def _evidences(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for words, key, label in _labelled(batches):
        x = _evidence(words, _word_marginals(words, field))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(label.astype(np.int32)), pa.array(x[:, 1]), pa.array(x[:, 2])], ["key", "toxic", "any", "most"])


def fit(texts: list[str], toxic: list[int]) -> Field:
    """The field for labelled texts. Without both labels every score is near 0."""
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array(toxic, pa.int32()), pa.array(texts, pa.string())], ["key", "toxic", "text"])

    def passed(step: partial, schema: str, cue: Callable | None = None) -> pa.Table:
        found = pa.Table.from_batches(step([rows])) if len(texts) else pa.table({c.split()[0]: [] for c in schema.split(", ")})
        if cue is None:
            return found
        total = found.group_by(["kind", "hash"]).aggregate([("bad", "sum"), ("clean", "sum")])
        return total.filter(pa.array(cue(total["bad_sum"].to_numpy(), total["clean_sum"].to_numpy())))

    return _fit(passed)


def _fit(passed: Callable) -> Field:
    """The field; passed(step, schema) gives the rows of a pass over the labelled texts, passed(step, schema, cue) the cues of counts."""
    weights, steps = np.zeros(1 << FEATURE_BITS), np.zeros((2, 2))
    sketch = passed(_sketches, "key long, toxic int, some boolean, a long, b long, c long").sort_by("key").to_pylist()
    label = np.array([r["toxic"] for r in sketch], bool)
    if not label.any() or label.all():
        return Field(weights, steps, np.array([-5.0, 0.0, 0.0]))
    own, seen = np.zeros(len(sketch), bool), set()
    for i, r in enumerate(sketch):  # of near copies one counts, or their words would all be cues
        least = {(s, r[s]) for s in "abc"} if r["some"] else set()
        own[i] = not (least & seen)
        seen |= least
    keys = np.array([r["key"] for r in sketch], np.int64)
    n_clean, n_bad = int((own & ~label).sum()), int((own & label).sum())
    enough, odds = max(CUE_DOCUMENTS, n_bad * CUE_SHARE), float(np.exp(CUE_LOG_ODDS))
    found = passed(
        partial(_cue_documents, own=keys[own]), "kind int, hash long, bad long, clean long",
        lambda bad, clean: (bad >= enough) & ((bad + 0.5) * (n_clean + 1.0) >= odds * (clean + 0.5) * (n_bad + 1.0)),
    )
    kinds, hashes = found["kind"].to_numpy(), found["hash"].to_numpy().view(np.uint64)
    cues = [np.sort(hashes[kinds == kind]) for kind in range(1 + len(PREFIXES))]
    # labelled tokens: cues in toxic documents; runs with one, and about twice as many without
    # each document gives as many at most, so that long ones don't stand for all
    count = passed(partial(_run_counts, cues=cues), "cue long")["cue"].to_numpy()
    most = TRAIN_RUNS / label.sum()
    most = most, max(64, 2 * np.minimum(count, most).sum()) / (~label).sum()
    runs = passed(partial(_runs, cues=cues, most=most), "name long, feats binary, y binary, full binary").sort_by("name")
    feats = np.frombuffer(b"".join(runs["feats"].to_pylist()), np.int32).reshape(-1, SEQUENCE, len(PREFIXES) + 2)
    y, full = (np.frombuffer(b"".join(runs[c].to_pylist()), bool).reshape(-1, SEQUENCE) for c in ("y", "full"))
    order = np.random.default_rng(7).permutation(len(y))
    squares, step_squares = np.full(len(weights), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(EPOCHS):
        for a in range(0, len(order), 512):
            pick = order[a : a + 512]
            f, yy, ff = feats[pick], y[pick], full[pick]
            p, pairs = _marginals(np.where(ff, weights[f].sum(2), 0), ff, steps)
            g = np.where(ff, p - yy, 0)
            slope = np.bincount(f[ff].ravel(), np.repeat(g[ff], f.shape[2]), len(weights)) + 1e-3 * weights
            seen_pairs = np.zeros((2, 2))
            np.add.at(seen_pairs, (yy[:, :-1][ff[:, 1:]].astype(int), yy[:, 1:][ff[:, 1:]].astype(int)), 1)
            step_slope = pairs - seen_pairs + 1e-3 * steps
            squares += slope**2
            step_squares += step_slope**2
            weights -= 0.3 * slope / np.sqrt(squares)
            steps -= 0.1 * step_slope / np.sqrt(step_squares)
    field = Field(weights.astype(np.float32), steps, np.zeros(3))
    seen = passed(partial(_evidences, field=field), "key long, toxic int, any double, most double").sort_by("key")
    x = np.stack([np.ones(len(seen)), seen["any"].to_numpy(), seen["most"].to_numpy()], 1)
    lab = seen["toxic"].to_numpy().astype(float)
    share = own / max(1, own.sum())
    link = np.zeros(3)
    for _ in range(50):  # Newton's method
        q = _logistic(x @ link)
        slope = x.T @ (share * (q - lab)) + 1e-4 * link
        bend = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(3)
        link -= np.linalg.solve(bend, slope)
    return Field(field.weights, steps, link)


def _score(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    field = held.value
    for batch in batches:
        for first, data, off in slices(batch.column("text")):
            words = Words(data, off, ALNUM)
            p = _word_marginals(words, field)
            score = _logistic(_evidence(words, p) @ field.link)
            bad = np.flatnonzero(p >= 0.5)
            spans = [""] * words.texts
            if len(bad):
                points = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
                base = points[off[:-1]]
                new = np.ones(len(bad), bool)
                new[1:] = (np.diff(bad) > 1) | (words.text[bad[1:]] != words.text[bad[:-1]])
                last = np.append(np.flatnonzero(new)[1:] - 1, len(bad) - 1)
                for a, b in zip(bad[new], bad[last], strict=True):
                    t = words.text[a]
                    spans[t] += f"{',' * bool(spans[t])}{points[words.start[a]] - base[t]}:{points[words.end[b]] - base[t]}"
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, words.texts), pa.array(score), pa.array(spans, pa.string())], ["row", "score", "spans"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """A field from at most TRAIN_ROWS labelled documents of each label, none of them held out, each read whole however long it is.

    Executors read the texts; the driver gets counts, cues, and the features of the chosen runs. Of rows of one id one is taken.
    Documents without any of one label give a field whose scores are all near 0.
    """
    marked = labels.where(~held_out(column(id_col)) & column(label_col).isin(0, 1)).select(column(id_col).alias("__id"), column(label_col).cast("int").alias("__toxic"))
    marked = cut(marked.join(docs.select(column(id_col).alias("__id")), "__id", "left_semi"))
    picks = None
    for y in (0, 1):
        part = marked.where(F.col("__toxic") == y).orderBy(F.xxhash64("__id"), "__id").limit(TRAIN_ROWS)
        picks = part if picks is None else picks.unionByName(part)
    picks = cut(picks)
    rows = docs.select(column(id_col).alias("__id"), F.coalesce(column(text_col), F.lit("")).alias("text")).join(F.broadcast(picks), "__id")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    first = rows.groupBy("__id", "__toxic").agg(F.min(F.struct(F.octet_length("text"), F.xxhash64("text"), "row")).getField("row").alias("row"))
    sample = rows.join(F.broadcast(first.select("row")), "row").select(F.xxhash64("__id", "__toxic").alias("key"), F.col("__toxic").alias("toxic"), "text")

    def passed(step: partial, schema: str, cue: Callable | None = None) -> pa.Table:
        found = sample.mapInArrow(step, schema)
        if cue is not None:
            total = found.groupBy("kind", "hash").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"))
            found = total.where(cue(F.col("bad"), F.col("clean")))
        return found.toArrow()

    return _fit(passed)


def _scored(docs: DataFrame, field: Field, text_col: str) -> DataFrame:
    """(row, score, spans): each whole row with its score and spans."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(whole_row(docs.columns).alias("row"), column(text_col).alias("text"))
    return rows.mapInArrow(partial(_score, held=held), fields(rows, ["row"], "score double, spans string"))


def score(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs with toxic_score (0 to 1) and toxic_spans (start:end in code points, comma-joined), as the last two columns.

    One narrow pass: nothing is shuffled. Null and empty texts have no words and get the score of no evidence.
    Equal texts get equal scores, repeated rows included. Empty tables give no rows. Where docs has a column of such a name
    already, the new one gets "_" behind its name.
    """
    found = _scored(docs, field, text_col)
    return found.select(*parts(docs.columns, "row"), F.col("score").alias(free_name(docs, "toxic_score")), F.col("spans").alias(free_name(docs, "toxic_spans")))


@tidy
def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a field trained on those that aren't held out; the cases are those of score()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = train(docs, table(spark, sf_dir, "labels"))
    found = score(docs.withColumn("held_out", held_out(F.col("doc_id"))), field)
    return found.select("doc_id", "held_out", F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.col("toxic_spans").alias("spans"))


def clean_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those whose score is 0.5 or more, by a field trained on docs and labels.

    Null and empty texts stay; repeated rows stay or go together; an empty table gives no rows. Without labels of
    both kinds all stay. Columns may have any names.
    """
    return _scored(docs, train(docs, labels, id_col, text_col), text_col).where(F.col("score") < 0.5).select(*parts(docs.columns, "row"))
