"""Streams with state, in shuffled micro-batches, against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import ask
from quern.streaming import live, session


def streamed(spark, tmp_path, name, df, step, parts, seed=1):
    """The rows that step gives for df, dealt into files of one micro-batch each by the list of row numbers in parts."""
    rows = df.collect()
    for n, part in enumerate(parts):
        shuffled = [rows[i] for i in part]
        random.Random(seed + n).shuffle(shuffled)
        spark.createDataFrame(shuffled, df.schema).coalesce(1).write.parquet(str(tmp_path / name / f"in-{n:03}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "in-*"))
    got = []
    query = step(stream).writeStream.outputMode("append").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / name / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    return got


def dealt(n, size, rng):
    order = [*range(n)]
    rng.shuffle(order)
    return [order[a : a + size] for a in range(0, n, size)]


def test_wake_windows_as_a_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = [(d, "wake", t, None, None) for d in "ab" for t in rng.sample(range(0, 100_000, 100), 8)]
    rows += [(d, "utterance", t, t + 700, f"{d}{t}") for d in "abc" for t in rng.sample(range(0, 100_000, 100), 20)]
    rows += [("a", "wake", 50_300, None, None), ("a", "utterance", 50_000, 50_200, "before a late wake")]
    rows.sort(key=lambda r: r[2])
    # neighbours in time change places, and a last event moves the watermark past all
    order = sorted(range(len(rows)), key=lambda i: rows[i][2] + rng.randint(-4000, 4000))
    end = len(rows)
    rows.append(("z", "wake", 10_000_000, None, None))
    df = spark.createDataFrame(rows, "device string, kind string, at_ms long, stop_ms long, text string")
    got = streamed(spark, tmp_path, "wake", df, live.requests, [*(order[a : a + 20] for a in range(0, end, 20)), [end], [end]])
    want = session.requests(df.where("kind = 'wake'").select("device", "at_ms"), df.where("kind = 'utterance'").select("device", F.col("at_ms").alias("start_ms"), "stop_ms", "text"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and ("a", 50_000, 50_200, "before a late wake", 50_300) in {tuple(r) for r in got}


def test_transcripts_come_in_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(d, n, rng.randint(0, 1000), f"{d}{n}") for d in "ab" for n in range(1, 25)] + [("b", 30, 5, "behind a gap")]
    df = spark.createDataFrame(rows, "device string, seq long, done_ms long, text string")
    got = streamed(spark, tmp_path, "order", df, live.in_order, [*dealt(len(rows), 9, rng), [0, 3, 5]])
    want = {(r["device"], r["seq"], r["text"], r["ready_ms"]) for r in session.in_order(df.where("seq < 30")).collect()}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    for d in "ab":
        assert [r["seq"] for r in got if r["device"] == d] == [*range(1, 25)]


@pytest.mark.parametrize("kind", ["frames", "tokens"])
def test_folds_in_order(spark, tmp_path, kind):
    rng = random.Random(6)
    if kind == "frames":
        rows = [(s, n, rng.random() < 0.08) for s in "xy" for n in range(80)]
        df, step = spark.createDataFrame(rows, "stream string, seq long, speech boolean"), lambda s: live.reset_frames(s, 8)
        want = [tuple(r) for r in session.reset_frames(df, 8).collect()]
        assert want
    else:
        marker = ask.NO_EVIDENCE
        texts = {1: f"{marker} really", 2: marker, 3: marker[:5] + "x rest", 4: "at once", 5: marker[:7]}
        rows = []
        for a, t in texts.items():
            cuts = sorted(rng.sample(range(1, len(t)), min(4, len(t) - 1)))
            rows += [(a, n + 1, t[i:j]) for n, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(t)], strict=True))]
        df, step = spark.createDataFrame(rows, "ask_id long, seq long, token string"), live.shown_tokens
        shown = ask.shown_tokens(df).select("ask_id", "seq", "token", "held").collect()
        released = {r["ask_id"] for r in shown if not r["held"]}
        want = [tuple(r) for r in shown if r["ask_id"] in released]
        assert released == {3, 4}
    got = streamed(spark, tmp_path, kind, df, step, dealt(len(rows), 7 if kind == "tokens" else 40, rng))
    assert sorted(map(tuple, got)) == sorted(want)


def test_models_unload_when_idle(spark, tmp_path):
    rng = random.Random(9)
    times = {m: sorted(rng.sample(range(0, 3_000_000, 1000), 25)) for m in "pq"}
    rows = sorted(((m, t) for m, own in times.items() for t in own), key=lambda r: r[1] + rng.randint(-4000, 4000))
    end = len(rows)
    rows.append(("z", 90_000_000))
    df = spark.createDataFrame(rows, "model string, at_ms long")
    got = streamed(spark, tmp_path, "spans", df, live.loaded_spans, [*([*range(a, min(a + 17, end))] for a in range(0, end, 17)), [end], [end]])
    want = session.loaded_spans(df.where("model <> 'z'")).collect()
    assert sorted(map(tuple, got)) == sorted((r["model"], r["start_ms"], r["stop_ms"], r["uses"]) for r in want)
