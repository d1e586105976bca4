"""What users and programs have stored: histories and settings that may be damaged, searches half typed, long utterances."""

import json
import random

from pyspark.sql import functions as F

from quern.operators import evaluate, history
from quern.sources import files
from quern.streaming import session

SOURCE = {"n": 1, "fileId": 2, "name": "a", "snippet": "s"}
GOOD = {"id": "1", "question": "q", "answer": "a", "sources": [SOURCE], "insufficient": False, "invalidCitations": [1], "model": "m", "at": 5}


def parsed(spark, *texts, k=50):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, json string")
    out = {}
    for r in history.parsed_ask_history(df, F.col("json"), "n", k=k).orderBy("n", "place").select("n", "place", F.try_variant_get("entry", "$.id", "string").alias("id")).collect():
        out.setdefault(r["n"], []).append((r["place"], r["id"]))
    return out


def test_entries_are_held_to_their_types_one_by_one(spark):
    bad = [{**GOOD, key: value} for key, value in [("id", 1), ("question", None), ("answer", []), ("sources", {}), ("sources", [3]), ("insufficient", "no"), ("invalidCitations", ["1"]), ("invalidCitations", None), ("model", 2), ("at", "5")]]
    bad += [{**GOOD, "sources": [SOURCE, {**SOURCE, key: value}]} for key, value in [("n", "1"), ("fileId", None), ("name", 3), ("location", 4), ("location", None), ("snippet", True)]]
    bad += [{k: v for k, v in GOOD.items() if k != name} for name in GOOD] + [None, 3, "x", [GOOD]]
    good = [{**GOOD, "id": "2", "sources": []}, {**GOOD, "id": "3", "at": 1.5, "sources": [{**SOURCE, "location": "p. 1", "more": 1}], "invalidCitations": []}]
    mixed = [bad[0], good[0], *bad[1:], good[1]]
    assert parsed(spark, json.dumps(mixed), *(json.dumps([b]) for b in bad)) == {0: [(1, "2"), (2, "3")]}


def test_histories_that_are_no_lists(spark):
    assert parsed(spark, None, "", "[", json.dumps(GOOD), "3", "null", "[]", json.dumps([GOOD])[:-1]) == {}
    assert parsed(spark, json.dumps([{**GOOD, "id": str(i)} for i in range(5)]), k=3) == {0: [(1, "0"), (2, "1"), (3, "2")]}


def test_settings_fall_back_one_by_one(spark):
    texts = ['{"on": true, "level": "high", "x": 1}', '{"on": "true", "level": "none"}', '{"on": null, "level": 3}', "[1]", "{", None, "true", '{"level": "high"}']
    df = spark.createDataFrame(list(enumerate(texts)), "n int, json string")
    got = [tuple(r["s"]) for r in df.select("n", history.settings(F.col("json"), {"on": False, "loud": True}, {"level": ("low", "high")}).alias("s")).orderBy("n").collect()]
    assert got == [(True, True, "high")] + [(False, True, "low")] * 6 + [(False, True, "high")]


def test_searches_that_stood(spark):
    rows = [("u", 0, "t", 3, None), ("u", 200, "ta", 3, None), ("u", 400, "tax", 3, None), ("u", 2000, "tax b", 0, None), ("u", 9000, "tax c", 2, 9100), ("u", 9500, "tax d", 2, 9600), ("u", 9550, "x", 1, None), ("v", 1, "only", 1, None), ("w", 1, "none", 0, None)]
    got = history.rested(spark.createDataFrame(rows, "user string, at_ms long, query string, n_results long, opened_ms long")).collect()
    assert {(r["user"], r["query"]) for r in got} == {("u", "tax"), ("u", "tax c"), ("u", "x"), ("v", "only")}


def test_long_utterances_are_cut(spark):
    loud = [("s", i) for i in [*range(10), 20, 21, *range(40, 47)]]
    frames = spark.createDataFrame([(s, i, 0.5) for s, i in loud] + [("t", i, 0.0) for i in range(5)], "stream string, seq int, level double")
    cut = session.utterance_runs(frames, most_frames=4)
    assert sorted((r["first"], r["last"]) for r in cut.collect()) == [(0, 3), (4, 7), (40, 43), (44, 46)]
    assert sorted((r["first"], r["last"]) for r in session.utterance_runs(frames, most_frames=None).collect()) == [(0, 9), (40, 46)]


def test_word_errors_equal_a_plain_table(spark):
    rng = random.Random(4)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 12))], [rng.choice("abcde") for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    long = [str(i % 977) for i in range(6000)]
    rows = [(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)] + [(100, None, "a b"), (101, "A  b", "a B"), (102, " ".join(long), " ".join(long[:2000] + long[2500:]))]
    got = {r["n"]: r["e"] for r in spark.createDataFrame(rows, "n int, a string, b string").select("n", evaluate.word_errors(F.col("a"), F.col("b")).alias("e")).collect()}
    assert got == {i: plain(a, b) for i, (a, b) in enumerate(pairs)} | {100: 2, 101: 0, 102: 500}


def test_folder_list_is_replaced_whole(spark, tmp_path):
    for path in (f"{tmp_path}/folders.json", f"file://{tmp_path}/folders.json"):
        for folders in (["/a", "/b é"], []):
            files.write_folder_list(spark, path, folders, paused=True)
            assert [r["path"] for r in files.folder_list(spark, path).collect()] == folders
    assert json.loads((tmp_path / "folders.json").read_text()) == {"version": 1, "folders": [], "paused": True}
    assert [p.name for p in tmp_path.iterdir() if p.suffix == ".tmp"] == []
