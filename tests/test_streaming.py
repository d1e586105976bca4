"""Sessions, wake windows, debouncing, history, answers and metrics."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from quern.operators import ask, evaluate, folders, history, suggest
from quern.streaming import ingest, session
from quern.streaming.session import Event, State, played

EVENTS = "session string, at long, type string, kind string, pick string, reveal boolean"
STORY = [
    ("s", 0, "wake", None, None, None), ("s", 100, "utterance", "empty", None, None), ("s", 3000, "utterance", "agree", None, None), ("s", 9000, "utterance", "file", None, None), ("s", 9100, "wake", None, None, None),
    ("s", 9500, "files_shown", None, None, None), ("s", 12_000, "utterance", "file", "2", None), ("s", 13_000, "utterance", "file", None, True), ("s", 22_000, "tick", None, None, None), ("s", 22_001, "tick", None, None, None),
    ("t", 5, "wake", None, None, None), ("t", 8005, "tick", None, None, None), ("t", 8006, "tick", None, None, None), ("t", 8100, "utterance", "file", None, None),
]
WANT = {
    "s": [("prompting", "show_prompt"), ("prompting", ""), ("awaiting", "show_await,expect:8000"), ("working", "find_files"), ("working", ""), ("following", "expect:10000"), ("following", "select:2,expect:10000"), ("following", "reveal,expect:9000"), ("following", ""), ("idle", "")],
    "t": [("prompting", "show_prompt"), ("prompting", ""), ("idle", "close"), ("idle", "")],
}


def by_session(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["session"], r["at"])):
        out.setdefault(r["session"], []).append((r["phase"], r["actions"]))
    return out


def test_sessions_as_batch(spark):
    assert by_session(session.sessions_batch(spark.createDataFrame(STORY, EVENTS)).collect()) == WANT


def test_sessions_as_stream(spark, tmp_path):
    source = tmp_path / "in"
    df = spark.createDataFrame(STORY, EVENTS)
    for n, part in enumerate(("at < 3001", "at between 3001 and 9200", "at > 9200")):
        df.where(part).coalesce(1).write.parquet(str(source / f"{n}"))
    for n in range(3):
        stream = spark.readStream.schema(df.schema).parquet(str(source / "[0-2]"))
    rows = []
    query = session.sessions_stream(stream, timers=False).writeStream.foreachBatch(lambda b, _: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(rows) == len(STORY)


def test_prompts_close_by_themselves(spark, tmp_path):
    df = spark.createDataFrame([("s", 1000, "wake", "", "", False)], EVENTS)
    df.coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "*"))
    rows = []
    query = session.sessions_stream(stream).writeStream.foreachBatch(lambda b, _: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    deadline = time.time() + 60
    while len(rows) < 2 and time.time() < deadline:
        time.sleep(0.5)
    query.stop()
    assert [(r["phase"], r["actions"]) for r in rows] == [("prompting", "show_prompt"), ("idle", "close")]


def test_exchanges_queues_and_unloading(spark):
    actions = spark.createDataFrame([("a", 1, "working", "find_files"), ("b", 2, "working", "find_files"), ("c", 3, "working", "ask")], session.OUT)
    asked = spark.createDataFrame([("a", 1, 10, False), ("b", 2, 20, True), ("c", 3, 30, False)], "session string, at long, query_id long, folder boolean")
    results = spark.createDataFrame([(10, 1, "x", "/f"), (10, 2, "y", "/f"), (20, 1, "z", "/g"), (20, 2, "w", "/f"), (20, 3, "v", "/g")], "query_id long, rank int, name string, folder string")
    none = spark.createDataFrame([], "query_id long, folder string, place int")
    got = {r["session"]: (r["kind"], r["shown"]) for r in session.dispatched(actions, asked, results, none).collect()}
    assert got == {"a": ("files", ["x", "y"]), "b": ("parent folders", ["/g", "/f"])}
    known = spark.createDataFrame([(20, "/h", 1)], "query_id long, folder string, place int")
    assert {r["session"]: r["shown"] for r in session.dispatched(actions, asked, results, known).collect()}["b"] == ["/h"]
    said = spark.createDataFrame([("d", 1, 50, "one"), ("d", 2, 20, "two"), ("d", 3, 70, "three")], "device string, seq long, done_ms long, text string")
    assert [r["ready_ms"] for r in session.in_order(said).orderBy("seq").collect()] == [50, 50, 70]
    uses = spark.createDataFrame([("m", t) for t in (0, 100_000, 230_000)], "model string, at_ms long")
    assert sorted((r["start_ms"], r["stop_ms"], r["uses"]) for r in session.loaded_spans(uses).collect()) == [(0, 220_000, 2), (230_000, 350_000, 1)]
    frames = spark.createDataFrame([("s", i, i in (1, 2, 20, 25)) for i in range(40)], "stream string, seq long, speech boolean")
    assert sorted(r["seq"] for r in session.reset_frames(frames).collect()) == [10, 33]


def test_reconciling_sees_deletions(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    from quern.sources import files as sources

    known = spark.createDataFrame([tuple(r) for r in sources.listing(spark, str(tmp_path)).select("path", "size", "mtime_ms").collect()], "path string, size long, mtime_ms long")
    (tmp_path / "a.txt").unlink()
    (tmp_path / "b.txt").write_text("three")
    (tmp_path / "c.txt").write_text("new")
    fresh, gone = ingest.reconciled(spark, str(tmp_path), known)
    assert sorted(r["path"][-5:] for r in fresh.collect()) == ["b.txt", "c.txt"] and [r["path"][-5:] for r in gone.collect()] == ["a.txt"]


def test_machine_edges():
    assert played(State("working"), [Event(1, "finished")])[0] == State() and played(State("following", 50), [Event(10, "utterance", "refuse")])[1] == [(10, "idle", "close")]
    assert played(State("following", 50), [Event(10, "utterance", "question")])[0] == State("working") and played(State(), [Event(1, "utterance", "file")])[1] == [(1, "idle", "")]
    assert played(State("awaiting", 50), [Event(10, "dismiss")])[1] == [(10, "idle", "close")]


def test_wake_windows(spark):
    wakes = spark.createDataFrame([("d", 10_000), ("d", 30_000)], "device string, at_ms long")
    said = spark.createDataFrame([("d", 9600, 9900, "late wake"), ("d", 9400, 9500, "too early"), ("d", 18_000, 18_500, "in"), ("d", 18_001, 18_900, "out"), ("e", 10_001, 10_002, "other"), ("d", 37_999, 38_100, "in two")], "device string, start_ms long, stop_ms long, text string")
    assert {(r["text"], r["wake_ms"]) for r in session.requests(wakes, said).collect()} == {("late wake", 10_000), ("in", 10_000), ("in two", 30_000)}
    assert {r["text"] for r in session.second_chances(said).collect()} == {"late wake", "in", "out"}


def test_wake_windows_grow_with_their_rows(spark):
    rng = random.Random(8)
    wakes = [(d, rng.randrange(-5000, 60_000)) for d in "abc" for _ in range(60)] + [("a", None), (None, 10)]
    said = [(d, s, s + 5, f"{d}{s}") for d in "abcd" for s in rng.sample(range(-9000, 70_000), 150)] + [("b", 100, 105, "twice")] * 2 + [(None, 10, 11, "nobody"), ("a", None, 11, "never")]
    found = session.requests(spark.createDataFrame(wakes, "device string, at_ms long"), spark.createDataFrame(said, "device string, start_ms long, stop_ms long, text string"), 700, 90)
    near = {u: [a for d, a in wakes if d == u[0] and None not in (d, a, u[1]) and a - 90 <= u[1] <= a + 700] for u in said}
    assert sorted(map(tuple, found.collect())) == sorted((*u, max(at)) for u, at in near.items() if at)
    # a window of ten thousand buckets: no wake becomes more than two rows
    far = session.requests(spark.range(40).selectExpr("'d' AS device", "id * 100000 AS at_ms"), spark.createDataFrame([("d", 4_000_001, 0, "x")], "device string, start_ms long, stop_ms long, text string"), 100_000_000)
    assert far.first()["wake_ms"] == 3_900_000 and "sequence(" not in far._jdf.queryExecution().optimizedPlan().toString()


def test_frames(spark):
    frames = spark.createDataFrame([(1, [0.0] * 4), (2, [0.0, float("nan"), 0.0, 0.0]), (3, [0.0]), (4, [float("inf")] * 4)], "seq long, samples array<double>")
    assert [r["seq"] for r in session.valid_frames(frames, 4).collect()] == [1]
    levels = spark.createDataFrame([("s", i, 0.5 if i in (1, 2, 3, 7, 20, 30, 31, 32, 33) else 0.0) for i in range(40)], "stream string, seq long, level double")
    assert sorted((r["first"], r["last"]) for r in session.utterance_runs(levels).collect()) == [(1, 7), (30, 33)]


def test_debounced_stream_equals_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [("a", start + datetime.timedelta(milliseconds=ms), f"v{ms}") for ms in (0, 1000, 2400, 5000, 5100)] + [("z", start + datetime.timedelta(days=1), "end")]
    df = spark.createDataFrame(rows, "key string, ts timestamp, value string")
    want = {(r["key"], r["n"], r["last"]) for r in history.debounced(df).collect()}
    assert want == {("a", 3, "v2400"), ("a", 2, "v5100"), ("z", 1, "end")}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ingest.debounced(stream).writeStream.outputMode("append").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {(r["key"], r["n"], r["last"]) for r in got} == want - {("z", 1, "end")}
    assert {r["last"] for r in history.coalesced(df).collect()} == {"v0", "v1000", "v2400", "v5100", "end"}


def test_history(spark):
    typed = spark.createDataFrame([("u", 1, "prop"), ("u", 2, "Proposal"), ("u", 3, "proposal 50%"), ("u", 4, "tax "), ("u", 5, " ")], "user string, ts long, query string")
    assert [r["query"] for r in history.recent_searches(typed).orderBy("place").collect()] == ["tax", "proposal 50%"]
    start = datetime.datetime(2024, 1, 1)
    crashes = spark.createDataFrame([("e", start + datetime.timedelta(seconds=s)) for s in (0, 100, 200, 299, 700)], "key string, ts timestamp")
    assert [(r["recent"], r["gives_up"]) for r in history.restart_policy(crashes).orderBy("ts").collect()] == [(1, False), (2, False), (3, False), (4, True), (1, False)]


def test_answers(spark):
    files = spark.createDataFrame([(1, "lease", 86_400_000, "linked"), (1, "lease copy", 0, "linked")], "content_id long, name string, mtime_ms long, status string")
    results = spark.createDataFrame([(7, 1, 1, "The rent is 900. The sky is blue.")], "query_id long, content_id long, rank int, text string")
    numbered = ask.sources(results, files)
    assert [tuple(r) for r in numbered.select("n", "name", "modified").collect()] == [(1, "lease", "1970-01-02")]
    questions = spark.createDataFrame([(7, "What is the rent?"), (8, "none")], "query_id long, query string")
    prompt = ask.prompts(questions, numbered).collect()
    assert len(prompt) == 1 and prompt[0]["prompt"] == "Sources:\n\n[1] file: lease (modified 1970-01-02)\n<<<\nThe rent is 900. The sky is blue.\n>>>\n\nQuestion: What is the rent?"
    answers = ask.checked(ask.extractive(numbered, spark.createDataFrame([(7, ["rent"]), (8, ["x"])], "query_id long, terms array<string>")), F.lit(1))
    assert {r["query_id"]: (r["answer"], r["insufficient"], r["invalid"]) for r in answers.collect()} == {7: ("The rent is 900. [1]", False, []), 8: (ask.NO_EVIDENCE, True, [])}
    tokens = spark.createDataFrame([(1, 1, "NOT_"), (1, 2, "ENOUGH"), (1, 3, " tea")], "ask_id long, seq long, token string")
    assert [(r["token"], r["held"]) for r in ask.shown_tokens(tokens).orderBy("seq").collect()] == [("NOT_", True), ("ENOUGH", True), (" tea", False)]
    first = spark.createDataFrame([(7, False), (9, True)], "query_id long, low_confidence boolean")
    assert {r["query_id"]: r["abstains"] for r in ask.gate(questions, first).collect()} == {7: False, 8: True}
    assert [r["cited"] for r in ask.cited(numbered, answers).collect()] == [True]


def test_metrics(spark):
    results = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 4), (3, 9, 12)], "query_id long, content_id long, rank int")
    relevant = spark.createDataFrame([(1, 6), (1, 8), (2, 7), (3, 9), (4, 1)], "query_id long, content_id long")
    r = evaluate.known_item_metrics(results, relevant).first()
    assert (r["queries"], r["mrr_10"], r["hit_5"], r["found_5"]) == (4, round((0.5 + 0.25) / 4, 6), 0.5, round(1.5 / 4, 6))
    pairs = spark.createDataFrame([("the cat sat", "the bat sat down"), ("a b", "a b")], "said string, heard string")
    assert evaluate.word_error_rate(pairs, "said", "heard").first()["wer"] == pytest.approx(2 / 5)
    values = spark.createDataFrame([("g", float(v)) for v in (5, 1, 1, 9)], "g string, v double")
    assert {r["share"]: r["v"] for r in evaluate.nearest_rank(values, "v", [0.0, 0.5, 1.0], "g").collect()} == {0.0: 1.0, 0.5: 5.0, 1.0: 9.0}


def test_folders(spark):
    dirs = spark.createDataFrame([("/me/Taxes",), ("/me/Taxes/2023",), ("/me/Recipes",), ("/me/taxonomy",), ("/me/s",)], "folder string")
    asked = spark.createDataFrame([(1, "my tax folder"), (2, "the recipe")], "query_id long, query string")
    got = [(r["query_id"], r["folder"], r["score"]) for r in folders.match(asked, dirs).orderBy("query_id", "place").collect()]
    assert got == [(1, "/me/Taxes", 2), (1, "/me/taxonomy", 1), (2, "/me/Recipes", 1)]


def test_distinctive_words(spark):
    contents = spark.createDataFrame([(1, "Lisbon flight flight hotel Hotel hotel"), (2, "flight delay")], "content_id long, text string")
    words = suggest.forms(contents)
    freq = spark.createDataFrame([("flight", 2), ("hotel", 1), ("lisbon", 1), ("delay", 1)], "term string, df long")
    rows = {(r["content_id"], r["key"]): (r["tf"], r["form"]) for r in suggest.distinctive(words, freq, 2).collect()}
    assert rows[1, "hotel"] == (3, "hotel") and rows[1, "flight"] == (2, "flight") and rows[2, "delay"] == (1, "delay")


def test_names_weigh_more_and_common_words_nothing(spark):
    contents = spark.createDataFrame([(1, "we met Lisbon, then Lisbon again and tomorrow always meeting meeting")], "content_id long, text string")
    words = suggest.forms(contents)
    freq = spark.createDataFrame([("lisbon", 1), ("meeting", 1)], "term string, df long")
    rows = {r["key"]: r["score"] / r["idf"] for r in suggest.distinctive(words, freq, 9).collect()}
    assert rows == {"lisbon": 3.0, "meeting": 2.0}


def test_words_are_counted_where_their_text_is(spark):
    contents = suggest.together(spark.createDataFrame([(i, "Budget memos by Acme cover Budget memos.") for i in range(50)], "content_id long, text string"))
    freq = spark.createDataFrame([("budget", 50)], "term string, df long")
    words = suggest.forms(contents)
    plan = suggest.tallies(words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(content_id") == 1 and plan.count("Exchange") == 1  # texts, and no words
    found = suggest.phrases(contents, words, suggest.distinctive(words, freq, 50)).collect()
    assert {(r["phrase"], r["tf"]) for r in found} == {("budget memos", 2)} and len(found) == 50


def test_suggestions_vary_kinds_and_folders(spark):
    rows = [(1, "code", "f:a", 9), (2, "text", "f:a", 8), (3, "text", "f:b", 7), (4, "code", "f:c", 6), (5, "text", "f:b", 5)]
    made = [{"content_id": c, "kind": k, "dir": d, "mtime_ms": m} for c, k, d, m in sorted(rows, key=lambda r: (r[1] == "code", -r[3]))]
    assert [r["content_id"] for r in suggest.pick_varied(made, 3)] == [2, 4, 3]
    assert [r["content_id"] for r in suggest.pick_varied(made, 5)] == [2, 4, 3, 5, 1]
    files = spark.createDataFrame([(1, 1, "Lease_Agreement.pdf", "home/lease.pdf", "pdf", "/d", 5, "linked"), (2, 2, "LICENSE", "LICENSE", "text", "/d", 6, "linked"), (3, 3, "x.txt", "recipes/x.txt", "text", "/d", 4, "linked")], "file_id long, content_id long, name string, rel_path string, kind string, folder string, mtime_ms long, status string")
    chunks = spark.createDataFrame([(1, 0, "the landlord asks deposit deposit landlord agreement agreement agreement"), (2, 0, "warranty warranty liability"), (3, 0, "tomato, basil, tomato, basil, basilico, tomato")], "content_id long, ord int, text string")
    freq = spark.createDataFrame([("landlord", 1)], "term string, df long")
    got = {r["content_id"]: r["query"] for r in suggest.suggestions(files, chunks, freq, 50).collect()}
    assert got == {1: "agreement about deposit and landlord", 3: "recipe about tomato and basil"}


def test_suggestions_read_texts_to_their_end(spark):
    files = spark.createDataFrame([(1, 1, "x.txt", "x.txt", "text", "/d", 5, "linked")], "file_id long, content_id long, name string, rel_path string, kind string, folder string, mtime_ms long, status string")
    late = {20: "basil tomato tomato", 21: "tomato basil tomato"}
    chunks = spark.createDataFrame([(1, n, late.get(n, "landlord deposit" if n == 0 else "and so")) for n in range(40)], "content_id long, ord int, text string")
    got = suggest.suggestions(files, chunks, spark.createDataFrame([("landlord", 1)], "term string, df long"), 50).collect()
    assert [tuple(r) for r in got] == [(1, "notes about tomato and basil")]
