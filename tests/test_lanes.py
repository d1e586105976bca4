"""Lanes: commits that survive kills, deletions, retries, and what comes first."""

import os
import time

from pyspark.sql import functions as F

from quern.streaming.lanes import LANES, Lanes


def files(root, n=7):
    os.makedirs(root / "sub", exist_ok=True)
    for i in range(n):
        (root / f"f{i}.txt").write_text(f"text number {i}. " * (i + 1))
    (root / "sub" / "same.txt").write_text("text number 3. " * 4)
    (root / "sub" / "notes.md").write_text("# Head\n\nsome words\n\n## Next\n\nmore words\n")
    (root / "broken.pdf").write_bytes(b"%PDF-1.4 nothing in it")
    (root / "empty.txt").write_text("")


def tables(lanes):
    """All tables, without what depends on the folder's name."""
    at = lambda c: F.element_at(F.split(c, "/"), -1)
    shown = {
        "files": lanes.read("files").select(at("path"), "kind", "size", "status", "attempts", "content_id"), "contents": lanes.read("contents").drop("path", "mtime_ms"),
        "chunks": lanes.read("chunks"), "vectors": lanes.read("vectors").select("content_id", "ord", F.size("vec")),
    }
    return {name: sorted(map(str, df.collect())) for name, df in shown.items()}


def change(root):
    (root / "f1.txt").unlink()
    (root / "f2.txt").write_text("now something else")
    (root / "new.txt").write_text("text number 4. " * 5)  # as f4
    (root / "f3.txt").unlink()  # sub/same.txt still has its content


class Killed(BaseException):
    pass


def test_lanes_survive_kills_between_and_inside_commits(spark, tmp_path, monkeypatch):
    calm, other = tmp_path / "calm", tmp_path / "other"
    files(calm)
    files(other)
    undisturbed = Lanes(spark, str(tmp_path / "a"), str(calm), batch=5)
    assert undisturbed.scan() and undisturbed.run() >= 6 and not undisturbed.scan()
    change(calm)
    assert undisturbed.scan()
    undisturbed.run()
    want = tables(undisturbed)
    assert len(want["files"]) == 9 and len(want["contents"]) == 8 and len(want["vectors"]) == len(want["chunks"]) > 5
    publish, calls = Lanes._publish, []

    def killing(self, number, paths):
        calls.append(number)
        if len(calls) % 3 == 1:
            raise Killed  # all is written, the version isn't
        out = publish(self, number, paths)
        if len(calls) % 3 == 2:
            raise Killed  # the version is written, but nobody knows
        return out

    monkeypatch.setattr(Lanes, "_publish", killing)
    kills = 0
    for step in (lambda: None, lambda: change(other)):
        step()
        while True:
            lanes = Lanes(spark, str(tmp_path / "b"), str(other), batch=5)  # as a new process would
            try:
                lanes.scan()
                lanes.run()
                break
            except Killed:
                kills += 1
    assert kills > 8 and tables(lanes) == want
    monkeypatch.undo()
    number = lanes.compact()
    assert tables(Lanes(spark, str(tmp_path / "b"), str(other))) == want and lanes.version()[0] == number and all(len(p) == 1 for p in lanes.version()[1].values())


def test_words_come_before_meaning_and_failures_are_tried_again(spark, tmp_path, monkeypatch):
    root = tmp_path / "in"
    files(root, 3)
    lanes = Lanes(spark, str(tmp_path / "t"), str(root), embedder=lambda texts: [[1.0, float(len(t)), 0.0] for t in texts], batch=100)
    lanes.scan()
    os.unlink(root / "f0.txt")  # listed, but gone before it is read
    seen = []
    while lane := lanes.step():
        seen.append(lane)
    assert seen == sorted(seen, key=LANES.index) or [s for s in seen if s != "hash"] == sorted((s for s in seen if s != "hash"), key=LANES.index)
    state = {r["path"].rsplit("/", 1)[-1]: (r["status"], r["attempts"]) for r in lanes.read("files").collect()}
    assert state["f0.txt"] == ("error", 5) and state["f1.txt"] == ("linked", 0)
    assert {r["extract_status"] for r in lanes.read("contents").collect()} >= {"ok", "corrupt"} and set(lanes.waiting().values()) == {0}
    assert {len(r["vec"]) for r in lanes.read("vectors").collect()} == {3}
    before = tables(lanes)
    lanes.root = str(tmp_path / "missing")
    assert not lanes.scan() and tables(lanes) == before  # a root that isn't there deletes nothing


def test_a_trigger_reconciles(spark, tmp_path):
    root = tmp_path / "in"
    files(root, 2)
    lanes = Lanes(spark, str(tmp_path / "t"), str(root))
    query = lanes.start("1 second", str(tmp_path / "ticks"))

    def until(holds, seconds=120):
        end = time.time() + seconds
        while time.time() < end and not holds():
            assert query.exception() is None
            time.sleep(1)
        return holds()

    names = lambda: {r["path"].rsplit("/", 1)[-1] for r in lanes.read("files").where("status = 'linked'").collect()}
    try:
        assert until(lambda: "f1.txt" in names() and not any(lanes.waiting().values()))
        (root / "f1.txt").unlink()
        (root / "later.txt").write_text("came later")
        assert until(lambda: "f1.txt" not in names() and "later.txt" in names() and not any(lanes.waiting().values()))
    finally:
        query.stop()
    assert not lanes.read("chunks").where("text = 'came later'").isEmpty()


