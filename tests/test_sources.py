"""Files, chunks, audio, and ingest as a stream."""

import io
import json
import random
import wave
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.operators import chunking
from quern.sources import files
from quern.streaming import ingest

DOCX = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'
P = '<w:p>{}<w:r><w:t>{}</w:t></w:r></w:p>'


def docx(paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", DOCX.format("".join(P.format(f'<w:pPr><w:pStyle w:val="Heading{h}"/></w:pPr>' if h else "", t) for h, t in paragraphs)))
    return out.getvalue()


def pdf(pages):
    out = b"%PDF-1.4\n"
    for text in pages:
        body = zlib.compress("BT {} ET".format(" T* ".join(f"({line}) Tj" for line in text.split("\n"))).encode("cp1252"))
        out += b"1 0 obj <</Filter /FlateDecode>> stream\n" + body + b"\nendstream endobj\n"
    return out + b"%%EOF"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a" / "node_modules").mkdir(parents=True)
    (tmp_path / "a" / "node_modules" / "x.js").write_text("no")
    (tmp_path / "notes.md").write_text("# Title #\n\nOne para\nmore.\n\n```\n# no heading\n\n```\n## Part\ntext\n")
    (tmp_path / "a" / "old.txt").write_bytes("café".encode("cp1252"))
    (tmp_path / "a" / "wide.txt").write_bytes(b"\xff\xfe" + "hé".encode("utf-16-le"))
    (tmp_path / "bin.txt").write_bytes(b"a\0b")
    (tmp_path / "doc.docx").write_bytes(docx([(1, "Head"), (0, "Body &amp; more"), (2, "Sub"), (0, "End")]))
    (tmp_path / "bad.docx").write_bytes(b"PK\x03\x04zzz")
    (tmp_path / "two.pdf").write_bytes(pdf(["First page.\nIt goes\non", "Second page"]))
    (tmp_path / "cut.pdf").write_bytes(b"%PDF-1.4 zz")
    (tmp_path / "scan.pdf").write_bytes(pdf([""]))
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "app.exe").write_bytes(b"no")
    return tmp_path


def test_listing_and_extraction(spark, folder):
    listed = files.listing(spark, str(folder))
    assert {r["rel_path"] for r in listed.collect()} == {"notes.md", "a/old.txt", "a/wide.txt", "bin.txt", "doc.docx", "bad.docx", "two.pdf", "cut.pdf", "scan.pdf"}
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder)).select("path", "content")
    got = {r["rel_path"]: r for r in files.extract(listed.join(content, "path")).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"notes.md": "ok", "a/old.txt": "ok", "a/wide.txt": "ok", "bin.txt": "binary", "doc.docx": "ok", "bad.docx": "corrupt", "two.pdf": "ok", "cut.pdf": "corrupt", "scan.pdf": "no_text"}
    assert got["a/old.txt"]["text"] == "café" and got["a/wide.txt"]["text"] == "hé" and got["notes.md"]["title"] == "Title"
    assert [b["heading"] for b in got["notes.md"]["blocks"]] == [1, None, None, 2, None]
    assert got["doc.docx"]["text"] == "Head\n\nBody & more\n\nSub\n\nEnd" and got["doc.docx"]["title"] == "Head"
    assert got["two.pdf"]["text"] == "First page.\nIt goes on\n\nSecond page" and [b["page"] for b in got["two.pdf"]["blocks"]] == [1, 2] and got["two.pdf"]["page_count"] == 2
    assert files.directory_size(spark, str(folder)).first()["bytes"] > 0


def test_folder_list_and_json_lines(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"folders": ["/a", 3, "/b"]}))
    (tmp_path / "bad.json").write_text("{nope")
    assert [r["path"] for r in files.folder_list(spark, str(tmp_path / "f.json")).collect()] == ["/a", "/b"] and files.folder_list(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "l.jsonl").write_text('{"k": 1}\n{bad\n{"k": 2}')
    assert [r["k"] for r in files.json_lines(spark, str(tmp_path / "l.jsonl"), "k long").collect()] == [1, 2]


def test_audio_frames(spark, tmp_path):
    path = tmp_path / "x.wav"
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes((1000).to_bytes(2, "little", signed=True) * 2000)
    rows = files.wav_frames(spark.read.format("binaryFile").load(str(path))).withColumn("level", files.level(files.F.col("samples"))).orderBy("seq").collect()
    assert [len(r["samples"]) for r in rows] == [1600, 1600] and rows[1]["samples"][-1] == 0 and abs(rows[0]["level"] - 1000 / 32768) < 1e-6


texts = st.lists(st.sampled_from(["# Head\n", "## Sub\n", "#### Deep\n", "word " * 40 + ".\n", "Sentence one. Two! " * 90, "\n\n", "x" * 2600, "é😀 tail\n"]), max_size=12).map("".join)


@settings(max_examples=80, deadline=None)
@given(texts)
def test_chunks_are_slices_that_cover_the_text(body):
    blocks, _ = files.markdown(body)
    made = chunking.chunks(body, blocks)
    reach = 0
    for s in made:
        assert body[s.start : s.stop] == body[s.start : s.stop].strip() and s.stop - s.start <= chunking.PROSE.most + chunking.PROSE.target
        assert not body[reach : s.start].strip() or s.start <= reach
        reach = max(reach, s.stop)
    assert not body[reach:].strip()


def test_chunk_sections_and_stitching(spark):
    body = "# One\n\n" + "First words here. " * 100 + "\n\n## Two\n\n" + "Other words. " * 30 + "\n\n# Three\n\nend"
    blocks, _ = files.markdown(body)
    made = chunking.chunks(body, blocks)
    assert [s.section for s in made] == ["One", "One", "One › Two", "Three"] or {s.section for s in made} == {"One", "One › Two", "Three"}
    rng = random.Random(2)
    rows = [(i, "text", " ".join(rng.choice(["alpha", "beta.", "gamma"]) for _ in range(n))) for i, n in enumerate([1, 30, 400, 3000])]
    df = spark.createDataFrame(rows, "content_id long, kind string, text string")
    whole = {r["content_id"]: " ".join(r["text"].split()) for r in chunking.stitch(chunking.chunk(df)).collect()}
    assert whole == {i: t for i, _, t in rows}


def test_ingest_stream_goes_on_where_it_was(spark, tmp_path):
    root, table, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    root.mkdir()
    (root / "a.txt").write_text("first file")
    ingest.index_folder(spark, str(root), str(table), str(state)).awaitTermination()
    (root / "b.md").write_text("# second\n\nfile")
    (root / "c.txt").write_text("first file")
    ingest.index_folder(spark, str(root), str(table), str(state)).awaitTermination()
    rows = spark.read.parquet(str(table)).collect()
    assert {r["text"] for r in rows} == {"first file", "# second\n\nfile"} and len({r["batch"] for r in rows}) == 2


def test_a_file_that_never_ends_costs_one_row(spark):
    def endless(data):
        if data == b"hang":
            while True:
                pass
        if data == b"die":
            import os

            os._exit(3)
        return [data.decode()]

    rows = [(i, f"p{i}", "pdf", b"hang" if i in (3, 4) else b"die" if i == 6 else f"page {i}".encode()) for i in range(9)]
    df = spark.createDataFrame(rows, "`my id` long, `a.b` string, kind string, content binary").coalesce(1)
    got = {r["my id"]: (r["a.b"], r["status"], r["text"]) for r in files.extract(df, endless, seconds=1.0).collect()}
    want = {i: (f"p{i}", "timeout" if i in (3, 4) else "failed" if i == 6 else "ok", f"page {i}" if i not in (3, 4, 6) else None) for i in range(9)}
    assert got == want
