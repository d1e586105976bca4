"""Files as tables: listings, decoded texts, blocks of documents by kind. A broken file is a status, never a failed job."""

from __future__ import annotations

import html as entities
import io
import json
import multiprocessing
import re
import unicodedata
import uuid
import wave
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import paths
from quern.operators.chunking import BLOCKS, Block, paragraph_blocks
from quern.sources import pdf

MOST_CHARS = 2_000_000
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
EXTRACTED = f"status string, text string, title string, page_count int, truncated boolean, blocks {BLOCKS}"


class Unreadable(Exception):
    """Its argument is the status: binary, corrupt, password_protected or no_text."""


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, name, ext, kind, size, mtime_ms, status) of indexable files below root. Contents aren't read. Empty files have nothing to index and aren't listed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    rel = F.regexp_replace(F.col("path"), "^file:/*", "/")
    rows = found.withColumn("rel_path", F.substr(rel, F.char_length(base) + 2)).withColumn("name", F.element_at(F.split("rel_path", "/"), -1)).withColumn("ext", paths.extension(F.col("name")))
    kept = rows.withColumn("kind", paths.kind_of(F.col("ext"))).where("kind is not null").where(~paths.is_excluded_path(F.col("rel_path")))
    return kept.select("path", "rel_path", "name", "ext", "kind", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), F.when(F.col("length") > paths.size_cap(F.col("kind")), "skipped").otherwise("pending").alias("status"))


def directory_size(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def normalise(text: str) -> str:
    text = unicodedata.normalize("NFC", text.removeprefix("﻿"))
    text = re.sub(r"\r\n?", "\n", text)
    return re.sub(r"\n{4,}", "\n\n\n", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", text))


def decode(data: bytes) -> str:
    """By byte order mark, else strict UTF-8, else Windows-1252; a NUL early on is a binary file."""
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return normalise(data[2:].decode(name, "replace"))
    if b"\0" in data[:8192]:
        raise Unreadable("binary")
    try:
        return normalise(data.decode("utf-8"))
    except UnicodeDecodeError:
        return normalise(data.decode("cp1252", "replace"))


def markdown(text: str) -> tuple[list[Block], str | None]:
    """Headings, and paragraphs between blank lines; fenced lines are never either."""
    blocks, title, fenced, begin, at = [], None, False, None, 0

    def close(stop: int) -> None:
        nonlocal begin
        if begin is not None and (body := text[begin:stop].rstrip()):
            blocks.append(Block(begin, begin + len(body)))
        begin = None

    for line in text.split("\n"):
        fenced ^= bool(re.match(r"\s*(```|~~~)", line))
        head = None if fenced else re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", line)
        if head:
            close(at)
            blocks.append(Block(at, at + len(line), len(head[1])))
            if title is None and len(head[1]) == 1:
                title = head[2]
        elif not fenced and not line.strip():
            close(at)
        elif begin is None:
            begin = at
        at += len(line) + 1
    close(len(text))
    return blocks, title


def joined(pieces: Iterator[tuple[str, int | None, int | None]]) -> tuple[str, list[Block], str | None]:
    """Text, blocks and title of (text, heading, page) pieces, parted by blank lines."""
    text, blocks, title = "", [], None
    for piece, heading, page in pieces:
        piece = normalise(piece).strip()
        if piece:
            text += "\n\n" * bool(text)
            blocks.append(Block(len(text), len(text) + len(piece), heading, page))
            text += piece
            title = title or (piece if heading == 1 else None)
    return text, blocks, title


def docx_pieces(data: bytes) -> Iterator[tuple[str, int | None, int | None]]:
    if not data.startswith(b"PK\x03\x04"):
        raise Unreadable("corrupt")
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error) as e:
        raise Unreadable("corrupt") from e

    def said(node) -> str:
        return "".join(t.text or "" if t.tag == f"{W}t" else "\n" if t.tag == f"{W}br" else "\t" if t.tag == f"{W}tab" else "" for t in node.iter())

    for node in body if body is not None else ():
        if node.tag == f"{W}p":
            style = node.find(f"{W}pPr/{W}pStyle")
            level = re.fullmatch(r"Heading ?([1-6])", style.get(f"{W}val", "")) if style is not None else None
            yield said(node), int(level[1]) if level else None, None
        elif node.tag == f"{W}tbl":
            for row in node.iter(f"{W}tr"):
                yield "\t".join(said(c) for c in row.findall(f"{W}tc")), None, None


def html_pieces(page: str) -> Iterator[tuple[str, int | None, int | None]]:
    for m in re.finditer(r"<(h[1-6]|p|li|tr)\b[^>]*>([\s\S]*?)</\1>", page):
        inner = re.sub(r"</t[dh]>\s*<t[dh][^>]*>", "\t", m[2]) if m[1] == "tr" else m[2]
        yield entities.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", "\n", inner))), int(m[1][1]) if m[1][0] == "h" else None, None


def reflow(text: str) -> str:
    text = re.sub(r"(\w)-\n(\w)", r"\1\2", re.sub(r"[ \t]+\n", "\n", text))
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"([^\n.!?:;])\n(?=[a-z0-9(])", r"\1 ", text))


def _streams(data: bytes) -> Iterator[str]:
    """Texts of a file without a tree of pages: each stream, plain or deflated, is one, with literal strings."""
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = zlib.decompress(m[2]) if b"/FlateDecode" in m[1] else m[2]
        lines = []
        for block in re.findall(rb"BT(.*?)ET", body, re.S):
            for piece in re.finditer(rb"\[(.*?)\]\s*TJ|(\((?:[^()\\]|\\.)*\))\s*(?:Tj|')|(T\*|Td|TD)", block, re.S):
                if piece[3]:
                    lines.append("\n")
                    continue
                for s in re.findall(rb"\(((?:[^()\\]|\\.)*)\)", piece[1] or piece[2], re.S):
                    lines.append(re.sub(rb"\\(.)", rb"\1", s).decode("cp1252", "replace"))
        yield "".join(lines)


def pdf_pages(data: bytes) -> list[str]:
    """Texts of a PDF's pages, "" for those without any. pdf.py says what is read; pass another reader for more."""
    if not data.startswith(b"%PDF") or b"%%EOF" not in data[-2048:]:
        raise Unreadable("corrupt")
    try:
        pages = pdf.page_texts(data) or [t for t in _streams(data) if t.strip()]
    except pdf.Locked as e:
        raise Unreadable("password_protected") from e
    except (zlib.error, ValueError) as e:
        raise Unreadable("corrupt") from e
    pages = [reflow(normalise(text)).strip() for text in pages]
    if not any(pages):
        raise Unreadable("no_text")
    return pages


def _nothing(status: str) -> dict:
    return {"status": status, "text": None, "title": None, "page_count": None, "truncated": False, "blocks": None}


def extracted(data: bytes, kind: str, pdf_reader=pdf_pages) -> dict:
    """The row of one file: status ok or why not, text, title, page_count, truncated, blocks."""
    try:
        title, count = None, None
        if kind == "pdf":
            pages = pdf_reader(data)
            count, text, blocks = len(pages), "", []
            for n, page in enumerate(pages, 1):
                if page:
                    text += "\n\n" * bool(text)
                    blocks += paragraph_blocks(page, n, len(text))
                    text += page
        elif kind == "docx":
            text, blocks, title = joined(docx_pieces(data))
            if not text:
                raise Unreadable("no_text")
        else:
            text = decode(data)
            blocks, title = markdown(text) if kind == "markdown" else (paragraph_blocks(text), None)
    except Unreadable as e:
        return _nothing(e.args[0])
    except Exception:  # any reader's own errors are a status too
        return _nothing("failed")
    kept = [b._replace(stop=min(b.stop, MOST_CHARS))._asdict() for b in blocks if b.start < MOST_CHARS]
    return {"status": "ok", "text": text[:MOST_CHARS], "title": title, "page_count": count, "truncated": len(text) > MOST_CHARS, "blocks": kept}


class Reader:
    """A child process that reads one file after the other, and is killed and made anew when one takes longer than `seconds`."""

    def __init__(self, seconds: float, pdf_reader) -> None:
        self.seconds, self.pdf_reader, self.child = seconds, pdf_reader, None

    def _serve(self, pipe) -> None:
        while True:
            try:
                data, kind = pipe.recv()
            except EOFError:
                return
            pipe.send(extracted(data, kind, self.pdf_reader))

    def read(self, data: bytes, kind: str) -> dict:
        """extracted() of the file, or a row with the status timeout, or failed if the child died of it."""
        if self.child is None:
            context = multiprocessing.get_context("fork")
            self.pipe, other = context.Pipe()
            self.child = context.Process(target=self._serve, args=(other,), daemon=True)
            self.child.start()
            other.close()
        try:
            self.pipe.send((data, kind))
            if self.pipe.poll(self.seconds):
                return self.pipe.recv()
            status = "timeout"
        except (EOFError, OSError):
            status = "failed"
        self.close()
        return _nothing(status)

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None


def extract(files: DataFrame, pdf_reader=pdf_pages, seconds: float | None = None) -> DataFrame:
    """files (path, kind, content) with the columns of EXTRACTED for the content; each row is on its own.

    With `seconds`, a file that takes longer has the status timeout, and the others of its batch go on: each task reads in a child process of its own.
    Columns may have any names; one that an extracted column would clash with goes.
    """
    made_here = [c.split()[0] for c in EXTRACTED.split(", ")]
    keys = [c for c in files.columns if c != "content" and c not in made_here]
    own = [f"`{c.replace('`', '``')}`" for c in keys]
    rows = files.select(F.struct(*own).alias("row"), "kind", "content")
    inner = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("heading", pa.int32()), ("page", pa.int32())])
    kinds = {"status": pa.string(), "text": pa.string(), "title": pa.string(), "page_count": pa.int32(), "truncated": pa.bool_(), "blocks": pa.list_(inner)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(seconds, pdf_reader) if seconds else None
        read = reader.read if reader else lambda data, kind: extracted(data, kind, pdf_reader)
        try:
            for batch in batches:
                made = [read(c or b"", k) for c, k in zip(batch.column("content").to_pylist(), batch.column("kind").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array([m[n] for m in made], t) for n, t in kinds.items())], ["row", *kinds])
        finally:
            if reader:
                reader.close()

    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(EXTRACTED).fields])
    return rows.mapInArrow(run, schema).select(*(F.col("row").getField(c).alias(c) for c in keys), *kinds)


def wav_samples(data: bytes) -> np.ndarray:
    """Samples of 16-bit mono audio, from -1 to 1."""
    with wave.open(io.BytesIO(data)) as w:
        if w.getsampwidth() != 2 or w.getnchannels() != 1:
            raise Unreadable("unsupported")
        return np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768


def wav_frames(files: DataFrame, size: int = 1600) -> DataFrame:
    """(path, seq, samples) of audio files (path, content): frames of `size` samples, the last one filled up with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                samples = wav_samples(data)
                frames = np.pad(samples, (0, -len(samples) % size)).reshape(-1, size)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(frames)), pa.array(range(len(frames)), pa.int64()), pa.array(frames.tolist(), pa.list_(pa.float32()))], ["path", "seq", "samples"])

    return files.select("path", "content").mapInArrow(run, "path string, seq long, samples array<float>")


def level(samples):
    """Root mean square of a frame."""
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(samples))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Well-formed records of a JSON lines file; the others are dropped."""
    lines = spark.read.text(path).select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return lines.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def folder_list(spark: SparkSession, path: str) -> DataFrame:
    """Paths of a JSON document {"folders": [...]}; what isn't text is left out, a damaged file is empty."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "folders array<string>").alias("d"), F.from_json("value", "folders array<variant>").alias("v"))
    typed = F.filter("v.folders", lambda x: F.schema_of_variant(x) == "STRING")
    return rows.select(F.explode(F.transform(typed, lambda x: x.cast("string"))).alias("path"))


def write_folder_list(spark: SparkSession, path: str, folders: list[str], paused: bool = False) -> None:
    """The document that folder_list() reads, put in place by renaming: a reader sees the old one or the new one, whole."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, part = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.tmp"))
    system = at.getFileSystem(conf)
    out = system.create(part, True)
    try:
        out.write(json.dumps({"version": 1, "folders": folders, "paused": paused}, indent=2).encode())
    finally:
        out.close()
    kind = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    replace = spark.sparkContext._gateway.new_array(kind, 1)
    replace[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf).rename(part, at, replace)
