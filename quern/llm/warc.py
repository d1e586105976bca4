"""WARC archives from pages: monolithic gzip, normalised to one member a record with a sidecar offset index.

Tasks write their pages as records into whole-file gzip streams of a bounded size (the form in which archives often
come). The normaliser inflates each stream once, front to back, rewrites every record as a gzip member of its own and
writes the offsets beside it. Readers then seek to members. Files go to a shared folder by Arrow's file systems, each
task's under names of its own, and only files that a finished task has reported are read: a task that is run
again can't be mixed up with its first run, whose files are removed at the end.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import column, cut, hold, shared_folder, small, table, tidy

#: Bytes of blocks after which an archive is closed; one record may be longer.
ROLL = 64 << 20
#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 100
READ = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "path string, index string, records long"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _name(page: str | None) -> str:
    """The id of a page's record: any text, white space and brackets too."""
    return "<urn:x-page>" if page is None else f"<urn:x-page:{quote(page, safe='')}>"


def _page(name: str | None) -> str | None:
    return unquote(name[len("<urn:x-page:") : -1]) if name and name != "<urn:x-page>" else None


def _head(row: dict, date: str) -> tuple[bytes, bytes]:
    """WARC header and block."""
    payload = (row["html"] or "").encode()
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in row["url"] or "urn:none")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_name(row['page_id'])}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{row['digest']}", f"X-Payload-Length: {len(payload)}"]
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(row['refers_to'])}"]
        block = b""
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n", block


def _written(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    out, packer, name, size, records = None, None, "", 0, 0
    done = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
            if out is None:
                name, size, records = f"{root}/whole-{uuid.uuid4().hex}.warc.gz", 0, 0
                out, packer = store.open_output_stream(name, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
            head, block = _head(row, date)
            out.write(packer.compress(head + block + b"\r\n\r\n"))
            size, records = size + len(block), records + 1
            if size >= ROLL:
                out.write(packer.flush())
                out.close()
                out = None
                done.append((name, "", records))
    if out is not None:
        out.write(packer.flush())
        out.close()
        done.append((name, "", records))
    yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))], ["path", "index", "records"])


def _inflated(stream: pa.NativeFile) -> Iterator[bytes]:
    """The stream's bytes; further gzip members may follow the first."""
    tool = zlib.decompressobj(31)
    while data := stream.read(READ):
        while data:
            yield tool.decompress(data)
            data = tool.unused_data
            if tool.eof:
                tool = zlib.decompressobj(31)


def records(stream: pa.NativeFile) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of a WARC stream; memory holds one record."""
    pieces, have = _inflated(stream), bytearray()

    def fill(n: int) -> bool:
        nonlocal have
        while len(have) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            have += piece
        return True

    while fill(1):
        at = 0
        while (end := have.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(have) - 3)
            if not fill(len(have) + 1):
                raise ValueError("a record's header has no end")
        head = bytes(have[: end + 4])
        length = int(fields(head)["Content-Length"])
        if not fill(end + 8 + length):
            raise ValueError("a record's block is cut short")
        yield head, bytes(have[end + 4 : end + 4 + length])
        del have[: end + 8 + length]


def fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def _normalised(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    for batch in batches:
        for path in batch.column("path").to_pylist():
            name = f"{root}/members-{uuid.uuid4().hex}.warc.gz"
            offset, n = 0, 0
            with store.open_input_stream(path, compression=None) as whole, store.open_output_stream(name, compression=None) as out, store.open_output_stream(f"{name}.idx", compression=None) as index:
                for head, block in records(whole):
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(head + block + b"\r\n\r\n") + packer.flush()
                    out.write(member)
                    known = fields(head)
                    index.write((json.dumps({"offset": offset, "length": len(member), "id": known["WARC-Record-ID"], "type": known["WARC-Type"]}) + "\n").encode())
                    offset, n = offset + len(member), n + 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f"{name}.idx"]), pa.array([n])], ["path", "index", "records"])


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, _ = _store(folder)
    for batch in batches:
        for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
            rows = []
            with store.open_input_file(path) as archive, store.open_input_stream(index, compression=None) as lines:
                rest = b""
                while rest or (rest := lines.read(READ)):
                    more = lines.read(READ)
                    *whole, rest = (rest + more).split(b"\n") if more else [*rest.split(b"\n")[:-1], b""]
                    for line in whole:
                        entry = json.loads(line)
                        archive.seek(entry["offset"])
                        record = zlib.decompress(archive.read(entry["length"]), 31)
                        end = record.index(b"\r\n\r\n") + 4
                        known = fields(record[:end])
                        block = record[end : end + int(known["Content-Length"])]
                        digest, n = known["WARC-Payload-Digest"].removeprefix("sha256:"), int(known["X-Payload-Length"])
                        html = None
                        if known["WARC-Type"] == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{path} at {entry['offset']}: payload and digest differ")
                            html = payload.decode()
                        rows.append((_page(known["WARC-Record-ID"]), known["WARC-Target-URI"], n, digest, known["WARC-Type"], _page(known.get("WARC-Refers-To")), html))
                        if len(rows) == 500:
                            yield _rows(rows)
                            rows = []
            if rows:
                yield _rows(rows)


READ_AS = (("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("html", pa.string()))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(READ_AS)], [n for n, _ in READ_AS])


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, record_type, refers_to). Pages themselves aren't shuffled unless very many payloads repeat."""
    html = F.coalesce(column(html_col), F.lit(""))
    rows = pages.select(column(id_col).alias("page_id"), column(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    several = rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(small(cut(several)), "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes archives below folder; (path, index, records) of each. The whole-file streams are removed at the end.

    Null html is an empty payload, null url "urn:none". Of equal payloads of REVISIT_BYTES or more the rows with the
    smallest id are responses (all of them if that id repeats); a null id is a revisit of a known one. An empty
    table writes no archive.
    """
    rows = planned(pages, id_col, url_col, html_col).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    whole = cut(rows.mapInArrow(partial(_written, folder=f"{folder}/whole", date=date), FILES))
    done = cut(whole.repartition(max(1, whole.count())).mapInArrow(partial(_normalised, folder=f"{folder}/members"), FILES))
    store, root = _store(folder)
    if store.get_file_info(f"{root}/whole").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/whole")
    # what tasks that broke off have left: names of archives, of which there are few
    reported = {name for row in done.select("path", "index").toLocalIterator() for name in row}
    for left in store.get_file_info(fs.FileSelector(f"{root}/members", allow_not_found=True)):
        if left.path not in reported:
            store.delete_file(left.path)
    return done


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Rows of all records: ids and urls as text, payload size and digest, record_type, refers_to and html (null for revisits)."""
    kinds = {pa.string(): "string", pa.int64(): "long"}
    return archives.repartition(max(1, archives.count())).mapInArrow(partial(_read, folder=folder), ", ".join(f"{n} {kinds[t]}" for n, t in READ_AS))


@tidy
def op7_warc(spark, sf_dir: str) -> DataFrame:
    """write() of all pages and read() of the archives, which are removed then; the cases are those of write()."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    folder = hold(shared_folder(spark))
    found = read(write(pages, folder), folder)
    return cut(found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""
