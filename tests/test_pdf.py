"""PDF files as writers make them: objects packed in streams, page trees, font maps, forms, updates."""

import random
import zlib

import pytest

from quern.sources import files, pdf


def stream(facts, body, packed=True):
    body = zlib.compress(body) if packed else body
    return b"<<%s /Length %d%s>>\nstream\n%s\nendstream" % (facts, len(body), b" /Filter /FlateDecode" if packed else b"", body)


def written(objects, trailer=b"/Root 1 0 R", before=b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"):
    """A file of objects by number, with a plain trailer."""
    return before + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items()) + b"trailer <<%s>>\nstartxref\n0\n%%%%EOF\n" % trailer


def packed(objects, streams):
    """The same with all objects but streams in an object stream, and a cross-reference stream for a trailer."""
    heads, body = [], b""
    for n, o in objects.items():
        heads.append(b"%d %d" % (n, len(body)))
        body += o + b"\n"
    head = b" ".join(heads) + b"\n"
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in streams.items())
    out += b"90 0 obj\n" + stream(b"/Type /ObjStm /N %d /First %d" % (len(objects), len(head)), head + body) + b"\nendobj\n"
    return out + b"91 0 obj\n" + stream(b"/Type /XRef /Root 1 0 R /Size 92 /W [1 2 1]", bytes(random.Random(1).randbytes(40))) + b"\nendobj\nstartxref\n9\n%%EOF"


FONT = b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding>>"


def tree(n_pages, resources=b"<</Font <</F1 5 0 R>>>>"):
    kids = b" ".join(b"%d 0 R" % (10 + i) for i in range(n_pages))
    pages = {10 + i: b"<</Type /Page /Parent 2 0 R /Contents %d 0 R>>" % (40 + i) for i in range(n_pages)}
    return {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Count %d /Kids [%s] /Resources %s>>" % (n_pages, kids, resources), 5: FONT} | pages


@pytest.mark.parametrize("write", [lambda o, s: written(o | s), packed])
def test_pages_in_the_order_of_their_tree(write):
    texts = [b"First \\(page\\)", b"", b"caf\\351 3"]
    streams = {40 + i: stream(b"", b"BT /F1 12 Tf 72 700 Td (%s) Tj ET" % t if t else b"q Q") for i, t in enumerate(texts)}
    data = write(tree(3), dict(reversed(streams.items())))
    assert pdf.page_texts(data) == ["First (page)", "", "café 3"]
    got = files.extracted(data, "pdf")
    assert (got["status"], got["page_count"], got["text"]) == ("ok", 3, "First (page)\n\ncafé 3")
    assert [b["page"] for b in got["blocks"]] == [1, 3]


def test_lines_spaces_and_strings():
    content = b"""BT /F1 10 Tf 14 TL 1 0 0 1 72 700 Tm (One) Tj 40 0 Td (two) Tj T* (three (nested) \\101\\
B) Tj 0 -14 TD [(spl) -20 (it) -300 (gap)] TJ (next) ' <41 42 4> Tj ET % comment (no)
BI /W 2 /H 1 ID \x00(\xff\x01 EI BT /F1 10 Tf 1 0 0 1 72 500 Tm (after) Tj ET"""
    data = written(tree(1) | {40: stream(b"", content)})
    assert pdf.page_texts(data) == ["One two\nthree (nested) AB\nsplit gap\nnextAB@\nafter"]


def test_font_maps_and_differences():
    cmap = b"""/CIDInit begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange
2 beginbfchar <0003> <0020> <0041> <00660069> endbfchar 2 beginbfrange <0010> <0019> <0030> <0020> <0021> [<4E2D> <D83DDE00>] endbfrange endcmap"""
    fonts = b"<</Font <</F1 5 0 R /F2 6 0 R /F3 8 0 R>>>>"
    more = {
        6: b"<</Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 7 0 R>>",
        7: stream(b"", cmap),
        8: b"<</Type /Font /Subtype /Type1 /Encoding <</BaseEncoding /MacRomanEncoding /Differences [1 /fi /eacute /uni4E2D 10 /two /quoteright /A.alt /nosuch]>>>>",
    }
    content = b"BT /F2 9 Tf <0041000300110012000300200021> Tj /F3 9 Tf (\\001\\002\\003 \\012\\013\\014\\015 \\216) Tj ET"
    assert pdf.page_texts(written(tree(1, fonts) | more | {40: stream(b"", content)})) == ["fi 12 中😀ﬁé中 2’A é"]


def test_forms_nested_trees_and_loops():
    objects = {
        1: b"<</Type/Catalog/Pages 2 0 R>>",
        2: b"<</Kids[3 0 R 4 0 R 2 0 R]/Type/Pages/Resources<</Font<</F1 5 0 R>>/XObject<</X 7 0 R>>>>>>",
        3: b"<</Kids[10 0 R]/Type/Pages/Parent 2 0 R>>", 4: b"<</Type/Page/Contents[41 0 R 42 0 R]>>", 5: FONT,
        7: stream(b"/Type/XObject/Subtype/Form", b"BT /F1 9 Tf 0 3 Td (in a form) Tj ET /X Do"), 10: b"<</Type/Page/Contents 40 0 R>>",
        40: stream(b"", b"/X Do"), 41: stream(b"", b"BT /F1 9 Tf 0 50 Td (a"), 42: stream(b"", b"b) Tj ET", packed=False),
    }
    first, second = pdf.page_texts(written(objects))
    assert first == "in a form" and second == "a\nb"


def test_later_objects_count_and_streams_hide_theirs():
    inner = b"stream of another file: 40 0 obj (wrong) endobj"
    data = written(tree(1) | {40: stream(b"", b"BT /F1 9 Tf (old) Tj ET"), 60: stream(b"/Type /EmbeddedFile", inner, packed=False)})
    assert pdf.page_texts(data) == ["old"]
    data += written({40: stream(b"", b"BT /F1 9 Tf (new) Tj ET")}, before=b"")
    assert pdf.page_texts(data) == ["new"]
    wrong = data.replace(b"/Length ", b"/Length 9")
    assert pdf.page_texts(wrong) == ["new"]


def test_filters_and_lengths_elsewhere():
    import base64

    text = b"BT /F1 9 Tf (five and hex) Tj ET"
    body = base64.a85encode(zlib.compress(text)) + b"~>"
    objects = tree(2) | {40: b"<</Length 50 0 R /Filter [/ASCII85Decode /FlateDecode]>> stream\r\n" + body + b"\r\nendstream", 50: b"%d" % len(body)}
    objects |= {41: stream(b"/Filter /AHx", text.hex().encode() + b">", packed=False)}
    assert pdf.page_texts(written(objects)) == ["five and hex"] * 2


def test_states_of_files():
    good = written(tree(1) | {40: stream(b"", b"BT /F1 9 Tf (text) Tj ET")})
    status = lambda data: files.extracted(data, "pdf")["status"]
    assert status(good) == "ok"
    assert status(written(tree(1) | {40: stream(b"", b"q Q")})) == "no_text"
    assert status(written(tree(1) | {40: stream(b"", b"x")}, b"/Root 1 0 R /Encrypt 9 0 R")) == "password_protected"
    assert status(packed(tree(1), {40: stream(b"", b"x")}).replace(b"/Type /XRef", b"/Type /XRef /Encrypt 9 0 R")) == "password_protected"
    assert status(good[:60]) == status(b"") == status(b"%PDF-1.7 %%EOF"[1:]) == "corrupt"
    assert status(written(tree(1) | {40: stream(b"", b"x").replace(b"x\x9c", b"zz")})) in ("corrupt", "no_text")


def test_any_damage_is_a_status():
    rng = random.Random(5)
    good = packed(tree(3), {40 + i: stream(b"", b"BT /F1 9 Tf (some text here) Tj ET") for i in range(3)})
    for _ in range(300):
        data = bytearray(good)
        for _ in range(rng.randint(1, 12)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        got = files.extracted(bytes(data), "pdf")
        assert got["status"] in ("ok", "no_text", "corrupt", "password_protected", "failed") and (got["status"] == "ok") == (got["text"] is not None)


def test_files_as_rows(spark):
    rows = [(f"{i}.pdf", "pdf", bytearray(packed(tree(2), {40 + j: stream(b"", b"BT /F1 9 Tf (file %d page %d) Tj ET" % (i, j)) for j in range(2)}))) for i in range(6)]
    got = files.extract(spark.createDataFrame(rows, "path string, kind string, content binary")).collect()
    assert {r["path"]: (r["page_count"], r["text"]) for r in got} == {f"{i}.pdf": (2, f"file {i} page 0\n\nfile {i} page 1") for i in range(6)}
