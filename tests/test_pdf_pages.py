"""Files written here, by two layouts, and read back as pages; damaged files give error rows."""

from __future__ import annotations

import random
import zlib

import pytest

from lumenfold.sources.pdf_pages import read_column, read_pages


def literal(text: str) -> bytes:
    raw = text.encode("cp1252")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def stream(body: bytes, extra: bytes = b"", packed: bool = True) -> bytes:
    if packed:
        body, extra = zlib.compress(body), extra + b"/Filter /FlateDecode"
    return b"<</Length %d %s>>\nstream\n%s\nendstream" % (len(body), extra, body)


def shown(lines: list[str], wide: bool) -> bytes:
    """A content stream with a line of text per line."""
    out = b"BT /F1 12 Tf 14 TL 72 720 Td\n"
    for k, line in enumerate(lines):
        if wide:
            out += b"<" + "".join(f"{ord(c):04x}" for c in line).encode() + b"> Tj T*\n"
        elif k % 3 == 0:
            out += literal(line) + b" Tj 0 -14 Td\n"
        elif k % 3 == 1:
            words = line.split(" ")
            out += b"[" + b" -300 ".join(literal(w) for w in words) + b"] TJ T*\n"
        else:
            out += b"1 0 0 1 72 %d Tm " % (700 - k) + literal(line) + b" Tj\n 0 -14 Td"
    return out + b"ET"


UNICODE = b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange\n2 beginbfrange <0000> <D7FF> <0000> <E000> <FFFF> <E000> endbfrange endcmap"


def objects(pages: list[list[str]], wide: bool) -> dict[int, bytes]:
    kids = [10 + 2 * k for k in range(len(pages))]
    out = {
        1: b"<</Type /Catalog /Pages 2 0 R>>",
        2: b"<</Type /Pages /Count %d /Resources <</Font <</F1 3 0 R>> >> /Kids [4 0 R]>>" % len(pages),
        3: b"<</Type /Font /Subtype /Type0 /ToUnicode 5 0 R>>" if wide else b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica>>",
        4: b"<</Type /Pages /Parent 2 0 R /Kids [" + b" ".join(b"%d 0 R" % k for k in kids) + b"]>>",
        5: stream(UNICODE),
    }
    for k, lines in zip(kids, pages, strict=True):
        out[k] = b"<</Type /Page /Parent 4 0 R /Contents [%d 0 R]>>" % (k + 1)
        out[k + 1] = stream(shown(lines, wide), packed=k % 4 == 0)
    return out


def classic(pages: list[list[str]], wide: bool = False) -> bytes:
    out, places = b"%PDF-1.4\n%\xe2\xe3\n", {}
    for n, body in objects(pages, wide).items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n"
    for n, place in places.items():
        out += b"%d 1\n%010d 00000 n \n" % (n, place)
    return out + b"trailer\n<</Size 999 /Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % at


def packed(pages: list[list[str]], wide: bool = False) -> bytes:
    """Objects without streams lie in one object stream; references are a stream with a predictor."""
    every, out, rows = objects(pages, wide), b"%PDF-1.5\n", {}
    plain = [n for n, b in every.items() if b"endstream" not in b]
    for n in every.keys() - set(plain):
        rows[n] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, every[n])
    body, heads = b"", b""
    for k, n in enumerate(plain):
        heads += b"%d %d " % (n, len(body))
        body += every[n] + b" "
        rows[n] = (2, 900, k)
    rows[900] = (1, len(out), 0)
    out += b"900 0 obj\n" + stream(heads + body, b"/Type /ObjStm /N %d /First %d " % (len(plain), len(heads))) + b"\nendobj\n"
    numbers, above, lines = sorted(rows), bytes(7), b""
    for n in numbers:
        kind, a, b = rows[n]
        line = bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big")
        lines += b"\2" + bytes((x - y) & 255 for x, y in zip(line, above, strict=True))
        above = line
    index = b" ".join(b"%d 1" % n for n in numbers)
    at = len(out)
    head = b"/Type /XRef /Size 999 /Root 1 0 R /W [1 4 2] /Index [%s] /DecodeParms <</Predictor 12 /Columns 7>> " % index
    return out + b"901 0 obj\n" + stream(lines, head) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % at


@pytest.mark.parametrize("write", [classic, packed])
def test_documents_become_pages(spark, write):
    """Every document as a file of its lines, forty a page."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    files, want = [], {}
    for r in docs:
        lines = [" ".join(x.split()) for x in (r["text"] or "").split("\n")]
        lines = [x for x in lines if x]
        pages = [lines[k : k + 40] for k in range(0, len(lines), 40)] or [[]]
        wide = any(ord(c) > 255 or 127 <= ord(c) < 160 for x in lines for c in x)
        lines_ok = all(ord(c) < 0xD800 for x in lines for c in x)
        assert lines_ok
        files.append((f"/f/{r['doc_id']}.pdf", str(r["doc_id"]), bytearray(write(pages, wide))))
        want |= {(str(r["doc_id"]), n): ("\n".join(p), len(pages)) for n, p in enumerate(pages, 1)}
    got = read_column(spark.createDataFrame(files, "path string, source_id string, content binary").repartition(4)).collect()
    assert {(r["source_id"], r["page"]): (r["text"], r["pages"]) for r in got} == want and all(r["error"] is None for r in got)


def test_faults_are_rows(spark):
    good = classic([["one (1) \\ two", "three four"], [], ["five"]])
    assert [p[:3] for p in read_pages(good)] == [(1, 3, "one (1) \\ two\nthree four"), (2, 3, ""), (3, 3, "five")]
    lost = good.replace(b"startxref", b"startnone")
    assert list(read_pages(lost)) == list(read_pages(good))
    hidden = packed([["in", "streams"]]).replace(b"startxref", b"startnone")
    assert [p[2] for p in read_pages(hidden)] == ["in\nstreams"]
    assert [p[:2] for p in read_pages(b"")] == [(0, 0)] and [p[0] for p in read_pages(b"no pdf at all")] == [0]
    locked = good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")
    assert "encrypted" in next(read_pages(locked))[3]
    at = good.index(b"stream\n", good.index(b"11 0 obj")) + 7
    broken = list(read_pages(good[: at + 2] + b"\xff\xff\xff" + good[at + 5 :]))
    assert [bool(p[3]) for p in broken].count(True) <= 1 and broken[-1][2] == "five"
    got = read_column(spark.createDataFrame([("p", "s", None), ("q", "t", bytearray(good))], "path string, source_id string, content binary")).collect()
    assert sorted((r["source_id"], r["page"], r["error"] is None) for r in got) == [("s", 0, False), ("t", 1, True), ("t", 2, True), ("t", 3, True)]


def test_a_folder_and_its_summary(spark, tmp_path):
    from lumenfold.operators import corpus
    from lumenfold.sources import readers
    from lumenfold.sources.pdf_pages import pdf_pages

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(classic([["alpha beta"], [], ["gamma"]]))
    (tmp_path / "b.pdf").write_bytes(packed([["delta"]]))
    (tmp_path / "c.pdf").write_bytes(b"broken")
    (tmp_path / "d.txt").write_bytes(b"not read")
    pages = pdf_pages(spark, str(tmp_path))
    assert sorted((r["source_id"], r["page"]) for r in pages.collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 0)]
    plain = readers.pages_of(spark, str(tmp_path))
    assert sorted(tuple(r) for r in plain.collect()) == [("a", 1, "alpha beta"), ("a", 3, "gamma"), ("b", 1, "delta")]
    records = corpus.records_of(plain)
    got = {r["source_id"]: tuple(r)[1:] for r in corpus.page_summary(pages, records).collect()}
    assert got == {"a": (3, 2, 15, 0), "b": (1, 1, 5, 0), "c": (0, 0, 0, 1)}


def test_damage_of_any_kind_ends_in_rows():
    rng = random.Random(1)
    for write in (classic, packed):
        data = write([["some text here", "and more"], ["page two"]])
        for _ in range(300):
            raw = bytearray(data)
            for _ in range(rng.randrange(1, 6)):
                raw[rng.randrange(len(raw))] = rng.randrange(256)
            found = list(read_pages(bytes(raw[: rng.randrange(1, len(raw) + 1)])))
            assert found and all((p[2] is None) != (p[3] is None) for p in found)
