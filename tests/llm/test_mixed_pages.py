"""A page that cannot be read leaves the others of its file."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pytest

from lumenfold.llm import tiff

from .test_layout import images


def test_readable_pages_of_a_mixed_file(spark):
    good = tiff.write_tiff(images())
    places, at = [], struct.unpack_from("<I", good, 4)[0]
    while at:
        places.append(at)
        at = struct.unpack_from("<I", good, at + 2 + 12 * struct.unpack_from("<H", good, at)[0])[0]

    def changed(page: int, tag: int, value: int, kind: str = "H") -> bytes:
        data, at = bytearray(good), places[page]
        entry = next(e for e in range(at + 2, at + 2 + 12 * struct.unpack_from("<H", data, at)[0], 12) if struct.unpack_from("<H", data, e)[0] == tag)
        struct.pack_into("<" + kind, data, entry + 8, value)
        return bytes(data)

    files = [(1, 1, changed(0, tiff.BITS, 16)), (2, 2, changed(1, tiff.COMPRESSION, 7)), (3, 3, changed(2, tiff.BITS, 0xFFFFFF00, "I")), (4, 2, changed(1, tiff.ROWS_PER_STRIP, 0))]
    got = tiff.read_pages(spark.createDataFrame([(k, m) for k, _, m in files], "id long, media binary")).select("id", "tiff_page.*").collect()
    for k, bad, media in files:
        rows = {r["page"]: r for r in got if r["id"] == k}
        assert sorted(rows) == [1, 2, 3, 4] and [p for p, r in rows.items() if r["error"]] == [bad]
        assert all(bytes(rows[p]["samples"]) == image.tobytes() for p, image in enumerate(images(), 1) if p != bad)
        with pytest.raises(tiff.TiffError):
            list(tiff.read_tiff(media))


def test_damaged_files_give_error_rows(spark):
    """Files cut short anywhere, and files with any byte altered: rows with an error, never an exception."""
    rng = np.random.default_rng(3)
    page = rng.integers(0, 9, (40, 48), dtype=np.uint8)
    seen = 0
    for compression in (tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE):
        for tile in (None, 16):
            good = tiff.write_tiff([page, page], compression, 2, tile)
            cut = [good[:n] for n in range(0, len(good), 7)]
            altered = []
            for _ in range(400):
                bad = bytearray(good)
                for at in rng.integers(0, len(good), 3):
                    bad[at] = rng.integers(0, 256)
                altered.append(bytes(bad))
            heads = []  # every field of the first directory set to zero, to its largest and to a negative value
            first = int.from_bytes(good[4:8], "little")
            for k in range(int.from_bytes(good[first : first + 2], "little")):
                for value in (b"\0" * 4, b"\xff" * 4, b"\xf0\xff\xff\xff"):
                    bad = bytearray(good)
                    bad[first + 2 + 12 * k + 8 : first + 14 + 12 * k] = value
                    heads.append(bytes(bad))
            for file in cut + altered + heads:
                for p in tiff._pages(file):
                    seen += p["error"] is not None
    assert seen > 1000


def test_a_page_per_row(spark):
    """Pages of stored texts against slices of their payloads."""
    texts = ["", None, "x" * 70, "y\n" * 9000, "long text " * 30_000]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, tiff_page string")
    got = {(r["doc_id"], r["page"]): r for r in tiff.text_pages(docs).collect()}
    want = {}
    for i, t in enumerate(texts):
        payload = tiff.payload_of((t or "").encode())
        step = tiff.ROW * tiff.PAGE_ROWS
        for n, at in enumerate(range(0, len(payload), step), 1):
            part = payload[at : at + step]
            want[i, n] = (tiff.ROW, len(part) // tiff.ROW, hashlib.sha256(part).hexdigest(), None)
    assert {k: (r["width"], r["height"], r["samples_sha256"], r["error"]) for k, r in got.items()} == want
    assert tiff.text_pages(docs.where("false")).count() == 0


def test_files_leave_in_bounded_parts(monkeypatch):
    """Stored texts are not gathered for a whole batch."""
    import pyarrow as pa

    from lumenfold.llm import tiff

    monkeypatch.setattr(tiff, "PAGE_BYTES", 1)
    said = ["abc", None, "", "d" * 5000]
    parts = list(tiff._file_runs(pa.record_batch([pa.array(range(4)), pa.array(said)], names=["doc_id", "text"])))
    assert [p.num_rows for p in parts] == [1] * 4
    assert [(r["doc_id"], r["media"]) for p in parts for r in p.to_pylist()] == [(i, tiff.store_text((t or "").encode())) for i, t in enumerate(said)]
    assert not list(tiff._file_runs(pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.string())], names=["doc_id", "text"])))
