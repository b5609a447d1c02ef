"""TIFF media columns: encode, walk directories, decode, one row per page.

The reader follows the chain of image directories of a file in either byte
order and decodes 8-bit strips and tiles that are stored plain, with PackBits,
LZW or deflate, with or without horizontal differencing. The writer makes such
files from arrays of samples.

Defined results of ``read_pages``: a null file gives no rows; a file that is
no TIFF, is cut short, or uses what is not supported gives its readable pages
and then one row with ``error`` set. A directory chain that loops ends there.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import fresh

# Fixed values of the format: tags, field types and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
OLD_DEFLATE = 32946
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}

#: Samples in a row of a stored text; rows of a strip; rows of a page.
ROW, STRIP_ROWS, PAGE_ROWS, TILE = 64, 128, 1024, 64
#: Pages leave a task together up to so many bytes.
PAGE_BYTES = 1 << 20


#: No supported coding makes more bytes of one.
MOST_RATIO = 4096


class TiffError(ValueError):
    pass


def packbits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as (1 - length, byte), the rest as literals of up to 128."""
    if not data:
        return b""
    values = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(values)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(values)]])
    out, literal = bytearray(), 0

    def flush(a: int, b: int) -> None:
        for i in range(a, b, 128):
            part = data[i : min(b, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    long_runs = ends - starts >= 3
    for a, b in zip(starts[long_runs].tolist(), ends[long_runs].tolist(), strict=True):
        flush(literal, a)
        for i in range(a, b, 128):
            n = min(b, i + 128) - i
            out += bytes([257 - n, data[i]]) if n > 1 else bytes([0, data[i]])
        literal = b
    flush(literal, len(data))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    parts, at, made = [], 0, 0
    while at < len(data) and made < size:
        head = data[at]
        if head < 128:
            part = data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            part = data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            part = b""
            at += 1
        parts.append(part)
        made += len(part)
    return b"".join(parts)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; widths grow one code early."""
    bits, n_bits, out = 0, 0, bytearray()
    table: dict[bytes, int] = {}

    def put(code: int, width: int) -> None:
        nonlocal bits, n_bits
        bits, n_bits = bits << width | code, n_bits + width
        while n_bits >= 8:
            n_bits -= 8
            out.append(bits >> n_bits & 255)
        bits &= (1 << n_bits) - 1

    def fresh() -> None:
        table.clear()
        table.update((bytes([i]), i) for i in range(256))

    fresh()
    put(256, 9)
    size, width, prefix = 258, 9, b""
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix], width)
        table[longer] = size
        size += 1
        prefix = data[i : i + 1]
        if size == 4094:
            put(256, 12)
            fresh()
            size, width = 258, 9
        elif size + 1 > 1 << width:
            width += 1
    if prefix:
        put(table[prefix], width)
        size += 1
        width = min(12, width + (size + 1 > 1 << width))
    put(257, width)
    if n_bits:
        out.append(bits << (8 - n_bits) & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    singles = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, before, out, made = list(singles), 9, b"", [], 0
    bits = n_bits = at = 0
    while made < size:
        while n_bits < width:
            if at >= len(data):
                return b"".join(out)
            bits, n_bits, at = (bits << 8 | data[at]) & 0xFFFFFFFF, n_bits + 8, at + 1
        n_bits -= width
        code = bits >> n_bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = list(singles), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise TiffError("LZW code out of range")
        if before:
            table.append(before + entry[:1])
        out.append(entry)
        made += len(entry)
        before = entry
        if len(table) + 2 > 1 << width and width < 12:
            width += 1
    return b"".join(out)


_ENCODE = {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda d: zlib.compress(d, 1)}


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpackbits(data, size)
    if compression == LZW:
        return unlzw(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    raise TiffError(f"compression {compression} is not supported")


@dataclass
class Page:
    """samples: height x width x samples per pixel, 8 bits each."""

    samples: np.ndarray
    compression: int
    predictor: int
    tiled: bool


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int | None = None, rows: int = STRIP_ROWS, order: str = "<") -> bytes:
    """A file with a directory for each page (height x width, or x samples)."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 0))
    link = 4
    for page in pages:
        image = page if page.ndim == 3 else page[:, :, None]
        height, width, depth = image.shape
        blocks = []
        if tile:
            padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile, depth), np.uint8)
            padded[:height, :width] = image
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            blocks = [image[y : y + rows] for y in range(0, height, rows)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
            stored = _ENCODE[compression](np.ascontiguousarray(block).tobytes())
            offsets.append(len(out))
            counts.append(len(stored))
            out += stored
        fields = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8] * depth), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if depth == 3 else 1]), SAMPLES: (3, [depth]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        fields |= {TILE_WIDTH: (4, [tile]), TILE_HEIGHT: (4, [tile]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, counts)} if tile else {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [rows]), STRIP_COUNTS: (4, counts)}
        entries = []
        for tag, (kind, values) in sorted(fields.items()):
            raw = struct.pack(f"{order}{len(values)}{_CODES[kind]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                at, raw = len(out), raw
                out += raw
                raw = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def read_tiff(data: bytes) -> Iterator[Page]:
    """The file's pages in the order of its directories; the first that cannot be read raises."""
    for page in _walk(data):
        if isinstance(page, TiffError):
            raise page
        yield page


def _walk(data: bytes) -> Iterator[Page | TiffError]:
    """For each directory its page, or the error of that page; an error of the chain itself comes last."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if order is None:
        yield TiffError("not a TIFF file")
        return
    broken = False
    try:
        at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
        while at and at not in seen:
            seen.add(at)
            n = struct.unpack_from(order + "H", data, at)[0]
            page = _read_page(data, order, at, n)
            broken = isinstance(page, TiffError)
            yield page
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
            broken = False
    except struct.error as e:
        if not broken:  # else the directory's own error says so
            yield TiffError(f"cut short: {e}")


def _read_page(data: bytes, order: str, at: int, n: int) -> Page | TiffError:
    try:
        return _page(data, order, dict(_field(data, order, at + 2 + 12 * i) for i in range(n)))
    except TiffError as e:
        return e
    except (struct.error, LookupError, ArithmeticError, TypeError, ValueError) as e:  # fields that contradict each other
        return TiffError(f"damaged page: {e}")


def _field(data: bytes, order: str, at: int) -> tuple[int, list[int]]:
    tag, kind, n = struct.unpack_from(order + "HHI", data, at)
    if kind not in _CODES:
        return tag, []
    size = _SIZES[kind] * n
    start = at + 8 if size <= 4 else struct.unpack_from(order + "I", data, at + 8)[0]
    return tag, list(struct.unpack_from(f"{order}{n}{_CODES[kind]}", data, start))


def _page(data: bytes, order: str, tags: dict[int, list[int]]) -> Page:
    one = lambda tag, default=None: (tags.get(tag) or [default])[0]
    width, height, depth = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if not width or not height or min(width, height) < 1 or width * height * depth > 1 << 31:
        raise TiffError("page without a usable size")
    if set(tags.get(BITS) or [1]) != {8} or one(PLANAR, 1) != 1 or one(PREDICTOR, 1) not in (1, 2):
        raise TiffError("only 8-bit interleaved samples with predictor 1 or 2 are supported")
    compression, predictor, tiled = one(COMPRESSION, NONE), one(PREDICTOR, 1), TILE_OFFSETS in tags
    if tiled:
        w, h = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)
        offsets, counts = tags[TILE_OFFSETS], tags.get(TILE_COUNTS, [])
    else:
        w, h = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, counts = tags.get(STRIP_OFFSETS, []), tags.get(STRIP_COUNTS, [])
    if min(w, h, depth) < 1:
        raise TiffError("strips or tiles without a usable size")
    blocks = -(-height // h) * -(-width // w)
    if len(offsets) < blocks or len(counts) < blocks:
        raise TiffError("strips or tiles are missing")
    stored = sum(max(0, min(offset + count, len(data)) - offset) for offset, count in zip(offsets[:blocks], counts, strict=False) if offset >= 0 < count)
    # Nothing of a page's size is made before its bytes are known to be there.
    if stored * MOST_RATIO < max(width * height, w * h if tiled else 0) * depth:
        raise TiffError("strips or tiles are cut short")
    places = ((y, x, h if tiled else min(h, height - y)) for y in range(0, height, h) for x in range(0, width, w))
    image = np.zeros((height, width, depth), np.uint8)
    for (y, x, rows), offset, count in zip(places, offsets, counts, strict=False):
        if offset < 0 or count < 0:
            raise TiffError("a strip or tile outside the file")
        size = rows * w * depth
        raw = _decode(bytes(data[offset : offset + count]), compression, size)
        if len(raw) < size:
            raise TiffError("a strip or tile is cut short")
        block = np.frombuffer(raw[:size], np.uint8).reshape(rows, w, depth)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        image[y : y + rows, x : x + w] = block[: height - y, : width - x]
    return Page(image, compression, predictor, tiled)


def payload_of(text: bytes) -> bytes:
    """The text, zero-padded to a positive multiple of ROW."""
    return text + b"\0" * (-len(text) % ROW or (0 if text else ROW))


def store_text(text: bytes) -> bytes:
    """A text's payload as pages of PAGE_ROWS rows of ROW samples.

    The coding follows from the payload alone: LZW for the shortest, PackBits
    for short ones, deflate in strips, and deflated tiles with differencing
    for texts of several pages.
    """
    samples = np.frombuffer(payload_of(text), np.uint8).reshape(-1, ROW)
    pages = [samples[y : y + PAGE_ROWS] for y in range(0, len(samples), PAGE_ROWS)]
    if len(pages) > 1:
        return write_tiff(pages, DEFLATE, predictor=2, tile=TILE)
    return write_tiff(pages, LZW if len(samples) <= 4 else PACKBITS if len(samples) <= 16 else DEFLATE)


@F.arrow_udf(T.BinaryType())
def text_to_tiff(texts: pa.Array) -> pa.Array:
    return pa.array([store_text(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


_KINDS = {pa.int32(): T.IntegerType(), pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.bool_(): T.BooleanType(), pa.binary(): T.BinaryType()}


def _spark_struct(kind: pa.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, _KINDS[f.type]) for f in kind])


_DIGEST = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


@F.arrow_udf(_spark_struct(_DIGEST))
def tiff_digest(files: pa.Array) -> pa.Array:
    return pa.array([_digest(f) for f in files.to_pylist()], _DIGEST)


def _digest(file: bytes) -> dict:
    """Digests of the samples read back from a stored text, and features of its image."""
    pages = list(read_tiff(file))
    payload = b"".join(p.samples.tobytes() for p in pages)
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    mean = float((counts * np.arange(256)).sum() / len(payload))
    feature = f"pages={len(pages)};rows={len(payload) // ROW};coding={pages[0].compression};mean={mean:.4f};entropy={float(-(share * np.log2(share)).sum()) + 0.0:.4f};kinds={len(share)}"
    return {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-ROW:]), "media_bytes": len(file), "media_sha256": hashlib.sha256(file).hexdigest(), "feature": feature}


def text_media(docs: DataFrame) -> DataFrame:
    """Per document, of its text stored as TIFF and read back: the digest columns.

    Null texts are empty ones, whose payload is 64 zero bytes. Texts of any
    length are stored whole; rows that repeat get a row each with equal
    values. An empty table gives an empty result; other columns are not read.
    """
    stored = docs.select("doc_id", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"), text_to_tiff(F.col("text").cast("string")).alias("media"))
    return stored.select("doc_id", "n_bytes", tiff_digest("media").alias("d")).select("doc_id", "n_bytes", "d.*")


_PAGE = pa.struct([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples_per_pixel", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("samples", pa.binary()), ("error", pa.string())])


def _pages(file: bytes) -> Iterator[dict]:
    for n, p in enumerate(_walk(file), 1):
        if isinstance(p, TiffError):
            yield {"page": n, "error": str(p)}
            continue
        h, w, d = p.samples.shape
        yield {"page": n, "width": w, "height": h, "samples_per_pixel": d, "compression": p.compression, "predictor": p.predictor, "tiled": p.tiled, "samples": p.samples.tobytes(), "error": None}


def read_pages(files: DataFrame, media: str = "media") -> DataFrame:
    """One row per page, with an error where it cannot be read: all columns but ``media``, then a struct column ``tiff_page`` of the page.

    Where the input has that name already, underscores are added. Pages leave
    as they are decoded, some PAGE_BYTES together, so a file of any number of
    pages takes no more memory than its bytes and a page.
    """
    name = fresh(files, "tiff_page")
    others = [f for f in files.schema if f.name != media]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select([f.name for f in others])
            for i, pages in _page_runs(batch.column(batch.schema.get_field_index(media))):
                yield pa.RecordBatch.from_arrays([*rest.take(pa.array(i)).columns, pa.array(pages, _PAGE)], names=[*rest.schema.names, name])

    return files.mapInArrow(each, T.StructType([*others, T.StructField(name, _spark_struct(_PAGE))]))


def _page_runs(files: pa.Array) -> Iterator[tuple[list[int], list[dict]]]:
    """Pages, some together, with the row that each is of."""
    rows, pages, held = [], [], 0
    for i in range(len(files)):
        if files[i].is_valid:
            for page in _pages(files[i].as_py()):
                rows.append(i)
                pages.append(page)
                held += len(page.get("samples", b"")) + 100
                if held >= PAGE_BYTES:
                    yield rows, pages
                    rows, pages, held = [], [], 0
    if rows:
        yield rows, pages


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media) from (doc_id, text): files leave as they are made, some PAGE_BYTES together."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _file_runs(batch)

    return docs.mapInArrow(each, "doc_id long, media binary")


def _file_runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    begin, files, held = 0, [], 0
    texts = batch.column(1).cast(pa.binary())
    for i in range(len(texts)):
        files.append(store_text(texts[i].as_py() or b""))
        held += len(files[-1])
        if held >= PAGE_BYTES or i + 1 == len(texts):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(files)), pa.array(files, pa.binary())], names=["doc_id", "media"])
            begin, files, held = i + 1, [], 0


def text_pages(docs: DataFrame) -> DataFrame:
    """The pages of every text stored as TIFF: doc_id, page, width, height, compression, predictor, tiled, samples_sha256, error.

    Null and empty texts have one page; nothing else differs from `text_media`.
    """
    stored = store_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    p = read_pages(stored).select("doc_id", "tiff_page.*")
    return p.select("doc_id", "page", "width", "height", "compression", "predictor", "tiled", F.sha2("samples", 256).alias("samples_sha256"), "error")
