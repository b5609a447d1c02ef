"""Pages of PDF files as rows: (path, source_id, page, pages, text, error).

A file's objects are found by its cross-reference tables and streams, newest
first, or, where those are damaged, by looking for objects in the file.
Streams may be deflated (with PNG predictors) and objects may lie in object
streams. A page's text is what its content streams show, in their order: codes
become characters by the font's ToUnicode map, else by Windows' Latin code
page; a move to another line starts a new line, a wide gap is a blank.

Defined results: pages count from 1 in the order of the page tree; blank pages
are rows with empty text. A page that cannot be read is a row with an error,
and the next ones are read. A file that cannot be read at all, that is
encrypted or has no pages, is one row of page 0 with an error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, source_id string, page int, pages int, text string, error string"
_SPACE, _END = b" \t\r\n\f\0", b" \t\r\n\f\0()<>[]{}/%"
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_REFERENCE = re.compile(rb"(\d+)[ \t\r\n\f\0]+(\d+)[ \t\r\n\f\0]+R(?![A-Za-z0-9])")
_OBJECT = re.compile(rb"(?<![0-9])(\d+)[ \t\r\n\f\0]+\d+[ \t\r\n\f\0]+obj\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfError(ValueError):
    pass


class Name(str):
    pass


class Ref(NamedTuple):
    number: int


class Stream(NamedTuple):
    head: dict
    raw: bytes


class Word(bytes):
    """An operator of a content stream."""


def _skip(data: bytes, at: int) -> int:
    while at < len(data):
        if data[at] in _SPACE:
            at += 1
        elif data[at] == 37:  # a comment
            at = min((p for p in (data.find(b"\n", at), data.find(b"\r", at)) if p >= 0), default=len(data))
        else:
            break
    return at


def value(data: bytes, at: int, depth: int = 0) -> tuple[Any, int]:
    """The value at a place and the place after it; operators are `Word`s."""
    at = _skip(data, at)
    if at >= len(data) or depth > 100:
        raise PdfError("a value is cut off")
    if data.startswith(b"<<", at):
        out, at = {}, _skip(data, at + 2)
        while not data.startswith(b">>", at):
            key, at = value(data, at, depth + 1)
            out[str(key)], at = value(data, at, depth + 1)
            at = _skip(data, at)
        return out, at + 2
    first = data[at : at + 1]
    if first == b"[":
        items, at = [], _skip(data, at + 1)
        while data[at : at + 1] != b"]":
            item, at = value(data, at, depth + 1)
            items.append(item)
            at = _skip(data, at)
        return items, at + 1
    if first == b"/":
        end = at + 1
        while end < len(data) and data[end] not in _END:
            end += 1
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), data[at + 1 : end]).decode("latin-1")), end
    if first == b"(":
        return _literal(data, at + 1)
    if first == b"<":
        end = data.index(b">", at)
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
    if found := _REFERENCE.match(data, at):
        return Ref(int(found[1])), found.end()
    if found := _NUMBER.match(data, at):
        return float(found[0]) if b"." in found[0] else int(found[0]), found.end()
    end = at
    while end < len(data) and data[end] not in _END:
        end += 1
    if end == at:
        raise PdfError("a value was expected")
    word = data[at:end]
    return {b"true": True, b"false": False, b"null": None}.get(word, Word(word)), end


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    out, open_ = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            if digits := re.compile(rb"[0-7]{1,3}").match(data, at + 1):
                out.append(int(digits[0], 8) & 255)
                at = digits.end()
                continue
            after = data[at + 1 : at + 2]
            if after in b"\r\n":
                at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
                continue
            out += _ESCAPES.get(after, after)
            at += 2
            continue
        open_ += (c == b"(") - (c == b")")
        if not open_:
            return bytes(out), at + 1
        out += c
        at += 1
    raise PdfError("a string is cut off")


class File:
    """Objects of a file by number, read when they are asked for."""

    def __init__(self, data: bytes) -> None:
        self.data, self.places, self.head, self.known, self.held = data, {}, {}, {}, {}
        try:
            self._references(int(re.findall(rb"startxref\s+(\d+)", data)[-1]), set())
            if not isinstance(self.get(self.head.get("Root")), dict):
                raise PdfError("no root")
        except (PdfError, ValueError, IndexError, KeyError, TypeError, zlib.error):
            self._search()
        if "Encrypt" in self.head:
            raise PdfError("the file is encrypted")

    def _references(self, at: int, seen: set[int]) -> None:
        """Places of objects from a cross-reference section and those before it; newer ones stay."""
        if at in seen:
            return
        seen.add(at)
        at = _skip(self.data, at)
        if self.data.startswith(b"xref", at):
            at = _skip(self.data, at + 4)
            while not self.data.startswith(b"trailer", at):
                (first, many), at = self._two(at)
                for number in range(first, first + many):
                    (place, _), at = self._two(at)
                    at = _skip(self.data, at)
                    if self.data[at : at + 1] == b"n":
                        self.places.setdefault(number, place)
                    at = _skip(self.data, at + 1)
            head, _ = value(self.data, at + 7)
        else:
            stream = self._object_at(at)
            head, widths, body = stream.head, stream.head["W"], self.decoded(stream)
            spans, row = head.get("Index", [0, head["Size"]]), 0
            for first, many in zip(spans[::2], spans[1::2], strict=True):
                for number in range(first, first + many):
                    cells, p = [], row
                    for w in widths:
                        cells.append(int.from_bytes(body[p : p + w], "big"))
                        p += w
                    row = p
                    kind = cells[0] if widths[0] else 1
                    if kind == 1:
                        self.places.setdefault(number, cells[1])
                    elif kind == 2:
                        self.places.setdefault(number, (cells[1], cells[2]))
        self.head = head | self.head
        for older in ("XRefStm", "Prev"):
            if isinstance(head.get(older), int):
                self._references(head[older], seen)

    def _two(self, at: int) -> tuple[tuple[int, int], int]:
        a, at = value(self.data, at)
        b, at = value(self.data, at)
        return (a, b), at

    def _search(self) -> None:
        """Every object that the bytes show; the last of a number counts."""
        self.places, self.known, self.held = {int(m[1]): m.start() for m in _OBJECT.finditer(self.data)}, {}, {}
        for m in re.finditer(rb"trailer", self.data):
            try:
                self.head |= value(self.data, m.end())[0]
            except (PdfError, ValueError):
                continue
        for number in list(self.places):
            found = self.get(Ref(number))
            if isinstance(found, Stream) and found.head.get("Type") == "ObjStm":
                for k, inner in enumerate(self._packed(number)):
                    self.places.setdefault(inner, (number, k))
        for number in list(self.places):
            found = self.get(Ref(number))
            if isinstance(found, dict) and found.get("Type") == "Catalog":
                self.head.setdefault("Root", Ref(number))

    def _object_at(self, at: int) -> Any:
        found = _OBJECT.match(self.data, _skip(self.data, at))
        if not found:
            raise PdfError("an object is not where it should be")
        out, at = value(self.data, found.end())
        at = _skip(self.data, at)
        if isinstance(out, dict) and self.data.startswith(b"stream", at):
            at += 6
            at += 2 if self.data.startswith(b"\r\n", at) else 1
            size = self.get(out.get("Length"))
            if not isinstance(size, int) or not self.data[at + size : at + size + 20].lstrip(_SPACE).startswith(b"endstream"):
                size = self.data.index(b"endstream", at) - at
            return Stream(out, self.data[at : at + size])
        return out

    def get(self, x: Any) -> Any:
        """A value itself, or the object that it refers to; a missing one is null."""
        for _ in range(20):
            if not isinstance(x, Ref):
                return x
            if x.number not in self.known:
                place = self.places.get(x.number)
                self.known[x.number] = None  # also while it is read: a circle ends
                try:
                    if isinstance(place, tuple):
                        self.known[x.number] = list(self._packed(place[0]).values())[place[1]]
                    elif place is not None:
                        self.known[x.number] = self._object_at(place)
                except (PdfError, ValueError, IndexError, KeyError, TypeError, zlib.error):
                    self.known[x.number] = None
            x = self.known[x.number]
        raise PdfError("references go round")

    def _packed(self, number: int) -> dict[int, Any]:
        """Objects of an object stream by their numbers."""
        if number not in self.held:
            stream = self.get(Ref(number))
            body, at, pairs = self.decoded(stream), 0, []
            for _ in range(self.get(stream.head["N"])):
                n, at = value(body, at)
                place, at = value(body, at)
                pairs.append((n, place))
            self.held[number] = {n: value(body, self.get(stream.head["First"]) + place)[0] for n, place in pairs}
        return self.held[number]

    def decoded(self, stream: Stream) -> bytes:
        kinds, options = self.get(stream.head.get("Filter")), self.get(stream.head.get("DecodeParms"))
        kinds = kinds if isinstance(kinds, list) else [kinds] if kinds else []
        options = options if isinstance(options, list) else [options] * len(kinds)
        out = stream.raw
        for kind, option in zip(kinds, options, strict=False):
            kind, option = self.get(kind), self.get(option) or {}
            if kind in ("FlateDecode", "Fl"):
                out = zlib.decompressobj().decompress(out)
                out = _unpredicted(out, option) if option.get("Predictor", 1) >= 10 else out
            elif kind in ("ASCIIHexDecode", "AHx"):
                out = value(b"<" + out.split(b">")[0] + b">", 0)[0]
            else:
                raise PdfError(f"streams of {kind} are not read")
        return out

    def pages(self) -> Iterator[dict]:
        """Leaves of the page tree, with what they inherit."""
        root = self.get(self.head.get("Root"))
        if not isinstance(root, dict):
            raise PdfError("no page tree")
        todo, seen = [(root.get("Pages"), {})], set()
        while todo:
            ref, given = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref in seen):
                continue
            seen.add(ref if isinstance(ref, Ref) else id(node))
            given = given | {k: v for k, v in node.items() if k == "Resources"}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(kid, given) for kid in reversed(kids)]
            else:
                yield given | node


def _unpredicted(data: bytes, option: dict) -> bytes:
    width = option.get("Columns", 1) * option.get("Colors", 1) * option.get("BitsPerComponent", 8) + 7 >> 3
    step, out, above = max(1, option.get("Colors", 1) * option.get("BitsPerComponent", 8) + 7 >> 3), bytearray(), bytes(width)
    for at in range(0, len(data), width + 1):
        kind, line = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(len(line)):
            a, b, c = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] if kind == 4 else 0
            line[i] = line[i] + (0, a, b, a + b >> 1, near)[kind] & 255
        out += line
        above = bytes(line).ljust(width, b"\0")
    return bytes(out)


class Font:
    """Codes to characters."""

    def __init__(self, file: File, font: Any) -> None:
        font = font if isinstance(font, dict) else {}
        self.wide, self.map = font.get("Subtype") == "Type0", {}
        stream = file.get(font.get("ToUnicode"))
        if isinstance(stream, Stream):
            self._read(file.decoded(stream))

    def _read(self, body: bytes) -> None:
        at, stack = 0, []
        while _skip(body, at) < len(body):
            item, at = value(body, at)
            if not isinstance(item, Word):
                stack.append(item)
                continue
            if item == b"endcodespacerange" and stack and isinstance(stack[-1], bytes):
                self.wide = len(stack[-1]) > 1
            elif item == b"endbfchar":
                self.map |= {int.from_bytes(a, "big"): _utf16(b) for a, b in zip(stack[::2], stack[1::2], strict=False) if isinstance(b, bytes)}
            elif item == b"endbfrange":
                for a, b, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                    low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                    for k in range(min(high - low + 1, 65_536)):
                        text = _utf16(to[k]) if isinstance(to, list) and k < len(to) else _utf16(to) if isinstance(to, bytes) else ""
                        self.map[low + k] = text[:-1] + chr(ord(text[-1]) + k) if text and isinstance(to, bytes) else text
            stack = []

    def text(self, code: bytes) -> str:
        if self.wide:
            return "".join(self.map.get(int.from_bytes(code[k : k + 2], "big"), "") for k in range(0, len(code), 2))
        return "".join(self.map.get(c) or bytes([c]).decode("cp1252", "replace") for c in code)


def _utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace")


def page_text(file: File, page: dict) -> str:
    """What a page's content streams show."""
    contents = file.get(page.get("Contents"))
    streams = [file.get(c) for c in contents] if isinstance(contents, list) else [contents] if contents else []
    out: list[str] = []
    _shown(file, b"\n".join(file.decoded(s) for s in streams if isinstance(s, Stream)), file.get(page.get("Resources")) or {}, out, 0)
    return re.sub(r"[ ]*\n[ \n]*", "\n", "".join(out)).strip("\n ")


def _shown(file: File, body: bytes, resources: dict, out: list[str], depth: int) -> None:
    fonts = {k: file.get(v) for k, v in (file.get(resources.get("Font")) or {}).items()}
    made: dict[str, Font] = {}
    font, at, stack, line = Font(file, None), 0, [], None

    def move(y: float | None) -> None:
        """To another line; None: to the next one."""
        nonlocal line
        if y is None or y != line:
            out.append("\n")
        line = y

    while (at := _skip(body, at)) < len(body):
        item, at = value(body, at)
        if not isinstance(item, Word):
            stack.append(item)
            continue
        if item == b"Tf" and len(stack) >= 2:
            if stack[-2] not in made:
                made[stack[-2]] = Font(file, fonts.get(stack[-2]))
            font = made[stack[-2]]
        elif item in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
            if item != b"Tj":
                move(None)
            out.append(font.text(stack[-1]))
        elif item == b"TJ" and stack and isinstance(stack[-1], list):
            for x in stack[-1]:
                out.append(font.text(x) if isinstance(x, bytes) else " " if isinstance(x, int | float) and x < -200 else "")
        elif item in (b"Td", b"TD") and len(stack) >= 2:
            if stack[-1]:
                move(None)
            elif stack[-2]:
                out.append(" ")
        elif item == b"T*":
            move(None)
        elif item == b"Tm" and len(stack) >= 6:
            move(stack[-1])
        elif item == b"BT":
            line = None if line is None else line
            out.append("\n" if out else "")
        elif item == b"BI":  # an inline image
            end = re.compile(rb"[ \t\r\n\f\0]EI(?=[ \t\r\n\f\0]|$)").search(body, at)
            at = end.end() if end else len(body)
        elif item == b"Do" and stack and depth < 8:
            form = file.get((file.get(resources.get("XObject")) or {}).get(stack[-1]))
            if isinstance(form, Stream) and form.head.get("Subtype") == "Form":
                _shown(file, file.decoded(form), file.get(form.head.get("Resources")) or resources, out, depth + 1)
        stack = []


_FAULTS = (PdfError, ValueError, IndexError, KeyError, TypeError, AttributeError, OverflowError, RecursionError, zlib.error)


def read_pages(data: bytes) -> Iterator[tuple[int, int, str | None, str | None]]:
    """(page, pages, text, error) of each page of a file."""
    try:
        file = File(data)
        found = list(file.pages())
        if not found:
            raise PdfError("the file has no pages")
    except _FAULTS as e:
        yield 0, 0, None, str(e) or type(e).__name__
        return
    for n, page in enumerate(found, 1):
        try:
            yield n, len(found), page_text(file, page), None
        except _FAULTS as e:
            yield n, len(found), None, str(e) or type(e).__name__


def pdf_pages(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """The pages of all files of a folder, `ROWS`; pages of a file stream out of the task that holds it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")
    return read_column(files.select("path", name.alias("source_id"), "content"))


def read_column(files: DataFrame) -> DataFrame:
    """As `pdf_pages`, of files in a table (path, source_id, content); null content is an unreadable file."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, source, content = (batch.column(i)[k].as_py() for i in range(3))
                rows: list[tuple] = []
                for page in read_pages(content or b""):
                    rows.append((path, source, *page))
                    if len(rows) >= 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return files.select("path", "source_id", "content").mapInArrow(each, ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = [f.split()[0] for f in ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
