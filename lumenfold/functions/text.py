"""Text functions: normalisation, chunking, lexer, atoms and n-grams.

Everything that Spark can express stays in built-in expressions. Unicode
compatibility normalisation and the hard cut of long paragraphs, which Spark
lacks, are Arrow functions; what stands between the two is done there too.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a token, in order of preference: money, percent, date-like, word, number.
TOKEN = r"(?:[+-]?\$\s*\d[\d,]*(?:\.\d+)?)|(?:\d+(?:\.\d+)?%)|(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4})|(?:[A-Za-z0-9]+(?:[-_/'][A-Za-z0-9]+)*)|(?:\d+(?:[,.]\d+)*)"
BREAK = r"[.!?;:\n\r]+"
#: Runs of characters with which no token begins, and then any one character: with TOKEN they cover a text.
GAP = r"[^A-Za-z0-9$+\-]+"
DASHES = "–—−‑‒"

# What is stripped at a line's ends: all white space but LF.
BLANKS = r"[\x09\x0B-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

# Classes of atoms by pattern, first match first.
MONEY = r"^[+-]?\$\s*\d[\d,]*(?:\.\d+)?$"
PERCENT = r"^[+-]?\d+(?:\.\d+)?%$"
DATE = r"^(?:\d{1,2}[/-]){2}\d{2,4}$"
YEAR = r"^(?:19|20)\d{2}$"
FORM = r"^(?:w-?\d+[a-z]?|10\d\d(?:-[a-z]+)?|109[89](?:-[a-z]+)?|\d{4}-[a-z]+)$"
NUMBER = r"^[+-]?\d+(?:[,.]\d+)*$"


# Normalisation -----------------------------------------------------------


@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode NFKC; null stays null."""
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def fold_dashes(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def normalize_lines(text: Column) -> Column:
    """Line-wise clean-up, after NFKC where that is wanted; null gives an empty text.

    NULs go, line ends become LF, blanks collapse and are stripped per line,
    runs of blank lines become one, and leading and trailing ones go. Only LF
    ends a line; other separators (NEL, U+2028, U+001C to U+001F) are blanks at
    a line's ends and stay inside it.
    """
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit(""))
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\t\f\x0B ]+", " ")
    out = F.regexp_replace(out, f"(?dm)^{BLANKS}+|{BLANKS}+$", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\n+|\n+$", "")


_BLANK_RUN = re.compile(r"[\t\f\x0B][\t\f\x0B ]*| [\t\f\x0B ]+")
_EMPTY_LINES = re.compile(r"\n{3,}")


def document_text(text: str) -> str:
    """`normalize_lines` of a text's NFKC; steps that change nothing cost a search for a character."""
    out = text if text.isascii() else unicodedata.normalize("NFKC", text)
    out = out.replace("\0", "").replace("\r\n", "\n").replace("\r", "\n")
    if "  " in out or "\t" in out or "\f" in out or "\v" in out:
        out = _BLANK_RUN.sub(" ", out)
    out = "\n".join(map(str.strip, out.split("\n")))  # no line has LF, so what goes is BLANKS
    return (_EMPTY_LINES.sub("\n\n", out) if "\n\n\n" in out else out).strip("\n")


@F.arrow_udf(T.StringType())
def normalize_document(texts: pa.Array) -> pa.Array:
    """`document_text` of a column; null gives an empty text."""
    return pa.array([document_text(t.as_py() or "") for t in texts], pa.string())


# Chunks ------------------------------------------------------------------


def chunk_text(text: str, limit: int) -> list[str]:
    """Paragraphs packed into chunks of at most ``limit`` characters.

    A paragraph that is longer alone is cut at its last blank before the limit
    if that lies beyond the middle, else at the limit. A text within the limit
    is one chunk; an empty one has none.
    """
    if limit < 512:
        raise ValueError("chunks need at least 512 characters")
    if len(text) <= limit:
        return [text] if text else []
    done: list[str] = []
    pending = ""
    for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        joined = f"{pending}\n\n{paragraph}" if pending else paragraph
        if len(joined) <= limit:
            pending = joined
            continue
        if pending:
            done.append(pending)
        pending = paragraph if len(paragraph) <= limit else ""
        if not pending:
            done.extend(_hard_cuts(paragraph, limit))
    return [*done, pending] if pending else done


_FILLED = re.compile(r"\S")


def _hard_cuts(paragraph: str, limit: int):
    """Pieces between moving places, each looked at once: linear in the paragraph."""
    begin, end = 0, len(paragraph)
    while begin < end:
        stop = end
        if end - begin > limit:
            blank = paragraph.rfind(" ", begin, begin + limit)
            stop = blank if blank - begin > limit // 2 else begin + limit
        yield paragraph[begin:stop].strip()
        found = _FILLED.search(paragraph, stop)
        begin = found.start() if found else end


#: Characters of chunks that leave a task together.
CHUNKS_HELD = 1 << 20


def chunk_rows(pages: DataFrame, limit: int = 6000) -> DataFrame:
    """(..., chunk, text): the chunks of each row's normalised ``text``, numbered from 1 beside the row's other columns.

    A text is normalised and cut as one Python object, within its row.
    """
    names = [c for c in pages.columns if c != "text"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            numbers: list[int] = []
            held: list[str] = []
            size, texts = 0, batch.column(len(names))
            for i in range(len(texts)):
                found = chunk_text(document_text(texts[i].as_py() or ""), limit)
                at.extend([i] * len(found))
                numbers.extend(range(1, len(found) + 1))
                held.extend(found)
                size += sum(map(len, found))
                if held and (size >= CHUNKS_HELD or i + 1 == len(texts)):
                    own = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*(own.column(k) for k in range(len(names))), pa.array(numbers, pa.int32()), pa.array(held, pa.string())], names=[*names, "chunk", "text"])
                    at, numbers, held, size = [], [], [], 0

    kinds = [pages.schema[c] for c in names]
    return pages.select(*names, F.col("text").cast("string").alias("text")).mapInArrow(each, T.StructType([*kinds, T.StructField("chunk", T.IntegerType()), T.StructField("text", T.StringType())]))


# Lexer and atoms ---------------------------------------------------------


def tokens(text: Column) -> Column:
    """Surfaces of a text's tokens, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


_SPAN = pa.struct([("ord", pa.int32()), ("surface", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("run", pa.int32())])
_TOKEN, _GAP, _BREAK = re.compile(TOKEN, re.ASCII), re.compile(GAP), re.compile(BREAK)
#: Tokens that are Python objects at a time, and that leave a task together.
TOKENS_HELD = 1 << 15


def each_span(text: str) -> Iterator[tuple[int, str, int, int, int]]:
    """(ord, surface, start, end, run) of each token."""
    run, done = 0, 0
    for n, m in enumerate(_TOKEN.finditer(text)):
        start, end = m.span()
        if start > done and _BREAK.search(text, done, start):
            run += sum(_BREAK.search(g) is not None for g in _GAP.findall(text, done, start))
        done = end
        yield n, m.group(), start, end, run


def spans_of(text: str) -> list[tuple[int, str, int, int, int]]:
    return list(each_span(text))


def _span_array(found: list[tuple[int, str, int, int, int]]) -> pa.StructArray:
    columns = list(zip(*found, strict=True)) or [()] * 5
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPAN, strict=True)], fields=list(_SPAN))


def _token_runs(texts: pa.Array) -> Iterator[tuple[list[int], pa.StructArray]]:
    """At most TOKENS_HELD tokens together, with the place of the text that each is of."""
    at: list[int] = []
    held: list[tuple[int, str, int, int, int]] = []
    for i in range(len(texts)):
        found, more = each_span(texts[i].as_py() or ""), True
        while more:
            held.extend(islice(found, TOKENS_HELD - len(held)))
            at.extend([i] * (len(held) - len(at)))
            more = len(held) == TOKENS_HELD
            if more:
                yield at, _span_array(held)
                at, held = [], []
    if held:
        yield at, _span_array(held)


def _text_runs(texts: pa.Array) -> Iterator[tuple[int, pa.ListArray]]:
    """Whole texts until they have TOKENS_HELD tokens: the place of the first, and the tokens of each."""
    begin, offsets = 0, [0]
    held: list[tuple[int, str, int, int, int]] = []
    for i in range(len(texts)):
        held.extend(each_span(texts[i].as_py() or ""))
        offsets.append(len(held))
        if len(held) >= TOKENS_HELD or i + 1 == len(texts):
            yield begin, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _span_array(held))
            begin, offsets, held = i + 1, [0], []


_SPAN_TYPE = T.StructType([T.StructField(f.name, T.StringType() if f.type == pa.string() else T.IntegerType()) for f in _SPAN])


def token_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """(id, ord, surface, start_char, end_char, run): tokens with offsets in code points.

    ``run`` counts the sentence breaks before a token, so that tokens of one
    run have no break between them. A text is read within its row, without a
    shuffle, and its tokens leave as they are found: rows that repeat an id, or
    have none, are texts of their own; ``row`` names a column to tell them
    apart. A null text has no tokens.
    """
    ids = docs.select(F.col(id_col).alias("id"), *([F.monotonically_increasing_id().alias("row")] if row else []), F.col(text_col).cast("string").alias("text"))
    names = [id_col, *([row] if row else [])]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, spans in _token_runs(batch.column(batch.num_columns - 1)):
                own = [batch.column(k).take(pa.array(at)) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*own, *spans.flatten()], names=[*names, *(f.name for f in _SPAN)])

    kinds = [T.StructField(n, f.dataType) for n, f in zip(names, ids.schema, strict=False)]
    return ids.mapInArrow(each, T.StructType([*kinds, *_SPAN_TYPE]))


def span_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, spans) of each text: its tokens as an array of struct(ord, surface, start_char, end_char, run); ``row`` tells texts of one id apart."""
    ids = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, spans in _text_runs(batch.column(2)):
                own = batch.slice(begin, len(spans))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), spans], names=[id_col, "row", "spans"])

    return ids.mapInArrow(each, T.StructType([T.StructField(id_col, ids.schema["id"].dataType), T.StructField("row", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN_TYPE))]))


def atom_class(surface: Column) -> Column:
    """Class of a lower-cased, dash-folded surface."""
    return (
        F.when(~surface.rlike("[0-9]"), "word")  # every other class has a digit; most tokens end here
        .when(surface.rlike(MONEY), "money").when(surface.rlike(PERCENT), "percent").when(surface.rlike(DATE), "date").when(surface.rlike(YEAR), "tax_year")
        .when(surface.rlike(FORM), "form_like").when(surface.rlike(NUMBER), "number").otherwise("word")
    )


def atom_key(surface: Column) -> Column:
    """Canonical key of a lower-cased, dash-folded surface."""
    kind = atom_class(surface)
    placeholder = F.when(kind.isin("money", "percent", "date", "number"), F.concat(F.lit("<"), kind, F.lit(">"))).otherwise(surface)
    return F.when(surface.rlike("[0-9]"), placeholder).otherwise(surface)


def atom_aliases(surface: Column, most: int = 4) -> Column:
    """Further keys: a form's compact spelling, a compound word's parts."""
    compact = F.regexp_replace(surface, r"[-_\s]", "")
    parts = F.when(surface.contains("_"), F.split(surface, "_")).when(surface.contains("/"), F.split(surface, "/")).when(surface.contains("-") & surface.rlike(r"\p{L}"), F.split(surface, "-")).otherwise(F.array())
    word = F.slice(F.array_distinct(F.filter(parts, lambda p: p != "")), 1, most)
    kind = atom_class(surface)
    return F.when(kind == "form_like", F.when(compact != surface, F.array(compact)).otherwise(F.array())).when(kind == "word", word).otherwise(F.array())


def canonical_surface(surface: Column) -> Column:
    """What atoms are made of: lower case with plain dashes (tokens are ASCII, so NFKC changes nothing)."""
    return F.lower(fold_dashes(surface))


def keyed_runs(text: Column) -> Column:
    """array of runs, each an array of canonical keys without a sentence break between them."""
    mark = "\x01"
    items = F.regexp_extract_all(text, F.lit(f"{TOKEN}|{BREAK}"), F.lit(0))
    keys = F.transform(items, lambda x: F.when(x.rlike(f"^(?:{BREAK})$"), F.lit(mark)).otherwise(F.regexp_replace(atom_key(canonical_surface(x)), r"\s", " ")))
    runs = F.split(F.array_join(keys, "\x02"), mark)
    return F.filter(F.transform(runs, lambda r: F.filter(F.split(r, "\x02"), lambda k: k != "")), lambda r: F.size(r) > 0)


def word_grams(text: Column, orders: tuple[int, ...] = (1, 2, 3, 4)) -> Column:
    """array of struct(order, key): word n-grams that no sentence break interrupts."""

    def of_order(run: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(run) - (n - 1))
        found = F.transform(starts, lambda i: F.struct(F.lit(n).alias("order"), F.array_join(F.slice(run, i, n), " ").alias("key")))
        return F.when(F.size(run) >= n, found).otherwise(F.array().cast("array<struct<order:int,key:string>>"))

    return F.flatten(F.transform(keyed_runs(text), lambda run: F.concat(*[of_order(run, n) for n in orders])))


# Counts within tasks -------------------------------------------------------

#: TOKEN, where what begins with a letter, which can only be a word, is tried first; and the same or a break.
_QUICK = rf"[A-Za-z][A-Za-z0-9]*(?:[-_/'][A-Za-z0-9]+)*|{TOKEN}"
_SURFACE, _ITEM = re.compile(_QUICK, re.ASCII), re.compile(f"{_QUICK}|{BREAK}", re.ASCII)
_CLASSES = [(name, re.compile(p, re.ASCII)) for name, p in (("money", MONEY), ("percent", PERCENT), ("date", DATE), ("tax_year", YEAR), ("form_like", FORM), ("number", NUMBER))]
#: Items that a task counts at a time, and characters of surfaces that it remembers.
ITEMS_HELD, SURFACES_HELD = 1 << 20, 1 << 24


def surfaces(text: str, breaks: bool = False) -> Iterator[str]:
    """Tokens of a text, and with ``breaks`` the breaks between them, one at a time."""
    return map(re.Match.group, (_ITEM if breaks else _SURFACE).finditer(text))


_CUT = re.compile(f"({_QUICK}|{BREAK})", re.ASCII)


def cut_items(text: str, most: int) -> tuple[list[str], str]:
    """A text cut at its first ``most`` tokens and breaks, which stand at odd places of the list, and what follows them."""
    pieces = _CUT.split(text, most)
    return pieces, pieces.pop() if len(pieces) > 2 * most else ""


def key_of(surface: str) -> str:
    """`atom_key` of a token's `canonical_surface`."""
    key = surface.lower()
    if key.isalpha():
        return key
    kind = next((name for name, pattern in _CLASSES if pattern.search(key)), "word")
    return f"<{kind}>" if kind in ("money", "percent", "date", "number") else key


def aliases_of(key: str, most: int = 4) -> list[str]:
    """`atom_aliases` of a canonical key."""
    kind = "word" if key.isalpha() else next((name for name, pattern in _CLASSES if pattern.search(key)), "word")
    if kind == "form_like":
        compact = re.sub(r"[-_\s]", "", key)
        return [compact] if compact != key else []
    if kind != "word" or key.startswith("<"):
        return []
    mark = "_" if "_" in key else "/" if "/" in key else "-" if "-" in key and re.search("[a-z]", key) else None
    return list(dict.fromkeys(filter(None, key.split(mark))))[:most] if mark else []


def gives_char_grams(key: str, shortest: int = 7, longest: int = 64) -> bool:
    """`char_gram_eligible` of a canonical key."""
    return len(key) <= longest and not key.startswith("<") and (len(key) >= shortest or re.search(r"[0-9/-]", key) is not None)


class KeyNumbers(dict):
    """item -> number of its canonical key, from 1; breaks have 0."""

    def __init__(self) -> None:
        super().__init__()
        self.of_key, self.held = {"": 0}, 0

    def __missing__(self, item: str) -> int:
        self.held += len(item)
        found = self[item] = self.of_key.setdefault("" if item[0] in ".!?;:\n\r" else key_of(item), len(self.of_key))
        return found


def surface_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(raw, n): each distinct token and how often it occurs; tasks count their own before anything is shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0):
                found = surfaces(value.as_py() or "")
                while part := Counter(islice(found, ITEMS_HELD)):
                    counts.update(part)
                    if len(counts) >= ITEMS_HELD // 4:
                        yield _counted(counts)
                        counts.clear()
        yield _counted(counts)

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(each, "raw string, n long")
    return found.groupBy("raw").agg(F.sum("n").alias("n"))


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], names=["raw", "n"])


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(order, key, count) of all word n-grams up to 4 that no sentence break interrupts.

    Tasks number the keys, count equal n-grams of ITEMS_HELD items at a time as
    numbers, and write only distinct ones as text; these meet by a shuffle.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held = KeyNumbers(), array("i")
        for batch in batches:
            for value in batch.column(0):
                found, more = map(numbers.__getitem__, surfaces(value.as_py() or "", breaks=True)), True
                while more:
                    held.extend(islice(found, ITEMS_HELD - len(held)))
                    more = len(held) >= ITEMS_HELD
                    if more:
                        names, last = list(numbers.of_key), held[-3:]  # what begins with these needs what follows
                        yield from _grams(np.array(held, np.int64), names)
                        if numbers.held >= SURFACES_HELD:
                            numbers.clear()
                            numbers.__init__()
                            last = array("i", (numbers.of_key.setdefault(names[k], len(numbers.of_key)) for k in last))
                        held = last
                held.append(0)
        yield from _grams(np.array([*held, 0, 0, 0], np.int64), list(numbers.of_key))

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(each, "order int, key string, count long")
    return found.groupBy("order", "key").agg(F.sum("count").alias("count"))


def gram_numbers(items: np.ndarray, names: list[str]) -> list[tuple[pa.Array, np.ndarray]]:
    """Of word n-grams with 2, 3 and 4 words: the distinct keys, and the place among them of the n-gram that begins at each item, -1 where none does."""
    size, own = len(items), pa.array(names, pa.string())
    words = np.concatenate([np.where(items > 0, items, -1), [-1, -1, -1]]).astype(np.int64)
    found, keys, places = [], own, words[:size]
    for more in (1, 2, 3):
        tail = words[more : size + more]
        whole = np.flatnonzero((places >= 0) & (tail >= 0))
        codes, place = np.unique(places[whole] << 32 | tail[whole], return_inverse=True)
        keys, places = pc.binary_join_element_wise(keys.take(pa.array(codes >> 32)), own.take(pa.array(codes & 0xFFFFFFFF)), " "), np.full(size, -1)
        places[whole] = place
        found.append((keys, places))
    return found


def _grams(items: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams, with counts, that begin before the last three of these numbers; 0 is a break."""
    n = max(len(items) - 3, 0)
    for order, (keys, places) in enumerate([(pa.array(names, pa.string()), np.where(items > 0, items, -1)), *gram_numbers(items, names)], 1):
        places = places[:n]
        times = np.bincount(places[places >= 0], minlength=len(keys))
        yield from _gram_rows(order, keys.filter(pa.array(times > 0)), times[times > 0])


def _gram_rows(order: int, keys: pa.Array, counts: np.ndarray, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for begin in range(0, len(keys), rows):
        part = keys.slice(begin, rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), order, np.int32)), part, pa.array(counts[begin : begin + rows].astype(np.int64))], names=["order", "key", "count"])


def char_gram_eligible(surface: Column, key: Column, shortest: int = 7, longest: int = 64) -> Column:
    """Whether a token gives character n-grams: long or structured, not a placeholder, and of unchanged length."""
    shaped = (F.length(key) >= shortest) | key.rlike(r"[0-9]") | key.contains("-") | key.contains("/")
    return shaped & (F.length(key) <= longest) & ~key.startswith("<") & (F.length(key) == F.length(surface))


def char_grams(key: Column, orders: tuple[int, ...] = (3, 4, 5)) -> Column:
    """array of struct(order, pos, key): all substrings of these lengths."""

    def of_order(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.length(key) - n)
        found = F.transform(starts, lambda p: F.struct(F.lit(n).alias("order"), p.alias("pos"), key.substr(p + 1, F.lit(n)).alias("key")))
        return F.when(F.length(key) >= n, found).otherwise(F.array().cast("array<struct<order:int,pos:int,key:string>>"))

    return F.concat(*[of_order(n) for n in orders])


def char_gram_count(key: Column, orders: tuple[int, ...] = (3, 4, 5)) -> Column:
    """How many `char_grams` a key has."""
    return sum((F.greatest(F.length(key) - (n - 1), F.lit(0)) for n in orders), F.lit(0))
