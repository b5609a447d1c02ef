"""Token ids in ORC: encode, write in id order, read back, prune by metadata.

Layout: one row per document (doc_id long, text_hash long, ids array<int>),
files and rows in ascending order of doc_id (nulls first) and text_hash. ORC
cuts a file into stripes, which are read in parallel; integers are stored with
ORC's run-length encoding; each stripe carries a row index (minimum and
maximum per ``ROW_GROUP`` rows) and a Bloom filter on doc_id, so a lookup of
ids reads only the row groups that can hold them.

Encoding uses the tokenizers library. A tokenizer file whose settings say that
it drops white space and never joins text across it (``cuts_at_blanks``) gives
a text the ids of its pieces between blanks. Pieces, and the parts into which the split cuts
them, are told apart once per batch; parts not met lately are encoded together,
and ids are gathered back by position. Every other tokenizer file is given whole texts. Tests hold
both against encoding whole texts.

Defined results: a null text is empty: its only id is the end id. Rows of equal
doc_id are all written, ordered by their text's hash; rows of null doc_id come
first. Repeated rows spread over several files if they are many. ``start`` is
the place in the files. An empty table gives an empty index; other columns are
not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import broadcast_if_small, list_array, one_thread, scratch_path, stash, trim

#: Rows to which an ORC row index entry refers.
ROW_GROUP = 1000
STRIPE_BYTES = 16 << 20
#: Texts are encoded together up to so many bytes, unless one text alone has more.
BATCH_BYTES = 4 << 20
#: Parts that a generation of an encoder's memory holds.
RECENT = 100_000
#: Parts that go to the tokenizer in one call.
CALL_PARTS = 256

# Settings of a tokenizer file under which texts may be cut at blanks.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# What _SPLIT cuts a lower-cased piece of the characters of _PLAIN into.
_PARTS = r"([a-zß-öø-ſ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-z0-9ß-öø-ſ]+)"
_LETTERS = "^[a-zß-öø-ſ]*$"
# Printable ASCII and the letters of Latin-1 and Latin Extended-A, but for those whose lower case is special.
_PLAIN = "^[!-~À-ÖØ-öø-įĲ-ňŊ-ž]*$"


def cuts_at_blanks(path: str) -> bool:
    """Whether the settings in a tokenizer file are those under which blanks part texts.

    Blanks become one blank, which no piece of the split matches, and nothing
    is added at a text's ends; special tokens hold no blank and take none; a
    word's last token, and no other, carries the suffix of word ends.
    """
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    parts = (found.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = parts[0].get("type") == "Split" and parts[0].get("pattern") == {"Regex": _SPLIT} and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
    bytes_only = [(p.get("type"), p.get("add_prefix_space"), p.get("use_regex")) for p in parts[1:]] == [("ByteLevel", False, False)]
    special = all(not re.search(r"\s", t["content"]) and t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in found.get("added_tokens") or [])
    ends = found["model"].get("end_of_word_suffix") and not found["model"].get("unk_token") and not found.get("post_processor")
    return bool(ends) and split and bytes_only and special and (found.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and not (found.get("truncation") or found.get("padding"))


class Recent:
    """A memory of two generations: what was not used since the last turn-over is forgotten at the next."""

    def __init__(self, limit: int = RECENT) -> None:
        self.limit, self.young, self.old = limit, {}, {}

    def get_all(self, keys: list[str]) -> tuple[list, list[int]]:
        """What is known of each key, and the places of the unknown ones."""
        found, unknown, old, young = list(map(self.young.get, keys)), [], self.old, self.young
        for i, value in enumerate(found):
            if value is None:
                value = old.get(keys[i])
                if value is None:
                    unknown.append(i)
                else:
                    found[i] = young[keys[i]] = value
        return found, unknown

    def add(self, pairs: dict[str, bytes]) -> None:
        self.young |= pairs
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young


class TextEncoder:
    """Whole texts, for any tokenizer file."""

    def __init__(self, path: str) -> None:
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode_batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with the end id, and how many each has."""
        packed = [self.encode(t or "") + _packed([end_id]) for t in texts.to_pylist()]
        return np.frombuffer(b"".join(packed), "<u4"), np.array([len(p) // 4 for p in packed], np.int64)

    def rest(self) -> None:
        return


class PieceEncoder(TextEncoder):
    """Pieces between blanks, for files of which ``cuts_at_blanks`` holds.

    Pieces, and the parts into which the split cuts them, are columns with a
    dictionary; Python meets each different part once per batch.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        # The same model for parts, which are normalised and cut already.
        self.of_parts = Tokenizer.from_str(json.dumps(settings | {"normalizer": None}))
        self.of_parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.tokenizer.get_vocab(), settings["model"]["end_of_word_suffix"]
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.parts = Recent()

    def encode_batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        coded = lists.values.dictionary_encode()
        ids, sizes = self._pieces(coded.dictionary)
        ids, sizes = np.append(ids, np.uint32(end_id)), np.append(sizes, 1)  # one more piece at each text's end
        ends = lists.offsets.to_numpy()[1:]
        out, stops = _gather(ids, sizes, np.insert(coded.indices.to_numpy(), ends, len(sizes) - 1))
        return out, np.diff(stops[ends + np.arange(len(texts))], prepend=0)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        other = pc.or_(pc.match_substring(pieces, "<|"), pc.invert(pc.match_substring_regex(pieces, _PLAIN)))
        # A piece of other characters is one part, known by a leading blank, and encoded as it stands.
        low = pc.utf8_lower(pieces)
        cut = pc.if_else(pc.match_substring_regex(low, _LETTERS), low, pc.replace_substring_regex(low, _PARTS, r"\1 "))
        lists = pc.split_pattern(pc.if_else(other, pieces, pc.ascii_rtrim_whitespace(cut)), " ")
        coded = lists.values.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        lone = set(pieces.filter(other).to_numpy(zero_copy_only=False).tolist())
        packed = self.ids_of(names, lone)
        pool, size = np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids, stops = _gather(pool, size, coded.indices.to_numpy())
        return ids, np.diff(np.append(0, stops)[lists.offsets.to_numpy()])

    def ids_of(self, names: list[str], lone: set[str]) -> list[bytes]:
        """The ids of each name: a piece if it is in ``lone``, else a part."""
        found, unknown = self.parts.get_all(names)
        new = [names[i] for i in unknown if names[i] and names[i] not in lone]
        made = dict(zip(new, self._ids_of_parts(new), strict=True))
        for i in unknown:
            name = names[i]
            found[i] = made[name] if name in made else made.setdefault(name, self.encode(name))
        self.parts.add(made)
        return found

    def _ids_of_parts(self, parts: list[str]) -> list[bytes]:
        """Parts joined by blanks are told apart by the tokens that end a word."""
        some = [" ".join(parts[at : at + CALL_PARTS]) for at in range(0, len(parts), CALL_PARTS)]
        ids = np.array([i for found in self.of_parts.encode_batch_fast(some, add_special_tokens=False) for i in found.ids], "<u4")
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stops) != len(parts) or (stops[-1] if len(stops) else 0) != len(ids):
            raise ValueError("the tokenizer does not take parts as words")
        packed, stops = ids.tobytes(), (4 * stops).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def rest(self) -> None:
        """Between tasks only one generation is kept."""
        self.parts.old = {}


def _gather(pool: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``pool``, which holds runs of the given sizes, in the order ``at``; and where each ends."""
    first, taken = np.cumsum(sizes) - sizes, sizes[at]
    stops = np.cumsum(taken)
    return pool[np.arange(stops[-1] if len(stops) else 0) + np.repeat(first[at] - (stops - taken), taken)], stops


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


@lru_cache(2)
def encoder(path: str, by_words: bool = True) -> TextEncoder:
    """The worker's encoder of a tokenizer file, made once; ``by_words`` holds only where the file allows it."""
    return PieceEncoder(path) if by_words and cuts_at_blanks(path) else TextEncoder(path)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about BATCH_BYTES of a string column's bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    part = np.cumsum(sizes) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _encode(path: str, end_id: int, by_words: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, by_words)
        for batch in batches:
            for rows in _slices(batch, 2):
                ids, sizes = own.encode_batch(rows.column(2), end_id)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), list_array(ids.view("<i4"), sizes, pa.int32())], names=["doc_id", "text_hash", "ids"])
        own.rest()
        trim()

    return each


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, by_words: bool = True) -> None:
    """Encode ``docs`` (doc_id, text) and write them to ``path`` in order of doc_id and text hash.

    Texts are dealt by ranges of (doc_id, text hash, place) before they are
    encoded: that moves them once, and a hot or null doc_id, or a row repeated
    many times, spreads over several files.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), F.col("text").cast("string").alias("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.col("text_hash"))
    dealt = slim.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("place")).drop("place").sortWithinPartitions(*order)
    writer = dealt.mapInArrow(_encode(tokenizer, end_id, by_words), "doc_id long, text_hash long, ids array<int>").write
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(ROW_GROUP), "orc.stripe.size": str(STRIPE_BYTES)}
    writer.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows: doc_id, text_hash, ids. Filters on doc_id reach the ORC reader."""
    return spark.read.schema("doc_id long, text_hash long, ids array<int>").orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        ids = rows.column(3)
        offsets = ids.offsets.to_numpy()
        values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
        crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(np.diff(offsets), pa.int64()), pa.array(crcs, pa.int64())], names=["file", "doc_id", "text_hash", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document, from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it. Totals per file (one
    row each) give every file's start; inside a file ids are summed in the
    order of its rows, so no task holds more than a file's rows.
    """
    stored = read_tokens(spark, path).select(F.input_file_name().alias("file"), "doc_id", "text_hash", "ids")
    rows = stash(stored.mapInArrow(_digest, "file string, doc_id long, text_hash long, n_tokens long, ids_crc32 long"), "token-digests")
    key = F.struct(F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("doc"), "text_hash")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min(key).alias("first"), F.max(key).alias("last"))
    # Rows alike may fill several files; these follow each other in any order.
    before = Window.orderBy("first", "last", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(F.col("file").alias("of"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "text_hash", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return rows.withColumn("own", own).join(broadcast_if_small(stash(starts, "file-starts")), F.col("file") == F.col("of")).select("doc_id", (F.col("file_start") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def tokenize_and_index(docs: DataFrame, tokenizer: str, end_id: int = 2, by_words: bool = True) -> DataFrame:
    """Write ``docs`` as token ids below the shared folder and return the index read back."""
    path = scratch_path(docs.sparkSession, "tokens") + ".orc"
    write_tokens(docs, path, tokenizer, end_id, by_words)
    return token_index(docs.sparkSession, path)


def whole_text_ids(texts: Iterator[str | None], tokenizer: str, end_id: int = 2) -> list[list[int]]:
    """Ids by encoding each whole text, for comparison."""
    one = TextEncoder(tokenizer).tokenizer
    return [one.encode(t or "", add_special_tokens=False).ids + [end_id] for t in texts]
