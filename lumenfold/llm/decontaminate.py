"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is found in a document where at least ``percent`` of the item's
distinct five-word shingles are among the document's.

Items are partitioned by the size n of their shingle set (one partition per
power of two). An item's MinHash sketch is its p(n) = n - ceil(n * percent /
100) + 1 smallest shingle hashes: a document that contains the wanted share of
the item misses at most p(n) - 1 of its shingles, so it holds at least one of
the sketch. The search is therefore complete, however long the document is,
where a signature of fixed length over the document would hardly ever meet a
short item. A document of m shingles probes only the partitions whose smallest
item can have its share of shingles among m; one filter over all partitions
first leaves the few hashes worth probing. Candidates are verified on the
shingles' words. "Complete" is in terms of shingles: an item of fewer than five
words matches only a document that is exactly those words, and is not searched
inside longer texts.

Items are the stated query set. Their index is made once, on the driver, as
sorted arrays and packed texts (about 15 bytes a shingle), and broadcast in
blocks of at most ``BLOCK_SHINGLES`` shingles (a bound checked while blocks are
cut), each block against all documents, so any number of items is handled.

Defined results: null or empty texts match nothing. An item or document of
fewer than five words has its whole word sequence as the one shingle. Rows
repeat if items or documents do. An empty table on either side gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import SHINGLE_WORDS, broadcast_if_small, fresh, map_arrow, shingle_hashes, stash, text_bytes, text_digest, word_hashes, words_of

#: Shingles of a block of items; about 60 MB of arrays and texts in a Python worker.
BLOCK_SHINGLES = 4_000_000
#: Items whose shingles a worker remembers between documents.
_ITEMS_HELD = 2_000


def sketch_length(n: int, percent: int) -> int:
    """How many of an item's n shingles must be tried so that none is missed."""
    return n - -(-n * percent // 100) + 1


class Partition(NamedTuple):
    """Items of one size class: the fewest shingles that match one, sorted sketch hashes, and the item of each."""

    need: int
    sketch: np.ndarray
    owner: np.ndarray


class ItemIndex:
    """A block of items: sketches by size partition, a filter over all of them, and the packed texts."""

    def __init__(self, items: list[tuple[int, bytes]], percent: int) -> None:
        self.percent = percent
        self.ids: list[int] = []
        self.texts: list[bytes] = []
        needs: dict[int, int] = {}
        sketches: dict[int, list[np.ndarray]] = defaultdict(list)
        owners: dict[int, list[np.ndarray]] = defaultdict(list)
        for item_id, text in items:
            hashes = np.unique(shingle_hashes(word_hashes(words_of(text))))
            n = len(hashes)
            if not n:
                continue
            kind, p = n.bit_length(), sketch_length(n, percent)
            needs[kind] = min(needs.get(kind, n), n - p + 1)
            sketches[kind].append(hashes[:p])
            owners[kind].append(np.full(p, len(self.ids), np.int32))
            self.ids.append(item_id)
            self.texts.append(text)
        self.partitions = [_partition(needs[kind], sketches[kind], owners[kind]) for kind in sorted(needs)]
        entries = sum(len(p.sketch) for p in self.partitions)
        self.shift = np.uint64(64 - min(max(20, entries.bit_length() + 4), 26))
        self.filter = np.zeros(1 << (64 - int(self.shift)), bool)
        for part in self.partitions:
            self.filter[(part.sketch >> self.shift).astype(np.int64)] = True
        self.held: dict[int, dict[int, bytes]] = {}

    def candidates(self, hashes: np.ndarray) -> list[int]:
        """Items of which a text with these shingle hashes holds one of the sketch, by the partitions it is large enough for."""
        near = np.unique(hashes[self.filter[(hashes >> self.shift).astype(np.int64)]])
        found: set[int] = set()
        for part in self.partitions if len(near) else ():
            if part.need > len(hashes):
                break
            first, last = np.searchsorted(part.sketch, near, "left"), np.searchsorted(part.sketch, near, "right")
            for at in np.flatnonzero(last > first):
                found.update(part.owner[first[at] : last[at]].tolist())
        return sorted(found)

    def matches(self, text: bytes | None) -> Iterator[tuple[int, int, int]]:
        """(item_id, item's shingles, of these in the text) of each item that the text contains."""
        words = words_of(text or b"")
        hashes = shingle_hashes(word_hashes(words))
        candidates = self.candidates(hashes)
        if not candidates:
            return
        at = {int(h): i for i, h in enumerate(hashes)}
        for i in candidates:
            grams = self._grams(i)
            found = sum(h in at and _gram(words, at[h]) == gram for h, gram in grams.items())
            if found * 100 >= len(grams) * self.percent:
                yield self.ids[i], len(grams), found

    def _grams(self, i: int) -> dict[int, bytes]:
        if i not in self.held:
            if len(self.held) >= _ITEMS_HELD:
                self.held.clear()
            words = words_of(self.texts[i])
            self.held[i] = {int(h): _gram(words, k) for k, h in enumerate(shingle_hashes(word_hashes(words)))}
        return self.held[i]


def _partition(need: int, sketches: list[np.ndarray], owners: list[np.ndarray]) -> Partition:
    sketch, owner = np.concatenate(sketches), np.concatenate(owners)
    order = np.argsort(sketch, kind="stable")
    return Partition(need, sketch[order], owner[order])


def _gram(words: list[bytes], i: int) -> bytes:
    return b" ".join(words[i : i + SHINGLE_WORDS])


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items, streamed to the driver, in blocks of bounded shingle count."""
    block, held = [], 0
    for item_id, text in items.toLocalIterator():
        raw = (text or "").encode()
        size = len(words_of(raw))
        if block and held + size > BLOCK_SHINGLES:
            yield block
            block, held = [], 0
        block.append((item_id, raw))
        held += size
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, n_item_shingles, n_found, containment."""
    return _search(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), items, percent)


def _search(slim: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The matches of rows (key, text); the first column names the row in the result."""
    key = slim.schema[0]
    schema = f"{key.name} {key.dataType.simpleString()}, item_id long, n_item_shingles long, n_found long, containment double"
    queries = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    out = None
    for block in _blocks(queries):
        part = map_arrow(slim, _searcher(slim.sparkSession.sparkContext.broadcast(ItemIndex(block, percent)), key.name), schema)
        out = part if out is None else out.unionByName(part)
    return slim.sparkSession.createDataFrame([], schema) if out is None else out


def _searcher(index, name: str):
    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(k, *m) for k, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True) for m in index.value.matches(text)]
        key, item_id, size, found = zip(*rows, strict=True) if rows else ((), (), (), ())
        ints = [pa.array(x, pa.int64()) for x in (item_id, size, found)]
        return pa.RecordBatch.from_arrays([pa.array(key, batch.schema.field(0).type), *ints, pa.array([f / n for f, n in zip(found, size, strict=True)], pa.float64())], names=[name, "item_id", "n_item_shingles", "n_found", "containment"])

    return search


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` whose text contains no item; columns unchanged.

    A row goes by its own text, named by its digest: null and repeated ids matter nothing.
    """
    gone, digest = fresh(docs, "gone_text"), text_digest()
    found = _search(docs.select(digest.alias(gone), F.col("text").cast("string")), items, percent)
    return docs.join(broadcast_if_small(stash(found.select(gone).distinct(), "contaminated")), digest == F.col(gone), "left_anti")


#: The same matches by SQL alone.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda k: array_to_string(w[k + 1 : k + 5], ' '))) AS g FROM d WHERE len(w) > 0),
i_s AS (SELECT DISTINCT item_id, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda k: array_to_string(w[k + 1 : k + 5], ' '))) AS g FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM i_s GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS k FROM ds JOIN i_s USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item_shingles, k AS n_found, k::DOUBLE / n AS containment
FROM m JOIN n USING (item_id) WHERE k * 100 >= n * 80
"""
