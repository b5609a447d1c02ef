"""Exact duplicates by an index of cuckoo filters over live digests.

The index is a table, cut into shards by a hash of the digest. Every row is
one slot of its shard's filter: where its fingerprint lies (``bucket``,
``slot``) and, as the bucket's content, the SHA-256 and the length of the
normalised text, the row that stays (``keep``) and how many live rows have it.

* A digest that misses both its buckets is new; a hit is verified against the
  content stored in that bucket, so a shared fingerprint never joins texts.
* A digest leaves the filter when its last live row is deleted.
* An insertion that finds no place after ``KICKS`` moves doubles the buckets
  and places all again from the stored digests: nothing is ever turned away.

`build_index`, `insert_rows` and `delete_rows` return a new version of the
index; shards are worked on in parallel, one after the other in each task, and
rows of one digest are summed up before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import hot_limit, meet, stash, trim

#: Places of a bucket, moves before a filter grows, bits of a fingerprint.
SLOTS, KICKS, FINGERPRINT_BITS = 4, 400, 16
#: Digests that a shard is planned for; rows summed up at a time before the shuffle.
SHARD_DIGESTS, COMBINE_ROWS = 200_000, 100_000

_KEEP = "keep struct<absent:boolean,doc_id:long,row:long>"
ENTRY = f"shard int, log2_buckets int, bucket long, slot int, digest binary, n_bytes long, {_KEEP}, live long"


def normalised(text: Column | str = "text") -> Column:
    """A text with every run of blanks (0x20, 0x09-0x0D) as one space; null as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


@dataclass
class Filter:
    """One shard: a cuckoo filter, and beside each fingerprint what was stored with it."""

    log2_buckets: int = 4
    bits: int = FINGERPRINT_BITS
    size: int = 0
    grown: int = 0
    prints: list[int] = field(default_factory=list)
    stored: list[list | None] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.prints = [0] * (SLOTS << self.log2_buckets)
        self.stored = [None] * (SLOTS << self.log2_buckets)

    def _print_of(self, digest: bytes) -> int:
        return int.from_bytes(digest[:8], "big") % ((1 << self.bits) - 1) + 1

    def _first(self, digest: bytes) -> int:
        return int.from_bytes(digest[8:16], "big") & ((1 << self.log2_buckets) - 1)

    def _other(self, bucket: int, fingerprint: int) -> int:
        """A fingerprint's other bucket, found from either; the digest itself isn't needed."""
        return bucket ^ ((fingerprint * 0x9E3779B97F4A7C15 >> 20) & ((1 << self.log2_buckets) - 1))

    def find(self, digest: bytes, n_bytes: int) -> int | None:
        """The place of exactly this content, or None."""
        fp, bucket = self._print_of(digest), self._first(digest)
        for b in (bucket, self._other(bucket, fp)):
            for at in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.prints[at] == fp and self.stored[at][0] == digest and self.stored[at][1] == n_bytes:
                    return at
        return None

    def insert(self, entry: list) -> None:
        """Stores ``entry`` (digest, n_bytes, ...), which `find` has not found."""
        self.size += 1
        if homeless := self._place(entry):
            self._grow(homeless)

    def _place(self, entry: list) -> list | None:
        """None, or the entry that is left over after all moves."""
        fp = self._print_of(entry[0])
        bucket = self._first(entry[0])
        turn = bucket
        for b in (bucket, self._other(bucket, fp)):
            for at in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.prints[at]:
                    self.prints[at], self.stored[at] = fp, entry
                    return None
        for _ in range(KICKS):
            turn = turn * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
            at = bucket * SLOTS + (turn >> 33) % SLOTS
            fp, self.prints[at] = self.prints[at], fp
            entry, self.stored[at] = self.stored[at], entry
            bucket = self._other(bucket, fp)
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[at]:
                    self.prints[at], self.stored[at] = fp, entry
                    return None
        return entry

    def _grow(self, homeless: list) -> None:
        """Twice the buckets, filled from the stored digests."""
        waiting = [*filter(None, self.stored), homeless]
        while waiting:
            if self.log2_buckets >= 40:
                raise RuntimeError("more than eight different texts share 80 bits of SHA-256")
            self.log2_buckets += 1
            self.grown += 1
            self.__post_init__()
            every, waiting = waiting, []
            for entry in every:
                if self._place(entry):
                    waiting = every
                    break

    def delete(self, at: int) -> None:
        self.size -= 1
        self.prints[at], self.stored[at] = 0, None

    def put_back(self, at: int, entry: list) -> None:
        """Fills a place as it was written by an earlier version of the index."""
        self.size += 1
        self.prints[at], self.stored[at] = self._print_of(entry[0]), entry


def _least(a: dict | None, b: dict | None) -> dict | None:
    """The smaller of two rows (null ids last, then by row); None if there is none."""
    if a is None or b is None:
        return a or b
    key = lambda k: (k["absent"], k["doc_id"] or 0, k["row"])
    return min(a, b, key=key)


def _change(shard: Filter, change: int, digest: bytes, n_bytes: int, keep: dict | None, live: int) -> None:
    """``change`` 1: ``live`` rows more, of which ``keep`` is the least; 2: ``live`` rows are left, of which it is the least."""
    at = shard.find(digest, n_bytes)
    if change == 1 and at is None:
        shard.insert([digest, n_bytes, keep, live])
    elif change == 1:
        shard.stored[at][2], shard.stored[at][3] = _least(shard.stored[at][2], keep), shard.stored[at][3] + live
    elif at is not None and live <= 0:
        shard.delete(at)
    elif at is not None:
        shard.stored[at][2:] = [keep, live]


def _apply_changes(bits: int):
    """Task function: rows sorted by shard, entries of the old index (change 0) first; gives the new entries."""

    schema = pa.schema(
        [("shard", pa.int32()), ("log2_buckets", pa.int32()), ("bucket", pa.int64()), ("slot", pa.int32()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("keep", pa.struct([("absent", pa.bool_()), ("doc_id", pa.int64()), ("row", pa.int64())])), ("live", pa.int64())]
    )

    def entries(number: int, shard: Filter) -> Iterator[pa.RecordBatch]:
        full = [at for at, e in enumerate(shard.stored) if e is not None]
        for k in range(0, len(full), 20_000):
            part = full[k : k + 20_000]
            rows = [shard.stored[at] for at in part]
            columns = [[number] * len(part), [shard.log2_buckets] * len(part), [at // SLOTS for at in part], [at % SLOTS for at in part], *([r[i] for r in rows] for i in range(4))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, Filter(bits=bits)
        for batch in batches:
            names = ("shard", "change", "digest", "n_bytes", "keep", "live", "log2_buckets", "bucket", "slot")
            for n, change, digest, n_bytes, keep, live, log2_buckets, bucket, slot in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if n != number:
                    yield from entries(number, shard)
                    number, shard = n, Filter(log2_buckets=log2_buckets if change == 0 else 4, bits=bits)
                if change == 0:
                    shard.put_back(bucket * SLOTS + slot, [digest, n_bytes, keep, live])
                else:
                    _change(shard, change, digest, n_bytes, keep, live)
        yield from entries(number, shard)
        trim()

    return each


def _combined(rows: DataFrame, shards: int) -> DataFrame:
    """One change per digest and 100,000 rows of a task, so that copies are few before they are shuffled."""
    order = [("digest", "ascending"), ("n_bytes", "ascending"), ("absent", "ascending"), ("doc_id", "ascending"), ("row", "ascending")]

    def least(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.sort_by(order).combine_chunks()
        found = table.group_by(["digest", "n_bytes"], use_threads=False).aggregate([("absent", "first"), ("doc_id", "first"), ("row", "first"), ("row", "count")])
        # "first" passes over nulls: the id of a group without one stays null, as all its ids are
        yield from found.select(["digest", "n_bytes", "absent_first", "doc_id_first", "row_first", "row_count"]).rename_columns(["digest", "n_bytes", "absent", "doc_id", "row", "live"]).to_batches()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= COMBINE_ROWS:
                yield from least(pa.Table.from_batches(held))
                held = []
        if held:
            yield from least(pa.Table.from_batches(held))
        trim()

    flat = rows.select("digest", "n_bytes", F.col("doc_id").isNull().alias("absent"), "doc_id", "row")
    few = flat.mapInArrow(each, "digest binary, n_bytes long, absent boolean, doc_id long, row long, live long")
    keep = F.struct("absent", "doc_id", "row").alias("keep")
    return few.select(_shard_of("digest", shards), F.lit(1).cast("long").alias("change"), "digest", "n_bytes", keep, "live")


def _shard_of(digest: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int").alias("shard")


@dataclass(frozen=True)
class Index:
    """``members``: digest, n_bytes, doc_id, row of every live row; ``entries``: one row per live digest (`ENTRY`)."""

    members: DataFrame
    entries: DataFrame
    shards: int
    bits: int = FINGERPRINT_BITS

    def _next(self, members: DataFrame, changes: DataFrame) -> Index:
        old = self.entries.withColumn("change", F.lit(0).cast("long"))
        both = old.unionByName(changes, allowMissingColumns=True)
        partitions = max(1, min(self.shards, both.sparkSession.sparkContext.defaultParallelism * 8))
        dealt = both.repartition(partitions, "shard").sortWithinPartitions("shard", "change", "digest")
        return Index(members, stash(dealt.mapInArrow(_apply_changes(self.bits), ENTRY), "cuckoo"), self.shards, self.bits)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, digest, n_bytes) of every row; ``row`` numbers the rows of this table."""
    text = normalised()
    return stash(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")), "digests")


def build_index(docs: DataFrame, bits: int = FINGERPRINT_BITS, shards: int | None = None) -> Index:
    """An index of all rows of ``docs`` (doc_id, text); see `digests` for its members."""
    members = digests(docs)
    shards = shards or 1 + members.count() // SHARD_DIGESTS * 2 + members.sparkSession.sparkContext.defaultParallelism
    none = members.sparkSession.createDataFrame([], ENTRY)
    return Index(members, none, shards, bits)._next(members, _combined(members, shards))


def insert_rows(index: Index, docs: DataFrame) -> Index:
    """The index with the rows of ``docs`` too; their ``row`` numbers follow those there are."""
    base = index.members.agg(F.max("row")).head()[0]
    more = digests(docs).withColumn("row", F.col("row") + (0 if base is None else base + 1))
    return index._next(index.members.unionByName(more), _combined(more, index.shards))


def delete_rows(index: Index, docs: DataFrame) -> Index:
    """The index without the rows whose doc_id and normalised text ``docs`` has (null ids too); others are passed over.

    Of a digest that loses a row, the rows left are counted again and the
    smallest stays; a digest without rows leaves its filter.
    """
    gone = digests(docs).select("doc_id", "digest", "n_bytes").distinct()
    same = [index.members[c].eqNullSafe(gone[c]) for c in ("digest", "n_bytes", "doc_id")]
    left = stash(index.members.join(gone, same, "left_anti"), "members")
    touched = gone.select("digest", "n_bytes").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")
    renewed = left.join(touched, ["digest", "n_bytes"], "left_semi").groupBy("digest", "n_bytes").agg(F.min(order).alias("keep"), F.count("*").alias("live"))
    change = touched.join(renewed, ["digest", "n_bytes"], "left").select(_shard_of("digest", index.shards), F.lit(2).cast("long").alias("change"), "digest", "n_bytes", "keep", F.coalesce("live", F.lit(0)).alias("live"))
    return index._next(left, change)


def groups(index: Index) -> DataFrame:
    """One row per live row: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = index.entries.select("digest", "keep", "live")
    rows = index.members.select("doc_id", "row", "digest")
    found = meet(rows, keyed, F.col("live") > hot_limit(rows.count()), "digest")
    return found.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("live").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of blanks is one space.
    The row with the smallest doc_id stays; null ids come last, and of rows
    alike in id and text exactly one is kept. A null text counts as empty;
    texts of blanks only are one space and equal among themselves, not to
    empty ones. Whole texts are digested where they are read, whatever their
    length. An empty table gives no rows; extra columns are left out.
    """
    return groups(build_index(docs))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM t
"""
