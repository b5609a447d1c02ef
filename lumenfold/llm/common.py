"""Shared plumbing of the training-data operators.

* where intermediate tables go (`shared_dir`, `stash`),
* how texts become words, shingles and 64-bit hashes (`words_of`,
  `shingle_set`), identical in every operator and on every executor,
* Arrow helpers that keep Python work on whole batches,
* size-checked broadcasts (`broadcast_if_small`).
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs outside these six characters (0x20, 0x09-0x0D).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
#: Rows that a broadcast side may have; larger sides are shuffled instead.
BROADCAST_ROWS = 500_000

#: A key with more rows than this, and than 1 / HOT_KEYS of all, is hot; so there are never more than HOT_KEYS hot keys.
HOT_ROWS, HOT_KEYS = 256, 400_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CACHE_WORDS = 150_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests, one
    machine) a temporary folder is made and remembered in the session; on a
    cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not set_dir.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = set_dir.get() if set_dir.isDefined() else tempfile.mkdtemp(prefix="lumenfold-")
        if not set_dir.isDefined():
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's part of the shared folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lumenfold/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> bool:
    """Deletes the application's intermediate tables.

    For after a query's result has been written: results are lazy and read
    these tables, so nothing is deleted before the caller says so.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def stash(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts lineage, survives the loss of any executor, and lets later stages
    read only the columns they need.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``F.broadcast(df)`` if a count shows at most ``limit`` rows, else ``df``.

    The count stops one row after the limit, so it costs little on a large
    side; callers pass stashed frames, so nothing is computed twice.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hot_limit(rows: int) -> int:
    """How many rows of one key, of ``rows`` in all, a task may join."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def meet(rows: DataFrame, keyed: DataFrame, hot: Column, key: str | list[str] = "key") -> DataFrame:
    """``rows`` joined with ``keyed``, which has each key once, by ``key``.

    Rows of keys for which ``hot`` holds (a column of ``keyed``, stashed) stay
    where they are and meet a broadcast; so no task gathers such a key.
    """
    hot_keys = F.broadcast(keyed.where(hot))
    cold = rows.join(F.broadcast(keyed.where(hot).select(key)), key, "left_anti").join(keyed.where(~hot), key)
    return rows.join(hot_keys, key).unionByName(cold)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``ids`` (one stashed column doc_id); columns unchanged, null ids stay."""
    gone = fresh(docs, "gone_id")
    return docs.join(broadcast_if_small(ids.withColumnRenamed("doc_id", gone)), docs["doc_id"] == F.col(gone), "left_anti")


def text_digest(col: Column | str = "text") -> Column:
    """MD5 of a text; null as empty."""
    return F.md5(F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit("")))


def without_rows(docs: DataFrame, named: DataFrame, digest: str) -> DataFrame:
    """Rows of ``docs`` (which has a column ``digest``) whose doc_id, null too, and digest ``named`` (stashed gone_doc, gone_text) lacks."""
    return docs.join(broadcast_if_small(named), docs["doc_id"].eqNullSafe(F.col("gone_doc")) & (docs[digest] == F.col("gone_text")), "left_anti")


def id_crc(col: Column | str) -> Column:
    """Unsigned crc32 of an id as text; the rule of every held-out fold."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


def fold_is(col: str, modulus: int, remainder: int) -> Column:
    """True where crc32(id as text) mod ``modulus`` is ``remainder``; null ids: false."""
    return F.coalesce(id_crc(col) % modulus == remainder, F.lit(False))


class WordHash(dict):
    """word bytes -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHash()


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text after lower-casing A-Z."""
    return text.translate(_LOWER).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE_WORDS)]


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hash of each run of five words, in text order; one of all words if fewer."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(n, SHINGLE_WORDS)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total += hashes[i : n - k + 1 + i] * np.uint64(_POWERS[i])
    return mix64(total)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    if not text:
        return np.empty(0, np.uint64)
    return np.unique(shingle_hashes(word_hashes(words_of(text))))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow string column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield fn(batch.slice(at, 512))
        trim()

    return df.mapInArrow(each, schema)


def trim() -> None:
    """Gives a Python worker's unused memory back; workers live on and would hold it beside later stages."""
    _hashes.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_thread() -> None:
    """Native thread pools stay at one thread; Spark's tasks are the parallelism."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
