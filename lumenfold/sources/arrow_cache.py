"""Token caches as Arrow IPC shards with a global row index.

`write_shards` orders records by split and id, writes each range of them as
Arrow files of fixed batches, and returns a manifest of one row per shard, in
which every shard knows the number of its first row among all. Any row of the
cache is then a shard, a batch and a place by arithmetic, so a reader opens
only the batches it needs, each found by its file's own footer.

`ArrowCache` is the data source: one planned partition per run of batches;
filters on ``row_index`` and ``split`` choose batches before any is opened, and
option ``columns`` the columns that are decoded. `rows_at` fetches rows by
number for a table of numbers.

Files are written under a name of their own by each attempt and count only
once the manifest lists them, so a lost task leaves nothing that is read. Any
store that Arrow's file systems reach will do (local, HDFS, object stores).
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema

from lumenfold.sources.storage import broadcast_if_small, written

#: Rows of a batch, which is read as a whole, and of a shard; batches that one task reads.
BATCH_ROWS, SHARD_ROWS, TASK_BATCHES = 1_024, 65_536, 64
MANIFEST = "_shards.parquet"
FORMAT = "arrow_token_cache"

_SHARD = "part int, seq int, split string, path string, records long, tokens long, first_id string, last_id string, bytes long, sha256 string"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


class _Hashing:
    """A binary sink that hashes what goes through it; at most a batch is held."""

    closed = False

    def __init__(self, sink) -> None:
        self.sink, self.digest, self.size = sink, hashlib.sha256(), 0

    def write(self, data) -> int:
        data = bytes(data)
        self.digest.update(data)
        self.size += len(data)
        self.sink.write(data)
        return len(data)

    def tell(self) -> int:
        return self.size

    def flush(self) -> None:
        self.sink.flush()

    def writable(self) -> bool:
        return True

    def readable(self) -> bool:
        return False

    def seekable(self) -> bool:
        return False

    def close(self) -> None:
        self.closed = True


class _Shard:
    """An open Arrow file: takes rows, writes whole batches of them, and ends as a row of the manifest."""

    def __init__(self, folder: str, part: int, seq: int, split: str, schema: pa.Schema, batch_rows: int) -> None:
        self.store, base = _store(folder)
        self.part, self.seq, self.split, self.batch_rows = part, seq, split, batch_rows
        self.name = f"split={split}/shard-{part:05d}-{seq:05d}-{uuid.uuid4().hex[:12]}.arrow"
        target = f"{base}/{self.name}"
        self.store.create_dir(target.rsplit("/", 1)[0], recursive=True)
        self.file = self.store.open_output_stream(target)
        self.sink = _Hashing(self.file)
        self.writer = pa.ipc.new_file(pa.PythonFile(self.sink, mode="w"), schema)
        self.waiting: list[pa.RecordBatch] = []
        self.held = self.records = self.tokens = 0
        self.first = self.last = None

    def add(self, rows: pa.RecordBatch) -> None:
        ids = rows.column("record_id")
        self.first, self.last = (ids[0].as_py() if self.first is None else self.first), ids[-1].as_py()
        self.records += rows.num_rows
        self.tokens += sum(v or 0 for v in rows.column("token_count").to_pylist())
        self.waiting.append(rows)
        self.held += rows.num_rows
        if self.held >= self.batch_rows:
            self._flush(self.held // self.batch_rows * self.batch_rows)

    def _flush(self, many: int) -> None:
        table = pa.Table.from_batches(self.waiting).combine_chunks()
        for at in range(0, many, self.batch_rows):
            self.writer.write_table(table.slice(at, min(self.batch_rows, many - at)).combine_chunks(), max_chunksize=self.batch_rows)
        self.waiting = table.slice(many).to_batches()
        self.held -= many

    def close(self) -> tuple:
        if self.held:
            self._flush(self.held)
        self.writer.close()
        self.file.close()
        return (self.part, self.seq, self.split, self.name, self.records, self.tokens, self.first, self.last, self.sink.size, self.sink.digest.hexdigest())


def write_shards(records: DataFrame, path: str, batch_rows: int = BATCH_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The manifest of the shards written below ``path``, which must be new.

    ``records`` needs split, record_id and token_count; null splits count as
    ``train``. Repeated ids stay as rows of their own. An empty table is an
    error, as are records that have n-gram features only in part.
    """
    if shard_rows % batch_rows:
        raise ValueError("a shard holds whole batches")
    if records.isEmpty():
        raise ValueError("an empty cache is not written")
    rows = records.withColumn("split", F.coalesce("split", F.lit("train")))
    schema, names = rows.schema, rows.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, shard = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            splits, at = batch.column("split").to_pylist(), 0
            _unmixed(batch)
            while at < batch.num_rows:
                if shard and (shard.split != splits[at] or shard.records >= shard_rows):
                    yield _manifest_rows([shard.close()])
                    seq, shard = seq + 1, None
                if shard is None:
                    shard = _Shard(path, part, seq, splits[at], batch.schema, batch_rows)
                end = at
                while end < batch.num_rows and splits[end] == shard.split and end - at < shard_rows - shard.records:
                    end += 1
                shard.add(batch.slice(at, end - at))
                at = end
        if shard:
            yield _manifest_rows([shard.close()])

    ordered = rows.repartitionByRange("split", "record_id").sortWithinPartitions("split", "record_id", *[c for c in names if c == "content_hash"])
    shards = written(ordered.mapInArrow(each, _SHARD), "shards")
    before = Window.orderBy("split", "part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    manifest = shards.withColumns({"first_row": F.coalesce(F.sum("records").over(before), F.lit(0)), "batch_rows": F.lit(batch_rows)}).drop("part", "seq")
    manifest.coalesce(1).write.parquet(f"{path.rstrip('/')}/{MANIFEST}")
    return records.sparkSession.read.schema(manifest.schema).parquet(f"{path.rstrip('/')}/{MANIFEST}")


def _unmixed(batch: pa.RecordBatch) -> None:
    at = batch.schema.get_field_index("ngram_feature_ids_flat")
    if at >= 0 and 0 < batch.column(at).null_count < batch.num_rows:
        raise ValueError("records with and without n-gram features are not mixed in one cache")


def _manifest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [f.split()[0] for f in _SHARD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


# Reading ------------------------------------------------------------------------


def _manifest(path: str) -> list[dict]:
    store, base = _store(path.rstrip("/"))
    return sorted(pq.read_table(f"{base}/{MANIFEST}", filesystem=store).to_pylist(), key=lambda r: r["first_row"])


def read_batches(path: str, name: str, first_row: int, batch_rows: int, batches: range, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Some batches of one shard with their rows' numbers in front; others are not read."""
    store, base = _store(path.rstrip("/"))
    with store.open_input_file(f"{base}/{name}") as file:
        options = None
        schema = pa.ipc.open_file(file).schema
        if columns is not None:
            options = pa.ipc.IpcReadOptions(included_fields=[schema.get_field_index(c) for c in columns if c in schema.names])
        reader = pa.ipc.open_file(file, options=options)
        for k in batches:
            batch = reader.get_batch(k)
            numbers = pa.array(range(first_row + k * batch_rows, first_row + k * batch_rows + batch.num_rows), pa.int64())
            wanted = [c for c in (columns or batch.schema.names) if c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([numbers, *(batch.column(batch.schema.get_field_index(c)) for c in wanted)], names=["row_index", *wanted])


class BatchRange(InputPartition):
    def __init__(self, shard: dict, first: int, last: int) -> None:
        super().__init__((shard["path"], first, last))
        self.shard, self.first, self.last = {k: shard[k] for k in ("path", "first_row", "batch_rows")}, first, last


class ArrowCacheReader(DataSourceReader):
    """Plans runs of batches; filters on row_index and split leave out whole batches and are evaluated by Spark again."""

    def __init__(self, path: str, columns: list[str] | None, task_batches: int) -> None:
        self.path, self.columns, self.task_batches = path, columns, task_batches
        self.low, self.high, self.rows, self.splits = 0, None, None, None

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if name == "split" and isinstance(f, EqualTo | In):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.splits = found if self.splits is None else self.splits & found
            elif name == "row_index" and isinstance(f, EqualTo | In):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.rows = found if self.rows is None else self.rows & found
            elif name == "row_index" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == "row_index" and isinstance(f, LessThan | LessThanOrEqual):
                end = f.value + isinstance(f, LessThanOrEqual)
                self.high = end if self.high is None else min(self.high, end)
        return filters  # batches hold other rows too

    def partitions(self) -> list[BatchRange]:
        out: list[BatchRange] = []
        wanted = sorted(self.rows) if self.rows is not None else None
        for shard in _manifest(self.path):
            first, size, end = shard["first_row"], shard["batch_rows"], shard["first_row"] + shard["records"]
            if (self.splits is not None and shard["split"] not in self.splits) or end <= self.low or (self.high is not None and first >= self.high):
                continue
            begin, stop = max(0, self.low - first) // size, -(-(min(end, self.high if self.high is not None else end) - first) // size)
            chosen = range(begin, stop)
            if wanted is not None:
                chosen = sorted({(r - first) // size for r in wanted[bisect_right(wanted, first - 1) : bisect_right(wanted, end - 1)]} & set(chosen))
            run: list[int] = []
            for k in chosen:
                if run and (k != run[-1] + 1 or len(run) >= self.task_batches):
                    out.append(BatchRange(shard, run[0], run[-1] + 1))
                    run = []
                run.append(k)
            if run:
                out.append(BatchRange(shard, run[0], run[-1] + 1))
        return out

    def read(self, partition: BatchRange) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            s = partition.shard
            yield from read_batches(self.path, s["path"], s["first_row"], s["batch_rows"], range(partition.first, partition.last), self.columns)


class ArrowCache(DataSource):
    """``spark.read.format("arrow_token_cache").option("columns", "record_id,input_ids").load(path)``: row_index and the cache's columns."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _columns(self) -> list[str] | None:
        found = self.options.get("columns")
        return [c.strip() for c in found.split(",") if c.strip()] if found else None

    def schema(self):
        path = self.options["path"]
        first = _manifest(path)[0]
        store, base = _store(path.rstrip("/"))
        with store.open_input_file(f"{base}/{first['path']}") as file:
            known = pa.ipc.open_file(file).schema
        columns = self._columns() or known.names
        missing = sorted(set(columns) - set(known.names))
        if missing:
            raise ValueError("the cache has no columns " + ", ".join(missing))
        return from_arrow_schema(pa.schema([pa.field("row_index", pa.int64()), *(known.field(c) for c in columns)]))

    def reader(self, schema) -> ArrowCacheReader:
        return ArrowCacheReader(self.options["path"], self._columns(), int(self.options.get("task_batches", TASK_BATCHES)))


def read_shards(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All rows of a cache with their numbers in ``row_index``; filters on row_index and split reach the batches."""
    spark.dataSource.register(ArrowCache)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(FORMAT)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def length(spark: SparkSession, path: str) -> int:
    """How many rows a cache has, by its manifest."""
    return spark.read.parquet(f"{path.rstrip('/')}/{MANIFEST}").agg(F.coalesce(F.sum("records"), F.lit(0))).head()[0]


def rows_at(spark: SparkSession, path: str, wanted: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows of a cache whose numbers ``wanted`` (row_index) names, each as often as it does.

    Negative numbers count from the end; numbers outside the cache are an
    error. Numbers are grouped by batch, and each batch that is asked for is
    read once, by the task that gathers its numbers.
    """
    manifest = spark.read.parquet(f"{path.rstrip('/')}/{MANIFEST}")
    total = length(spark, path)
    kind = read_shards(spark, path, columns).schema
    number = F.when(F.col("row_index") < 0, F.col("row_index") + total).otherwise(F.col("row_index"))
    inside = F.when((number >= 0) & (number < total), number).otherwise(F.raise_error(F.concat(F.lit("the cache has no row "), F.col("row_index").cast("string"))))
    asked = wanted.where("row_index IS NOT NULL").groupBy(inside.cast("long").alias("number")).agg(F.count("*").alias("times"))
    # A row's shard is found by blocks of shard length: each shard is listed under the blocks that it touches.
    width = F.lit(SHARD_ROWS).cast("long")
    listed = manifest.select("path", "first_row", "records", "batch_rows", F.explode(F.sequence(F.floor(F.col("first_row") / width), F.floor((F.col("first_row") + F.col("records") - 1) / width))).alias("block"))
    placed = asked.withColumn("block", F.floor(F.col("number") / width)).join(broadcast_if_small(listed), "block").where("first_row <= number AND number < first_row + records")
    grouped = placed.select("path", "first_row", "batch_rows", F.expr("(number - first_row) div batch_rows").alias("batch"), "number", "times")

    def fetch(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first_row, batch_rows, k = (v.as_py() for v in key)
        numbers = [pair for b in batches for pair in zip(b.column("number").to_pylist(), b.column("times").to_pylist(), strict=True)]
        for rows in read_batches(path, name, first_row, batch_rows, range(k, k + 1), columns):
            begin = first_row + k * batch_rows
            yield rows.take(pa.array([n - begin for n, times in numbers for _ in range(times)], pa.int64()))

    return grouped.groupBy("path", "first_row", "batch_rows", "batch").applyInArrow(fetch, kind)
