"""Arrow shards: global numbers, batches that are left out, columns, errors, manifests."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from lumenfold.sources import arrow_cache
from lumenfold.sources.arrow_cache import ArrowCacheReader, read_shards, rows_at, write_shards


@pytest.fixture(scope="module")
def cache(spark, tmp_path_factory):
    rows = [(f"r{i:05d}", ["train", "validation", None][i % 3], i % 7, [i, i + 1], [i] * (i % 4)) for i in range(1000)]
    df = spark.createDataFrame(rows, "record_id string, split string, token_count int, input_ids array<int>, labels array<int>")
    path = f"file://{tmp_path_factory.mktemp('arrow')}/cache"
    manifest = write_shards(df.repartition(5), path, batch_rows=16, shard_rows=64)
    want = sorted((("validation" if r[1] == "validation" else "train"), r[0], r[2], r[3], r[4]) for r in rows)
    return path, [m.asDict() for m in manifest.orderBy("first_row").collect()], want


def test_numbers_are_global_and_in_order(spark, cache):
    path, manifest, want = cache
    got = read_shards(spark, path).orderBy("row_index").collect()
    assert [(r["split"], r["record_id"], r["token_count"], r["input_ids"], r["labels"]) for r in got] == want and [r["row_index"] for r in got] == list(range(1000))
    assert [m["first_row"] for m in manifest] == [sum(m["records"] for m in manifest[:k]) for k in range(len(manifest))]
    assert all(m["records"] <= 64 for m in manifest) and {m["split"] for m in manifest} == {"train", "validation"}


def test_manifest_says_what_the_files_are(cache):
    path, manifest, _ = cache
    for m in manifest:
        raw = Path(path.removeprefix("file://"), m["path"]).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (m["bytes"], m["sha256"])
        table = pa.ipc.open_file(pa.BufferReader(raw)).read_all()
        assert (table.num_rows, sum(table["token_count"].to_pylist())) == (m["records"], m["tokens"])
        assert (table["record_id"][0].as_py(), table["record_id"][-1].as_py()) == (m["first_id"], m["last_id"])


def test_filters_leave_out_batches(cache):
    path, manifest, _ = cache

    def planned(*filters):
        reader = ArrowCacheReader(path, None, 64)
        assert reader.pushFilters(list(filters)) == list(filters)
        return [(p.shard["path"], k) for p in reader.partitions() for k in range(p.first, p.last)]

    everything = planned()
    assert len(everything) == sum(-(-m["records"] // 16) for m in manifest)
    assert len(planned(EqualTo(("row_index",), 500))) == 1 and planned(EqualTo(("row_index",), 5000)) == [] and planned(EqualTo(("row_index",), -1)) == []
    assert len(planned(In(("row_index",), (3, 5, 999)))) == 2
    assert len(planned(GreaterThanOrEqual(("row_index",), 100), LessThan(("row_index",), 101))) == 1
    assert {p for p, _ in planned(EqualTo(("split",), "validation"))} == {m["path"] for m in manifest if m["split"] == "validation"}


def test_other_batches_are_not_read(spark, cache, tmp_path):
    """With every other shard gone from disk, the row is still found."""
    path, manifest, want = cache
    home = Path(path.removeprefix("file://"))
    hidden = []
    keep = next(m for m in manifest if m["first_row"] <= 700 < m["first_row"] + m["records"])
    for m in manifest[1:]:  # the first one tells the schema
        if m["path"] != keep["path"]:
            hidden.append((home / m["path"], tmp_path / m["path"].replace("/", "_")))
            hidden[-1][0].rename(hidden[-1][1])
    try:
        assert [r["record_id"] for r in read_shards(spark, path).where("row_index = 700").collect()] == [want[700][1]]
        assert [r["record_id"] for r in rows_at(spark, path, spark.createDataFrame([(700,), (-300,)], "row_index long")).collect()] == [want[700][1]] * 2
    finally:
        for there, away in hidden:
            away.rename(there)


def test_rows_at_any_numbers(spark, cache):
    path, _, want = cache
    asked = [0, 999, -1, 17, 17, 500, -1000]
    got = rows_at(spark, path, spark.createDataFrame([(a,) for a in asked] + [(None,)], "row_index long"), ["record_id", "labels"])
    assert got.columns == ["row_index", "record_id", "labels"]
    assert sorted((r["row_index"], r["record_id"], r["labels"]) for r in got.collect()) == sorted((a % 1000, want[a][1], want[a][4]) for a in asked)
    for bad in (1000, -1001):
        with pytest.raises(PySparkException):
            rows_at(spark, path, spark.createDataFrame([(bad,)], "row_index long")).collect()


def test_columns_and_errors(spark, cache, tmp_path):
    path, _, _ = cache
    assert read_shards(spark, path, ["token_count"]).columns == ["row_index", "token_count"]
    assert read_shards(spark, path, ["token_count"]).agg(F.sum("token_count")).head()[0] == sum(i % 7 for i in range(1000))
    with pytest.raises(PySparkException):
        read_shards(spark, path, ["nothing"]).collect()
    none = spark.createDataFrame([], "record_id string, split string, token_count int")
    with pytest.raises(ValueError):
        write_shards(none, f"file://{tmp_path}/none")
    mixed = spark.createDataFrame([("a", "train", 1, [1]), ("b", "train", 1, None)], "record_id string, split string, token_count int, ngram_feature_ids_flat array<int>").coalesce(1)
    with pytest.raises(PySparkException):
        write_shards(mixed, f"file://{tmp_path}/mixed")
    assert arrow_cache.length(spark, path) == 1000
