"""Sinks: JSON lines, partitioned examples, token caches, step metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.canonical import canonical_row
from lumenfold.operators.integrity import file_records


def write_json_lines(df: DataFrame, path: str, *order: str | Column) -> DataFrame:
    """One canonical JSON object per line, keys in order at every depth, in the given order of rows.

    An existing path is replaced when all is written. Returns (path, records,
    bytes, sha256) of every file written.
    """
    rows = df.orderBy(*order) if order else df
    rows.select(canonical_row(df.schema).alias("value")).write.mode("overwrite").text(path)
    spark, name = df.sparkSession, F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0)
    lines = spark.read.text(path).groupBy(name.alias("path")).agg(F.count("*").alias("records"))
    files = file_records(spark, path).where(~F.col("path").startswith("_") & ~F.col("path").startswith("."))
    return files.join(lines, "path", "left").select("path", F.coalesce("records", F.lit(0)).alias("records"), "bytes", "sha256")


def write_examples(examples: DataFrame, path: str) -> None:
    """Examples by split and family, each folder ordered by example id."""
    ordered = examples.repartition("split", "dataset_family").sortWithinPartitions("split", "dataset_family", "example_id")
    ordered.write.mode("overwrite").partitionBy("split", "dataset_family").json(path)


def write_cache(records: DataFrame, path: str, per_file: int = 100_000) -> DataFrame:
    """Token records by split, ordered by id; returns the shard statistics of each split.

    Ranges of (split, record_id) rather than one task per split: a large split
    is written by many tasks. Empty input is an error.
    """
    if records.isEmpty():
        raise ValueError("an empty cache is not written")
    ordered = records.repartitionByRange("split", "record_id").sortWithinPartitions("split", "record_id")
    ordered.write.mode("overwrite").option("maxRecordsPerFile", per_file).partitionBy("split").parquet(path)
    return shard_statistics(records.sparkSession.read.parquet(path))


def shard_statistics(records: DataFrame) -> DataFrame:
    return records.groupBy("split").agg(F.count("*").alias("records"), F.sum("token_count").alias("tokens"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"))


def shard_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(split, path, records, tokens, first_id, last_id, bytes, sha256) of every file of a cache."""
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/)?[^/]+$", 0)
    rows = spark.read.parquet(path).select(name.alias("path"), "split", "token_count", "record_id")
    inside = rows.groupBy("path", "split").agg(F.count("*").alias("records"), F.sum("token_count").alias("tokens"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"))
    files = file_records(spark, path).withColumn("path", F.regexp_extract("path", "([^/]+/)?[^/]+$", 0))
    return inside.join(files, "path")


def append_metrics(steps: DataFrame, path: str) -> None:
    steps.write.mode("append").json(path)
