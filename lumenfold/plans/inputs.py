"""Model inputs: pages become chunked records, token caches and a sealed manifest.

Below one folder lie ``corpus`` (records as JSON lines in record order),
``cache`` (token records by split) and ``manifest``. The manifest lists every
cache file with size and hash and the totals of each split; ``verify`` holds
the folder against it, ``freeze`` accepts only a folder without problems.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.hashing import json_string, stable_hash
from lumenfold.functions.tokenizer import Requirements, Tokenizer, capabilities, tokenize, word_tokenizer
from lumenfold.operators import corpus, integrity
from lumenfold.sources import readers, writers
from lumenfold.sources.storage import checkpoint


def token_records(records: DataFrame, factory: Callable[[], Tokenizer] = word_tokenizer) -> DataFrame:
    """Token records of corpus records: every token is trained, the hash covers id, tokens and labels."""
    cut = records.select("record_id", "split", tokenize(factory)("text").alias("tokens")).select("record_id", "split", F.col("tokens.ids").alias("input_ids"))
    ids = F.to_json("input_ids")
    return cut.select(
        "record_id", "split", F.lit("cpt").alias("source_kind"), F.size("input_ids").alias("token_count"), F.size("input_ids").alias("supervised_token_count"), "input_ids", F.col("input_ids").alias("labels"),
        stable_hash(json_string(F.col("record_id")), ids, ids).alias("content_hash"),
    )


def build(spark: SparkSession, pages: DataFrame, folder: str, factory: Callable[[], Tokenizer] = word_tokenizer, limit: int = 6000, validation_percent: int = 10) -> dict[str, Any]:
    """Writes corpus, cache and manifest of (source_id, page, text) and returns the manifest; no records are an error."""
    able = capabilities(factory)
    Requirements().for_plain_text().check(able)
    records = checkpoint(corpus.records_of(pages, limit, validation_percent))
    rows = writers.write_cache(token_records(records, factory), f"{folder}/cache").orderBy("split").collect()  # one row per split
    writers.write_json_lines(records, f"{folder}/corpus", F.coalesce("source_id", F.lit("")), F.coalesce("chunk_id", F.lit("")), "record_id")
    files = integrity.file_records(spark, f"{folder}/cache").orderBy("path").collect()
    manifest = integrity.sealed({
        "status": "BUILT", "chunk_max_chars": limit, "validation_percent": validation_percent, "tokenizer": able, "records": records.count(),
        "splits": [r.asDict() for r in rows], "files": [r.asDict() for r in files if _is_data(r["path"])],
    })
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest


def manifest_of(spark: SparkSession, folder: str) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{folder}/manifest").first()["value"])


def verify(spark: SparkSession, folder: str) -> list[str]:
    """Problems of a built folder: its seal, its files, its totals, and hashes of records."""
    manifest = manifest_of(spark, folder)
    problems = [] if integrity.seal_holds(manifest) else ["seal"]
    listed = spark.createDataFrame([(f["path"], f["bytes"], f["sha256"]) for f in manifest["files"]], "path string, bytes long, sha256 string")
    found = [f"{r['path']}: {r['problem']}" for r in integrity.verify_files(listed, integrity.file_records(spark, f"{folder}/cache")).orderBy("path").collect()]
    if found:
        return problems + found  # damaged files are not read as tables
    cache = readers.read_cache(spark, f"{folder}/cache")
    stats = [r.asDict() for r in writers.shard_statistics(cache).orderBy("split").collect()]
    problems += [] if stats == manifest["splits"] else ["splits"]
    ids, labels = F.to_json("input_ids"), F.to_json("labels")
    wrong = cache.where((stable_hash(json_string(F.col("record_id")), ids, labels) != F.col("content_hash")) | (F.size("input_ids") != F.col("token_count"))).count()
    return problems + ([f"{wrong} records differ from their hash or length"] if wrong else [])


def freeze(spark: SparkSession, folder: str, release: str, release_id: str) -> dict[str, Any]:
    """A release of a built folder's cache, by split; a folder with problems is refused."""
    problems = verify(spark, folder)
    return integrity.freeze(readers.read_cache(spark, f"{folder}/cache") if not problems else spark.range(0).toDF("record_id"), release, release_id, {"cache verified": not problems}, "split")


def _is_data(path: str) -> bool:
    return not path.rsplit("/", 1)[-1].startswith(("_", "."))
