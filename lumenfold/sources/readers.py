"""Sources: record files, registries, page texts, token caches."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.operators.export import conversation_problem
from lumenfold.sources.pdf_pages import pdf_pages

CORPUS = "record_id string, id string, example_id string, text string, split string, source_id string, chunk_id string, metadata map<string,string>"
DIALOGUE = "record_id string, id string, example_id string, messages array<struct<role:string,content:string>>, split string, dataset_family string, task_id string, metadata map<string,string>"


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a given schema; blank lines are skipped, a malformed one fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines of one text file with their numbers from 1; blank ones are left out."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("pos", "value")).select((F.col("pos") + 1).alias("line"), "value").where(F.trim("value") != "")


def corpus_records(raw: DataFrame) -> DataFrame:
    """record_id, text, split, source_id, chunk_id; ids and places from wherever a row has them."""
    meta = lambda k: F.col("metadata")[k]
    return raw.select(
        first_filled(F.col("record_id"), F.col("id"), F.col("example_id")).alias("record_id"), "text", F.coalesce(first_filled(F.col("split")), meta("split"), F.lit("train")).alias("split"),
        F.coalesce(first_filled(F.col("source_id")), meta("source_id")).alias("source_id"), F.coalesce(first_filled(F.col("chunk_id")), meta("chunk_id")).alias("chunk_id"),
    )


def dialogue_records(raw: DataFrame) -> DataFrame:
    """record_id, messages, split, metadata, problem; family and task join the metadata."""
    own = F.map_filter(F.create_map(F.lit("dataset_family"), F.col("dataset_family"), F.lit("task_id"), F.col("task_id")), lambda _, v: v.isNotNull())
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(own, k)), own)
    record_id = first_filled(F.col("record_id"), F.col("id"), F.col("example_id"))
    problem = F.when(record_id.isNull(), "no id").otherwise(conversation_problem(F.col("messages")))
    return raw.select(record_id.alias("record_id"), "messages", F.coalesce(first_filled(F.col("split")), F.col("metadata")["split"], F.lit("train")).alias("split"), merged.alias("metadata"), problem.alias("problem"))


def pages_of(spark: SparkSession, folder: str, extract: Callable[[bytes], Iterable[str]] | None = None, suffix: str = ".pdf") -> DataFrame:
    """(source_id, page, text) of the non-blank pages of binary files, numbered from 1.

    ``extract`` turns a file's bytes into page texts and is the place for
    another document library; without it the library's own reader is used,
    whose unreadable pages are left out here (`pdf_pages` has them as rows).
    """
    if extract is None:
        pages = pdf_pages(spark, folder, suffix).where("error IS NULL").select("source_id", "page", "text")
    else:

        @F.arrow_udf(T.ArrayType(T.StringType()))
        def texts(contents: pa.Array) -> pa.Array:
            return pa.array([list(extract(c.as_py())) for c in contents], pa.list_(pa.string()))

        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(folder)
        name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")
        pages = files.select(name.alias("source_id"), F.posexplode(texts("content")).alias("pos", "text")).select("source_id", (F.col("pos") + 1).alias("page"), "text")
    return pages.where(F.coalesce(F.trim("text"), F.lit("")) != "")


# Registries (driver-side configuration) -------------------------------------


def load_yaml(path: str | Path, section: str | None = None) -> Any:
    """A YAML file, or its one section if it has that key."""
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    return data[section] if section and isinstance(data, dict) and section in data else data


def registry(spark: SparkSession, paths: Iterable[str | Path], section: str, key: str | tuple[str, ...], schema: str) -> DataFrame:
    """Rows of a list section of several files; of rows with one key the last wins."""
    keys, rows = (key,) if isinstance(key, str) else key, {}
    for path in paths:
        for row in load_yaml(path, section) or []:
            rows[tuple(row[k] for k in keys)] = row
    kind = T._parse_datatype_string(schema)
    return spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in rows.values()], kind)


def strict(row: dict[str, Any], known: Iterable[str]) -> dict[str, Any]:
    """A manifest row; unknown keys are an error."""
    extra = set(row) - set(known)
    if extra:
        raise ValueError("unknown keys: " + ", ".join(sorted(extra)))
    return row


# Token caches -----------------------------------------------------------------


def read_cache(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Cached token records; a split reads only its own folder. A split without rows is an error."""
    rows = spark.read.parquet(path)
    if split is None:
        return rows
    own = rows.where(F.col("split") == split)
    if own.isEmpty():
        raise ValueError(f"no shard holds the split {split}")
    return own
