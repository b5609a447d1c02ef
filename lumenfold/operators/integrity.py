"""Integrity: file manifests, verification, freezes, configuration diffs, releases."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.sources.storage import canonical_json, content_hash, written


#: Bytes that are read at a time, and that one task hashes if files are smaller.
PIECE, TASK_BYTES = 1 << 20, 256 << 20


def file_records(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder; paths relative to it.

    Files are listed without their content, dealt to tasks by size, and read
    there in pieces of 1 MiB through the hash, so a file of any size needs
    one piece of memory. Stores that Arrow's file systems don't know are read
    by Spark, a file a row, which holds files of up to 2 GB.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace(F.col("path"), "^.*?" + _quoted(base) + "/", "").alias("path")
    if not _streams(base if root.toUri().getScheme() is None else root.toString()):
        return files.select(path, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    listed = files.select(path, F.col("path").alias("uri"), F.col("length").alias("bytes"))
    sizes = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).head()
    tasks = max(1, min(sizes["n"], max(spark.sparkContext.defaultParallelism, sizes["bytes"] // TASK_BYTES)))
    # Largest first, round and round: tasks get nearly equal bytes. One row a file.
    dealt = listed.withColumn("turn", (F.row_number().over(Window.orderBy(F.desc("bytes"), "path")) - 1) % tasks)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([stream_hash(uri) for uri in batch.column("uri").to_pylist()], pa.string())
            yield pa.record_batch([batch.column("path"), batch.column("bytes"), found], names=["path", "bytes", "sha256"])

    out = dealt.repartition(tasks, "turn").select("path", "uri", "bytes").mapInArrow(hashed, "path string, bytes long, sha256 string")
    names = files.inputFiles()
    if len(names) == sizes["n"]:
        return out
    # A scan passes over empty files.
    every = spark.createDataFrame([(unquote(n),) for n in names], "path string").select(path)
    return out.unionByName(every.join(listed, "path", "left_anti").select("path", F.lit(0).cast("long").alias("bytes"), F.lit(hashlib.sha256(b"").hexdigest()).alias("sha256")))


def _streams(uri: str) -> bool:
    try:
        pafs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def stream_hash(uri: str) -> str:
    """SHA-256 of a file, read in pieces. Paths are taken as they stand, whatever characters they have."""
    scheme, place, path = re.fullmatch("(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/]*))?(.*)", uri, re.DOTALL).groups()
    store, base = (pafs.LocalFileSystem(), "") if scheme in (None, "file") else pafs.FileSystem.from_uri(f"{scheme}://{place or ''}/")
    digest = hashlib.sha256()
    with store.open_input_stream(base.rstrip("/") + path) as file:
        while piece := file.read(PIECE):
            digest.update(piece)
    return digest.hexdigest()


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def verify_files(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Files of a manifest that are missing or differ in size or hash (case of hex digits aside)."""
    there = actual.select("path", F.col("bytes").alias("b"), F.lower("sha256").alias("s"))
    what = F.when(F.col("b").isNull(), "missing").when(F.col("b") != F.col("bytes"), "size").when(F.col("s") != F.lower("sha256"), "hash")
    return manifest.join(there, "path", "left").select("path", what.alias("problem")).where("problem IS NOT NULL")


def tree_hash(files: DataFrame) -> str:
    """One hash for a set of files: of their (path, sha256) pairs in path order; manifests are small."""
    rows = files.select("path", F.lower("sha256").alias("sha256")).orderBy("path").collect()
    return content_hash([[r["path"], r["sha256"]] for r in rows])


def sealed(manifest: dict[str, Any], field: str = "content_hash") -> dict[str, Any]:
    """A manifest with the hash of all its other fields."""
    rest = {k: v for k, v in manifest.items() if k != field}
    return rest | {field: content_hash(rest)}


def seal_holds(manifest: dict[str, Any], field: str = "content_hash") -> bool:
    return manifest.get(field) == sealed(manifest, field)[field]


def same_build(candidate: dict[str, Any], other: dict[str, Any], keys: tuple[str, ...]) -> list[str]:
    """Keys on which two builds differ."""
    return [k for k in keys if candidate.get(k) != other.get(k)]


def flatten(config: Any, prefix: str = "") -> dict[str, str]:
    """dotted path -> JSON of the leaf; an empty mapping is a leaf."""
    if isinstance(config, dict) and config:
        out: dict[str, str] = {}
        for k, v in config.items():
            out |= flatten(v, f"{prefix}.{k}" if prefix else str(k))
        return out
    return {prefix: canonical_json(config)}


#: Levels of objects that are opened within a row before leaves are written.
LEVELS = 3


def leaves(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value) of every leaf of JSON documents: dotted path and canonical JSON.

    A document is parsed once and ``LEVELS`` levels of objects are opened
    within its row; what is deeper is written with the leaves and opened in
    further rounds, which read nothing else. Arrays and empty objects are
    leaves. Text that is no JSON, and null, give no leaves; a bare value is
    one with an empty path.
    """
    open_, kept = documents.select(F.col(key), F.lit("").alias("path"), F.col(text).alias("value")), None
    nested = F.col("value").startswith("{") & (F.col("value") != "{}")
    while True:
        found = written(_opened(open_, key), "leaves")
        open_ = found.where(nested)
        done = open_.isEmpty()
        own = found if done else found.where(~nested)
        kept = own if kept is None else kept.unionByName(own)
        if done:
            return kept


def _opened(documents: DataFrame, key: str) -> DataFrame:
    """(key, path, value) of JSON values below a path, objects opened ``LEVELS`` times."""
    rows = documents.select(key, "path", F.try_parse_json("value").alias("v"))
    for _ in range(LEVELS):
        fields = rows.select(key, "path", "v", F.try_variant_get("v", "$", "map<string,variant>").alias("fields"))
        itself = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("v").alias("value")))
        below = fields.select(F.col(key), "path", F.explode(F.when(F.size("fields") > 0, F.map_entries("fields")).otherwise(itself)).alias("field"))
        name = F.col("field.key")
        path = F.when(name.isNull(), F.col("path")).otherwise(F.concat("path", F.when(F.col("path") == "", "").otherwise("."), name))
        rows = below.select(key, path.alias("path"), F.col("field.value").alias("v"))
    return rows.select(key, "path", F.to_json("v").alias("value")).where("value IS NOT NULL")


def differing_paths(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """(by, path, change) of two tables (by, path, value): added, removed or changed."""
    keys = [*by, "path"]
    a, b = left.select(*keys, F.col("value").alias("a"), F.lit(True).alias("in_a")), right.select(*keys, F.col("value").alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")


def one_variable_changed(diff: DataFrame, allowed: str) -> DataFrame:
    """Differences outside the one path that may change; must be empty."""
    return diff.where((F.col("path") != allowed) & ~F.col("path").startswith(allowed + "."))


class ReleaseError(RuntimeError):
    pass


def audit_sources(registry: DataFrame, actual: DataFrame) -> DataFrame:
    """Sources of a registry (source_id, raw_path, sha256) whose file is missing or has another hash: (source_id, code, severity).

    A registry entry without a hash, or with the placeholder, only has to be there.
    """
    there = actual.select(F.col("path").alias("raw_path"), F.lower("sha256").alias("s"))
    known = F.col("sha256").isNotNull() & ~F.col("sha256").isin("", "REPLACE_ME")
    code = F.when(F.col("s").isNull(), "SRC-MISSING-RAW").when(known & (F.col("s") != F.lower("sha256")), "SRC-HASH-MISMATCH")
    found = registry.join(there, "raw_path", "left").select("source_id", code.alias("code")).where("code IS NOT NULL")
    return found.withColumn("severity", F.when(F.col("code") == "SRC-MISSING-RAW", "ERROR").otherwise("FATAL"))


def stale(stored: DataFrame, recomputed: DataFrame, key: str, hashes: tuple[str, ...] = ("content", "semantic", "structural")) -> DataFrame:
    """(key, part, problem): hashes of stored rows that a recomputation does not confirm, and rows on one side only."""
    a = stored.select(key, F.struct(*hashes).alias("a"))
    b = recomputed.select(key, F.struct(*hashes).alias("b"))
    both = a.join(b, key, "full_outer")
    lone = F.when(F.col("a").isNull(), "missing stored").when(F.col("b").isNull(), "missing recomputed")
    differing = [F.when(~F.col("a")[h].eqNullSafe(F.col("b")[h]), F.struct(F.lit(h).alias("part"), F.lit("different").alias("problem"))) for h in hashes]
    alone = F.array(F.struct(F.lit("row").alias("part"), lone.alias("problem")))
    return both.select(key, F.inline(F.when(lone.isNotNull(), alone).otherwise(F.filter(F.array(*differing), lambda x: x.isNotNull()))))


def freeze(df: DataFrame, folder: str, release_id: str, evidence: dict[str, bool] | None = None, *partition_by: str) -> dict[str, Any]:
    """Write a table as a release that is never overwritten, and its sealed manifest.

    Every piece of evidence must hold. All is written and hashed in a staging
    folder beside the release and then renamed, so a crash leaves no half
    release; what an earlier crash left in staging goes. The manifest lists
    each file with size and hash; ``verify_release`` checks a release by it.
    """
    missing = [k for k, ok in (evidence or {}).items() if not ok]
    if missing:
        raise ReleaseError("evidence is missing: " + ", ".join(missing))
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    target = path(folder)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise ReleaseError(f"the release exists already: {folder}")
    staging = path(path(target.getParent(), ".staging"), target.getName())
    files.delete(staging, True)
    place = staging.toString()
    df.write.partitionBy(*partition_by).parquet(f"{place}/data")
    listed = file_records(spark, f"{place}/data").orderBy("path").collect()
    manifest = sealed({"release_id": release_id, "status": "FROZEN", "files": [r.asDict() for r in listed], "records": spark.read.schema(df.schema).parquet(f"{place}/data").count()})
    spark.createDataFrame([(content_hash(release_id), json.dumps(manifest))], "id string, manifest string").coalesce(1).write.json(f"{place}/manifest")
    if not files.rename(staging, target):
        raise ReleaseError(f"the release could not be moved to {folder}")
    return manifest


def verify_release(spark: SparkSession, folder: str) -> list[str]:
    """Problems of a frozen release; none if it is whole."""
    manifest = json.loads(spark.read.json(f"{folder}/manifest").first()["manifest"])
    problems = [] if manifest.get("status") == "FROZEN" else ["status"]
    problems += [] if seal_holds(manifest) else ["seal"]
    listed = spark.createDataFrame([(f["path"], f["bytes"], f["sha256"]) for f in manifest["files"]], "path string, bytes long, sha256 string")
    return problems + [f"{r['path']}: {r['problem']}" for r in verify_files(listed, file_records(spark, f"{folder}/data")).orderBy("path").collect()]
