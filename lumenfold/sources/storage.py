"""Where plans cut their lineage, and small driver-side files."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a broadcast side may have; larger sides are shuffled instead.
BROADCAST_ROWS = 500_000


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is made only where none is set and the master is local."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="lumenfold-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors, keeps columns apart."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``F.broadcast(df)`` if a count, which stops one row later, shows at most ``limit`` rows, else ``df``."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from rows at hand, as part of the plan: ``createDataFrame`` of a list starts Python workers wherever it is read."""
    kind = T.StructType.fromDDL(schema)
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps([_named(r, kind) for r in rows])), T.ArrayType(kind))))


def _named(value: Any, kind: T.DataType) -> Any:
    if isinstance(kind, T.StructType) and value is not None:
        return {f.name: _named(v, f.dataType) for f, v in zip(kind, value, strict=True)}
    if isinstance(kind, T.ArrayType) and value is not None:
        return [_named(v, kind.elementType) for v in value]
    return value


def canonical_json(value: Any) -> str:
    """Sorted keys, no blanks, UTF-8; other types by their text."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


def content_hash(*parts: Any) -> str:
    """SHA-256 of the JSON array of parts."""
    return hashlib.sha256(canonical_json(list(parts)).encode()).hexdigest()


def content_int(*parts: Any, bits: int = 64) -> int:
    return int(content_hash(*parts)[: bits // 4], 16)


def write_text(path: str | os.PathLike, text: str) -> Path:
    """Write beside the target, then rename: readers see the old file or the new one."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=target.name)
    with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
        f.write(text)
    os.replace(name, target)
    return target


def write_json(path: str | os.PathLike, value: Any) -> Path:
    return write_text(path, json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, default=str) + "\n")


def write_summary(folder: str | os.PathLike, summary: dict[str, Any], title: str = "Build summary") -> tuple[Path, Path]:
    """The summary as JSON and as a Markdown table."""
    lines = [f"# {title}", "", "| Measure | Value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in sorted(summary.items()))]
    return write_json(Path(folder) / "summary.json", summary), write_text(Path(folder) / "summary.md", "\n".join(lines) + "\n")
