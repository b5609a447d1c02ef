"""Commands: ``python -m lumenfold dataset|inputs|query ...``.

Each prints one JSON value. The exit code is 0, or 1 where a check found
problems or a command failed.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lumenfold.operators import integrity
from lumenfold.plans import inputs, registry
from lumenfold.plans.build import Build
from lumenfold.sources import readers


def _pages(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, page, text) from Parquet, or from JSON lines."""
    if path.endswith((".json", ".jsonl")):
        return readers.json_lines(spark, path, "source_id string, page int, text string")
    return spark.read.parquet(path)


def dataset_build(spark: SparkSession, a: argparse.Namespace) -> Any:
    return Build(spark, a.output, readers.load_yaml(a.config, "build")).run()


def dataset_status(spark: SparkSession, a: argparse.Namespace) -> Any:
    record = json.loads((Path(a.folder) / "build.json").read_text(encoding="utf-8"))
    return {k: record[k] for k in ("build_id", "state", "updated_at", "error", "summary") if k in record}


def dataset_freeze(spark: SparkSession, a: argparse.Namespace) -> Any:
    completed = dataset_status(spark, a)["state"] == "COMPLETED"
    examples = spark.read.json(f"{a.folder}/exports") if completed else spark.range(0).toDF("split")
    return integrity.freeze(examples, a.release, a.id, {"build completed": completed}, "split")


def inputs_build(spark: SparkSession, a: argparse.Namespace) -> Any:
    return inputs.build(spark, _pages(spark, a.pages), a.output, limit=a.chunk_max_chars, validation_percent=a.validation_percent)


def inputs_verify(spark: SparkSession, a: argparse.Namespace) -> Any:
    return {"problems": inputs.verify(spark, a.folder)}


def inputs_freeze(spark: SparkSession, a: argparse.Namespace) -> Any:
    return inputs.freeze(spark, a.folder, a.release, a.id)


def verify_release(spark: SparkSession, a: argparse.Namespace) -> Any:
    return {"problems": integrity.verify_release(spark, a.folder)}


def query_list(spark: SparkSession, a: argparse.Namespace) -> Any:
    return sorted(registry.QUERIES)


def query_run(spark: SparkSession, a: argparse.Namespace) -> Any:
    registry.QUERIES[a.name](spark, a.tables).write.mode("errorifexists").parquet(a.output)
    return {"query": a.name, "output": a.output}


#: (group, command) -> (function, arguments); an argument with a default is an option.
COMMANDS: dict[tuple[str, str], tuple[Callable[[SparkSession, argparse.Namespace], Any], dict[str, Any]]] = {
    ("dataset", "build"): (dataset_build, {"config": None, "output": None}),
    ("dataset", "status"): (dataset_status, {"folder": None}),
    ("dataset", "freeze"): (dataset_freeze, {"folder": None, "release": None, "id": None}),
    ("dataset", "verify-release"): (verify_release, {"folder": None}),
    ("inputs", "build"): (inputs_build, {"pages": None, "output": None, "chunk-max-chars": 6000, "validation-percent": 10}),
    ("inputs", "verify-cache"): (inputs_verify, {"folder": None}),
    ("inputs", "freeze"): (inputs_freeze, {"folder": None, "release": None, "id": None}),
    ("inputs", "verify-release"): (verify_release, {"folder": None}),
    ("query", "list"): (query_list, {}),
    ("query", "run"): (query_run, {"name": None, "tables": None, "output": None}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumenfold")
    groups = top.add_subparsers(dest="group", required=True)
    made: dict[str, Any] = {}
    for (group, command), (run, arguments) in COMMANDS.items():
        if group not in made:
            made[group] = groups.add_parser(group).add_subparsers(dest="command", required=True)
        own = made[group].add_parser(command)
        own.set_defaults(run=run)
        for name, default in arguments.items():
            if default is None:
                own.add_argument(name)
            else:
                own.add_argument(f"--{name}", type=type(default), default=default)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("lumenfold").getOrCreate()
    try:
        found = a.run(spark, a)
    except Exception as e:
        print(f"{type(e).__name__}: {str(e)[:500]}", file=sys.stderr)
        return 1
    print(json.dumps(found, ensure_ascii=False, sort_keys=True, default=str))
    return 1 if isinstance(found, dict) and found.get("problems") else 0
