"""Model inputs and commands, from pages and configurations to releases."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lumenfold import cli
from lumenfold.operators import clusters, integrity, sequences
from lumenfold.plans import inputs, rule_plans


def _run(capsys, spark, *arguments):
    code = cli.main([str(a) for a in arguments], spark)
    out = capsys.readouterr()
    return code, json.loads(out.out) if out.out else out.err


def test_inputs(spark, tmp_path, capsys):
    pages = tmp_path / "pages.jsonl"
    rows = [{"source_id": f"S{i}", "page": 1, "text": f"Line {i} é\n\n" + "word " * 300} for i in range(30)]
    pages.write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    built = tmp_path / "built"
    code, manifest = _run(capsys, spark, "inputs", "build", pages, built, "--chunk-max-chars", 600)
    assert code == 0 and manifest["records"] == sum(s["records"] for s in manifest["splits"]) >= 60
    lines = [json.loads(x) for p in sorted((built / "corpus").glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]
    keys = [(r["source_id"], r["chunk_id"], r["record_id"]) for r in lines]
    assert keys == sorted(keys) and len(keys) == manifest["records"]
    assert _run(capsys, spark, "inputs", "verify-cache", built) == (0, {"problems": []})
    code, frozen = _run(capsys, spark, "inputs", "freeze", built, tmp_path / "release", "R1")
    assert code == 0 and frozen["records"] == manifest["records"]
    assert _run(capsys, spark, "inputs", "verify-release", tmp_path / "release") == (0, {"problems": []})
    victim = next((built / "cache").rglob("*.parquet"))
    victim.unlink()
    code, found = _run(capsys, spark, "inputs", "verify-cache", built)
    assert code == 1 and len(found["problems"]) == 1 and found["problems"][0].endswith("missing")
    code, error = _run(capsys, spark, "inputs", "freeze", built, tmp_path / "other", "R2")
    assert code == 1 and "cache verified" in error and not (tmp_path / "other").exists()


def test_inputs_edges(spark, tmp_path):
    none = spark.createDataFrame([], "source_id string, page int, text string")
    with pytest.raises(ValueError, match="empty"):
        inputs.build(spark, none, str(tmp_path / "none"))
    import random

    with pytest.raises(ValueError, match="deterministic"):
        inputs.build(spark, none, str(tmp_path / "none"), lambda: lambda text: ([random.getrandbits(60)], [(0, len(text))]))
    page = spark.createDataFrame([("S", 1, None), ("S", 2, "one")], "source_id string, page int, text string")
    manifest = inputs.build(spark, page, str(tmp_path / "one"))
    assert manifest["records"] == 1 and inputs.verify(spark, str(tmp_path / "one")) == []
    manifest["records"] = 2
    (next((tmp_path / "one/manifest").glob("part-*"))).write_text(json.dumps(manifest))
    for crc in (tmp_path / "one/manifest").glob(".*.crc"):
        crc.unlink()
    assert inputs.verify(spark, str(tmp_path / "one")) == ["seal"]


def test_dataset(spark, tmp_path, capsys):
    config = {"build": {
        "rules": [{"rule_id": "Q", "status": "verified", "tax_years": [], "conditions": [], "effects": [{"effect_type": "REQUIRE_INFORMATION", "target": "asset.proceeds"}]}],
        "rule_schema": rule_plans.RULE_SCHEMA, "templates": rule_plans.TEMPLATES, "counts": {"T-SALE": 3}, "tax_year": 2025, "seed": 1, "mark_unknown": ["asset.proceeds"], "tasks": ["t1"],
    }}
    path = tmp_path / "config.yaml"
    path.write_text(json.dumps(config))  # JSON is YAML
    code, summary = _run(capsys, spark, "dataset", "build", path, tmp_path / "builds")
    assert code == 0 and (summary["base"], summary["mutated"], summary["examples"]) == (3, 3, 12)
    folder = tmp_path / "builds" / summary["build_id"]
    assert _run(capsys, spark, "dataset", "status", folder)[1]["state"] == "COMPLETED"
    assert _run(capsys, spark, "dataset", "freeze", folder, tmp_path / "r", "R1")[1]["records"] == 12
    assert _run(capsys, spark, "dataset", "freeze", folder, tmp_path / "r", "R1")[0] == 1
    assert _run(capsys, spark, "dataset", "verify-release", tmp_path / "r") == (0, {"problems": []})
    record = json.loads((folder / "build.json").read_text())
    (folder / "build.json").write_text(json.dumps(record | {"state": "FAILED"}))
    assert _run(capsys, spark, "dataset", "freeze", folder, tmp_path / "r2", "R2")[0] == 1


def test_queries(spark, tmp_path, capsys):
    code, names = _run(capsys, spark, "query", "list")
    assert code == 0 and "exact_dedup" in names
    spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert _run(capsys, spark, "query", "run", "exact_dedup", tmp_path, tmp_path / "out")[0] == 0
    assert sorted(r["copies"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_member_hashes_of_large_and_odd_components(spark):
    names = {0: [f"m{i}" for i in range(30_000)], 1: ['quote"', "back\\slash", "é", "\t"], 2: [""], 3: ["10", "9"]}
    rows = spark.createDataFrame([(c, n) for c, ns in names.items() for n in ns], "component long, id string").repartition(7)
    got = {r["component"]: r["digest"] for r in clusters.member_hashes(rows, "id").collect()}
    want = {c: hashlib.sha256(json.dumps([sorted(ns)], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for c, ns in names.items()}
    assert got == want
    assert clusters.member_hashes(rows.where("false"), "id").count() == 0
    assert clusters.member_hashes(rows.select(F.col("id").alias("component"), "id"), "id").count() == sum(map(len, names.values()))


def test_padding_problems(spark):
    cases = [
        ([1, 2, 0], [-100, 2, -100], [1, 1, 0], [[3], [0], [0]], None), ([1, 0], [1, 5], [1, 0], [[0], [0]], "a padded label is trained"), ([1, 0], [1], [1, 0], [[0], [0]], "lengths differ"),
        ([1, 0], [1, -100], [1, 2], [[0], [0]], "mask is not 0 or 1"), ([1, 0], [1, -100], [1, 0], [[0], [4]], "a padded token has features"), ([], [], [], [], None), ([1, 0], [1, -100], [1, 0], [[1]], "lengths differ"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, ids array<int>, labels array<int>, mask array<int>, features array<array<int>>, want string")
    found = rows.withColumn("got", sequences.padding_problem(F.col("ids"), F.col("labels"), F.col("mask"), F.col("features")))
    assert all(r["got"] == r["want"] for r in found.collect())


def test_seal_of_other_field():
    sealed = integrity.sealed({"a": 1}, "own_hash")
    assert integrity.seal_holds(sealed, "own_hash") and not integrity.seal_holds({"a": 1}, "own_hash")
