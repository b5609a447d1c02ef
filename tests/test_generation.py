"""Generated scenarios by ranges, against plain loops; and the gates of a build."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import scenarios
from lumenfold.plans import rule_plans
from lumenfold.plans.build import Build, BuildError
from lumenfold.sources.storage import content_hash, content_int

FOLDER = "/root/testdata/sf0.001"


def test_ranges_are_cut_into_even_tasks(spark, monkeypatch):
    """Ten million planned scenarios of two templates: sixteen tasks, no row that holds a template's numbers."""
    monkeypatch.setattr(scenarios, "TASK_SCENARIOS", 625_000)
    planned = scenarios._indexed(spark, {"A": 9_999_000, "none": 0, "B": 1_000})
    sizes = [r["count"] for r in planned.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) == min(sizes) == 625_000
    got = {r["template_id"]: (r["n"], r["low"], r["high"], r["d"]) for r in planned.groupBy("template_id").agg(F.count("*").alias("n"), F.min("index").alias("low"), F.max("index").alias("high"), F.count_distinct("index").alias("d")).collect()}
    assert got == {"A": (9_999_000, 0, 9_998_999, 9_999_000), "B": (1_000, 0, 999, 1_000)}


def test_many_templates_and_none(spark):
    counts = {f"T{k}": k % 4 for k in range(400)}
    got = {}
    for r in scenarios._indexed(spark, counts).collect():
        got.setdefault(r["template_id"], []).append(r["index"])
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(n)) for k, n in counts.items() if n}
    assert scenarios._indexed(spark, {"A": 0}).collect() == [] and scenarios._indexed(spark, {}).collect() == []


def test_generated_scenarios_against_a_loop(spark):
    """Ids by their hashes, values drawn anew in one loop, children without the proceeds."""
    rows = rule_plans.generated_scenarios(spark, FOLDER).collect()
    n = spark.read.parquet(f"{FOLDER}/supplier.parquet").count()
    template, made = rule_plans.TEMPLATES[0], {}
    for i in range(n):
        seed = content_int(42, "T-SALE", i)
        scenario = "SCENARIO-" + content_hash("T-SALE", 1, "0.1", seed, i)[:24]
        made[scenario] = (scenarios.make_scenario(template, 2025, seed, i, {}), "FAMILY-" + content_hash("T-SALE", seed, i)[:20])
    base = {r["scenario_id"]: r for r in rows if r["origin"] == "generated"}
    assert base.keys() == made.keys() and len(rows) == 2 * n
    for k, r in base.items():
        want, family = made[k]
        assert r["family_id"] == family and [(f["concept_id"], f["value"]) for f in r["facts"]] == [(f["concept_id"], f["value"]) for f in want["facts"]]
        values = {f["concept_id"]: f["value"] for f in r["facts"]}
        assert values["asset.acquired"] < values["asset.sold"] and int(values["asset.proceeds"]) >= 1000
    families = {family: k for k, (_, family) in made.items()}
    for r in rows:
        if r["origin"] == "mutated":
            parent = base[families[r["family_id"]]]
            params = json.dumps({"concept_id": "asset.proceeds"}, separators=(",", ":"))
            targets = [f["fact_id"] for f in parent["facts"] if f["concept_id"] == "asset.proceeds"]
            assert r["scenario_id"] == "SCENARIO-" + content_hash_of(parent["scenario_id"], "mark_unknown", 0, targets, params)[:24]
            for f, g in zip(r["facts"], parent["facts"], strict=True):
                assert (f["state"], f["value"]) == (("unknown", None) if f["concept_id"] == "asset.proceeds" else (g["state"], g["value"]))


def content_hash_of(*parts):
    """Parts as one JSON array, where the last is JSON already."""
    import hashlib

    text = json.dumps(list(parts[:-1]), separators=(",", ":"))[:-1] + "," + parts[-1] + "]"
    return hashlib.sha256(text.encode()).hexdigest()


CONFIG = {
    "rules": [("R", "verified", [], [("asset.proceeds", "EXISTS", None, None)], [("ADD_TOPIC", "sale")]), ("Q", "verified", [], [], [("REQUIRE_INFORMATION", "asset.proceeds")])],
    "rule_schema": rule_plans.RULE_SCHEMA, "templates": rule_plans.TEMPLATES, "counts": {"T-SALE": 4}, "tax_year": 2025, "seed": 3, "tasks": ["t1"],
    "mark_unknown": ["asset.proceeds"], "create_conflict": [["asset.kind", "bond"]], "forced_assumption": [["asset.kind", "fund"]],
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    build, seen = Build(spark, tmp_path_factory.mktemp("build"), CONFIG), []
    plain = build.validate
    build.validate = lambda split, rule_rows: seen.append(split) or plain(split, rule_rows)
    return build, build.run(), seen[0], plain


def test_mutated_scenarios_are_analysed_again(built):
    _, summary, split, _ = built
    rows = split.collect()
    assert summary["base"] == 4 and summary["mutated"] == 12 and len({r["scenario_id"] for r in rows}) == 16
    by_status = {}
    for r in rows:
        state = {f["concept_id"]: f["state"] for f in r["facts"]}
        kind = "conflict" if state["asset.kind"] == "conflicting" else "unknown" if state["asset.proceeds"] == "unknown" else "assumed" if r["context"] else "plain"
        by_status.setdefault(kind, set()).add((r["status"], tuple(r["conflicts"]), tuple(r["missing"]), tuple(r["topics"])))
    assert by_status == {"plain": {("ANSWERABLE", (), (), ("sale",))}, "assumed": {("ANSWERABLE", (), (), ("sale",))}, "conflict": {("AMBIGUOUS", ("asset.kind",), (), ("sale",))}, "unknown": {("NEEDS_INFORMATION", (), ("asset.proceeds",), ())}}
    family = {}
    for r in rows:
        family.setdefault(r["family_id"], []).append(r)
    assert all(len({r["content"] for r in v}) == 4 and len({r["structure"] for r in v}) == 3 for v in family.values())


def test_a_changed_fact_rule_or_document_fails_by_name(spark, built):
    build, _, split, validate = built
    rule_rows = spark.createDataFrame(CONFIG["rules"], CONFIG["rule_schema"])
    assert validate(split, rule_rows) == []
    one = split.agg(F.min("scenario_id")).head()[0]
    hit = F.col("scenario_id") == one
    codes = lambda found: [p.split(":")[0] for p in found]
    other = F.transform("facts", lambda f: F.when(f["concept_id"] == "asset.acquired", f.withField("value", F.lit("1999-01-01"))).otherwise(f))
    changed = validate(split.withColumn("facts", F.when(hit, other).otherwise(F.col("facts"))), rule_rows)
    assert codes(changed) == ["CONTENT-MISMATCH"] and one in changed[0]
    papers = validate(split.withColumn("documents", F.when(hit, F.array(F.lit("FORM-Z"))).otherwise(F.col("documents"))), rule_rows)
    assert codes(papers) == ["CONTENT-MISMATCH", "SEMANTIC-MISMATCH", "STRUCTURE-MISMATCH"] and all(one in p for p in papers)
    rule = spark.createDataFrame([("R2", "verified", [], [], [("ADD_TOPIC", "new")]), *CONFIG["rules"]], CONFIG["rule_schema"])
    assert codes(validate(split, rule)) == ["ANALYSIS-MISMATCH", "CONTENT-MISMATCH", "SEMANTIC-MISMATCH"]
    bad = Build(spark, build.folder.parent, CONFIG | {"seed": 4})
    bad.validate = lambda rows, rules, old=bad.validate: old(rows.withColumn("documents", F.array(F.lit("FORM-Z"))), rules)
    with pytest.raises(BuildError, match="STRUCTURE-MISMATCH"):
        bad.run()
    assert json.loads((bad.folder / "build.json").read_text())["state"] == "FAILED" and not (bad.folder / "exports").exists()
