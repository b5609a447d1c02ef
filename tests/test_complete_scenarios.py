"""Base scenarios are drawn again while rules find concepts missing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import rules, scenarios

RULES = "rule_id string, status string, tax_years array<int>, conditions array<struct<concept_id:string,operator:string,value:string,value_ref:string>>, effects array<struct<effect_type:string,target:string>>"


def test_complete_scenarios(spark):
    kind = {"id": "k", "concept_id": "asset.kind", "generator": {"type": "choice", "values": ["share", "house"]}}
    base = {"template_id": "T", "variables": [kind]}
    lenient = {"template_id": "L", "variables": [kind], "require_complete_base_scenario": False}
    stuck = {"template_id": "S", "variables": [kind | {"generator": {"type": "constant", "value": "house"}}], "max_attempts": 3}
    rule = ("R", "verified", [], [("asset.kind", "EQ", "house", None)], [("REQUIRE_INFORMATION", "asset.use")])
    active = rules.active_rules(spark.createDataFrame([rule], RULES), 2025)
    make = lambda t, n: scenarios.generate_complete(spark, [t], {t["template_id"]: n}, 2025, 1, active)
    got, plain = make(base, 20), scenarios.generate(spark, [base], {"T": 20}, 2025, 1)
    assert got.columns == plain.columns and got.count() == 20
    assert {r["f"] for r in got.select(F.col("facts")[0]["value"].alias("f")).collect()} == {"share"}
    first = {r["scenario_id"]: r["attempt"] for r in plain.where(F.col("facts")[0]["value"] == "share").collect()}
    later = {r["scenario_id"]: r["attempt"] for r in got.collect()}
    assert 0 < len(first) < 20 and first.items() <= later.items() and all(later[s] > 1 for s in later.keys() - first.keys())
    assert make(lenient, 20).where(F.col("facts")[0]["value"] == "house").count() > 0
    with pytest.raises(Exception, match="no accepted attempt"):
        make(stuck, 1).count()
