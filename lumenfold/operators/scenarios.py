"""Scenario generation, mutation and fingerprints.

Values are drawn with Python's generator, seeded per (version, seed, template,
variable, attempt), inside ``mapInPandas``: any worker makes the same scenario
for the same index. Everything after the draw is columns.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from datetime import date, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.hashing import identifier, json_string
from lumenfold.operators import rules
from lumenfold.sources.storage import checkpoint, content_hash, content_int

#: Suggestions that stand beside the facts without being any.
CONTEXT = "array<struct<context_id:string,role:string,concept_id:string,suggested_value:string,trusted:boolean>>"
FACT = "struct<fact_id:string,concept_id:string,state:string,value:string,event_id:string,assertions:array<struct<assertion_id:string,value:string,source_type:string>>>"
SCENARIO = f"scenario_id string, family_id string, template_id string, tax_year int, seed decimal(20,0), attempt int, facts array<{FACT}>, events array<string>, documents array<string>"
_ORDERS = {"before": "lt", "after": "gt"}


def draw(spec: dict[str, Any], rng: random.Random, year: int, made: dict[str, Any], known: dict[str, int]) -> Any:
    """One value of a generator specification; an unknown kind is an error."""
    kind, options = spec["type"], spec.get("values") or []

    def any_day(of: int) -> date:
        first = date(of, 1, 1)
        return first + timedelta(rng.randint(0, (date(of, 12, 31) - first).days))

    match kind:
        case "constant":
            return spec.get("value")
        case "choice":
            return rng.choice(options)
        case "weighted_choice":
            return rng.choices(options, weights=spec.get("weights"), k=1)[0]
        case "integer_range" | "money_range":
            step = int(spec.get("step") or 1)
            return int(spec["min"]) + step * rng.randint(0, (int(spec["max"]) - int(spec["min"])) // step)
        case "boolean_probability":
            return rng.random() < float(0.5 if spec.get("value") is None else spec["value"])
        case "date_in_tax_year":
            return any_day(year)
        case "date_year_offset":
            return any_day(year + int(rng.choice(options or [0])))
        case "relative_date":
            return made[spec["reference"]] + timedelta(rng.randint(int(spec.get("min_days_after") or 1), int(spec.get("max_days_after") or 365)))
        case "value_ref" | "value_ref_boundary":
            if spec["value_ref"] not in known:
                raise ValueError(f"no value {spec['value_ref']} for {year}")
            shift = {"below": -1, "above": 1}.get(spec.get("boundary_position"), 0) if kind == "value_ref_boundary" else 0
            return known[spec["value_ref"]] + shift * (spec.get("delta") or 1)
    raise ValueError(f"unknown generator {kind}")


def constraints_hold(constraints: list[dict[str, Any]], made: dict[str, Any]) -> bool:
    tests = {"lt": lambda a, b: a < b, "gt": lambda a, b: a > b, "lte": lambda a, b: a <= b, "gte": lambda a, b: a >= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b}
    for c in constraints:
        kind = c["type"].lower()
        test = tests.get(_ORDERS.get(kind, kind))
        right = made.get(c["right"], c["right"]) if isinstance(c["right"], str) else c["right"]
        if test and not test(made.get(c["left"]), right):
            return False
    return True


def make_scenario(template: dict[str, Any], year: int, seed: int, index: int, known: dict[str, int], version: str = "0.1", after: int = 0) -> dict[str, Any]:
    """The first attempt later than ``after`` whose values satisfy the template's constraints."""
    name, revision = template["template_id"], template.get("revision", 1)
    for attempt in range(after + 1, template.get("max_attempts", 100) + 1):
        made: dict[str, Any] = {}
        for v in template["variables"]:
            made[v["id"]] = draw(v["generator"], random.Random(content_int(version, seed, name, v["id"], attempt)), year, made, known)
        if constraints_hold(template.get("constraints", []), made):
            break
    else:
        raise RuntimeError(f"no accepted attempt for {name}")
    scenario_id = "SCENARIO-" + content_hash(name, revision, version, seed, index)[:24]
    events = template.get("events", [])
    event_id = lambda e: "EVENT-" + content_hash(scenario_id, e["id"])[:20]
    owner = {v: event_id(e) for e in reversed(events) for v in e["variables"]}  # the first event that names a variable
    facts = [{"fact_id": "FACT-" + content_hash(scenario_id, v["id"])[:20], "concept_id": v["concept_id"], "state": "present", "value": str(made[v["id"]]), "event_id": owner.get(v["id"]), "assertions": []} for v in template["variables"]]
    return {"scenario_id": scenario_id, "family_id": "FAMILY-" + content_hash(name, seed, index)[:20], "template_id": name, "tax_year": year, "seed": seed, "attempt": attempt, "facts": facts, "events": [e["type"] for e in events], "documents": list(template.get("documents", []))}


def generate(spark: SparkSession, templates: list[dict[str, Any]], counts: dict[str, int], year: int, seed: int, known: dict[str, int] | None = None) -> DataFrame:
    """``counts[template]`` scenarios of each template; templates are configuration and travel with the function."""
    return _drawn(_indexed(spark, counts), templates, year, seed, known).drop("index")


def generate_complete(spark: SparkSession, templates: list[dict[str, Any]], counts: dict[str, int], year: int, seed: int, active: DataFrame, known: dict[str, int] | None = None) -> DataFrame:
    """As ``generate``, drawing again while the ``active`` rules find concepts missing.

    A template with ``require_complete_base_scenario`` false takes incomplete
    scenarios; one that runs out of attempts is an error.
    """
    lenient = [t["template_id"] for t in templates if not t.get("require_complete_base_scenario", True)]
    todo, done = _indexed(spark, counts), None
    while True:
        drawn = checkpoint(_drawn(todo, templates, year, seed, known))
        missing = rules.analyse(drawn, active, facts_of(drawn)).where(F.size("missing") > 0).select("scenario_id")
        again = checkpoint(drawn.where(~F.col("template_id").isin(lenient)).join(missing, "scenario_id", "left_semi"))
        complete = drawn.join(again.select("scenario_id"), "scenario_id", "left_anti").drop("index")
        done = complete if done is None else done.unionByName(complete)
        if again.isEmpty():
            return done
        todo = again.select("template_id", "index", F.col("attempt").alias("after"))


#: Scenarios that one task draws.
TASK_SCENARIOS = 20_000


def _indexed(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """(template_id, index, after) of every wanted scenario: one range of numbers, cut into tasks; each template owns a part of it."""
    total = sum(max(0, n) for n in counts.values())
    numbers = spark.range(0, total, 1, max(1, min(-(-total // TASK_SCENARIOS), 100_000), spark.sparkContext.defaultParallelism))
    parts, first = [], 0
    for template, n in counts.items():
        if n > 0:
            parts.append((template, first, first + n))
            first += n
    if len(parts) <= 200:
        owner = F.coalesce(*[F.when(F.col("id") < end, F.struct(F.lit(t).alias("template_id"), F.lit(begin).cast("long").alias("begin"))) for t, begin, end in parts]) if parts else F.lit(None).cast("struct<template_id:string,begin:long>")
        placed = numbers.withColumn("owner", owner).select("owner.template_id", (F.col("id") - F.col("owner.begin")).cast("int").alias("index"))
    else:
        owners = spark.createDataFrame(parts, "template_id string, begin long, end long")
        placed = numbers.join(F.broadcast(owners), (F.col("id") >= F.col("begin")) & (F.col("id") < F.col("end"))).select("template_id", (F.col("id") - F.col("begin")).cast("int").alias("index"))
    return placed.withColumn("after", F.lit(0))


def _drawn(indexed: DataFrame, templates: list[dict[str, Any]], year: int, seed: int, known: dict[str, int] | None) -> DataFrame:
    by_id, values = {t["template_id"]: t for t in templates}, known or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        for pdf in batches:
            rows = []
            for t, i, after in zip(pdf["template_id"], pdf["index"], pdf["after"], strict=True):
                row = make_scenario(by_id[t], year, content_int(seed, t, int(i)), int(i), values, after=int(after))
                rows.append(row | {"seed": Decimal(row["seed"]), "index": i})
            yield pd.DataFrame(rows, columns=["scenario_id", "family_id", "template_id", "tax_year", "seed", "attempt", "facts", "events", "documents", "index"])

    return indexed.mapInPandas(run, f"{SCENARIO}, index int")


def facts_of(scenarios: DataFrame) -> DataFrame:
    """Scenario facts as rows: scenario_id, ord, fact_id, concept_id, state, value, event_id."""
    return scenarios.select("scenario_id", F.posexplode("facts").alias("ord", "f")).select("scenario_id", "ord", "f.fact_id", "f.concept_id", "f.state", "f.value", "f.event_id")


# Mutations: each changes facts and derives a new id in the same family --------


def _child(scenarios: DataFrame, facts: Column, kind: str, seed: int, params: Column, targets: Column) -> DataFrame:
    new_id = identifier("SCENARIO", json_string(F.col("scenario_id")), kind, seed, F.to_json(targets), params)
    out = scenarios.select(F.col("scenario_id").alias("parent_id"), new_id.alias("scenario_id"), *[c for c in scenarios.columns if c not in ("scenario_id", "facts")], facts.alias("facts"), targets.alias("target_fact_ids"), F.lit(kind).alias("mutation_type"))
    return out.withColumn("mutation_id", identifier("MUT", json_string(F.col("scenario_id")), kind))


def _targets(concept: str) -> Column:
    hit = F.transform(F.filter("facts", lambda f: f["concept_id"] == concept), lambda f: f["fact_id"])
    return F.when(F.size(hit) > 0, hit).otherwise(F.raise_error(F.lit(f"no fact with concept {concept}")))


def mark_unknown(scenarios: DataFrame, concept: str, seed: int = 0) -> DataFrame:
    """All facts of a concept lose their value."""
    changed = F.transform("facts", lambda f: F.when(f["concept_id"] == concept, f.withField("state", F.lit("unknown")).withField("value", F.lit(None).cast("string"))).otherwise(f))
    return _child(scenarios, changed, "mark_unknown", seed, F.to_json(F.struct(F.lit(concept).alias("concept_id"))), _targets(concept))


def create_conflict(scenarios: DataFrame, concept: str, other: str, seed: int = 0) -> DataFrame:
    """All facts of a concept get two assertions, the old value from a document and another stated by the user."""
    none = F.lit(None).cast("string")

    def said(f: Column, number: int, value: Column, source: str) -> Column:
        return F.struct(F.concat(F.lit("A-"), f["fact_id"], F.lit(f"-{number}")).alias("assertion_id"), value.alias("value"), F.lit(source).alias("source_type"))

    changed = F.transform("facts", lambda f: F.when(f["concept_id"] == concept, f.withField("state", F.lit("conflicting")).withField("assertions", F.array(said(f, 1, f["value"], "tax_document"), said(f, 2, F.lit(other), "user_statement"))).withField("value", none)).otherwise(f))
    return _child(scenarios, changed, "create_conflict", seed, F.to_json(F.struct(F.lit(concept).alias("concept_id"))), _targets(concept))


def forced_assumption(scenarios: DataFrame, concept: str, value: str, seed: int = 0) -> DataFrame:
    """Adds an unverified suggestion as context; facts stay."""
    context = F.array(F.struct(identifier("CTX", json_string(F.col("scenario_id")), concept, seed).alias("context_id"), F.lit("forced_assumption").alias("role"), F.lit(concept).alias("concept_id"), F.lit(value).alias("suggested_value"), F.lit(False).alias("trusted")))
    params = F.to_json(F.struct(F.lit(concept).alias("concept_id"), F.lit(value).alias("suggested_value")))
    before = [F.col("context")] if "context" in scenarios.columns else []
    return _child(scenarios.withColumn("context", F.concat(*before, context)), F.col("facts"), "forced_assumption", seed, params, F.array().cast("array<string>"))


# Fingerprints ----------------------------------------------------------------


def _json_pairs(pairs: Column) -> Column:
    """Sorted array of struct(a, b) as JSON array of arrays."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(F.lit("["), json_string(p["a"]), F.lit(","), json_string(p["b"]), F.lit("]"))), ","), F.lit("]"))


def _json_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(values), json_string), ","), F.lit("]"))


def _states(facts: Column) -> Column:
    return F.transform(facts, lambda f: F.struct(f["concept_id"].alias("a"), f["state"].alias("b")))


def structural_fingerprint(facts: Column, events: Column, documents: Column, tasks: Column) -> Column:
    """Hash of concept states (a multiset), events, documents and tasks; values do not matter."""
    payload = F.concat(F.lit('[{"concept_states":'), _json_pairs(_states(facts)), F.lit(',"documents":'), _json_list(documents), F.lit(',"events":'), _json_list(events), F.lit(',"tasks":'), _json_list(tasks), F.lit("}]"))
    return F.sha2(payload, 256)


def semantic_fingerprint(facts: Column, events: Column, documents: Column, task_status: Column, rules: Column, year: Column) -> Column:
    """As structural, with the year, task statuses (array of struct(a, b)) and the set of rules."""
    payload = F.concat(
        F.lit('[{"concept_states":'), _json_pairs(_states(facts)), F.lit(',"documents":'), _json_list(documents), F.lit(',"events":'), _json_list(events), F.lit(',"rules":'), _json_list(F.array_distinct(rules)),
        F.lit(',"statuses":'), _json_pairs(task_status), F.lit(',"tax_year":'), year.cast("string"), F.lit("}]"),
    )
    return F.sha2(payload, 256)


def content_fingerprint(scenario: Column, analysis: Column) -> Column:
    """Hash of a scenario's and its analysis' canonical JSON texts; everything matters."""
    return F.sha2(F.concat(F.lit("["), scenario, F.lit(","), analysis, F.lit("]")), 256)
