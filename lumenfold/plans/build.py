"""A dataset build: prepare, generate, mutate, split, validate, export, report.

Each state is written to the build's record before its step runs; an error
leaves the record at FAILED with the reason. Steps are the operators of this
library, and validation stops the build before anything is exported.
"""

from __future__ import annotations

import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.canonical import canonical
from lumenfold.operators import clusters, corpus, export, integrity, rules, scenarios
from lumenfold.sources import writers
from lumenfold.sources.storage import checkpoint, content_hash, write_json, write_summary

STATES = ("PREPARING", "GENERATING", "MUTATING", "SPLITTING", "VALIDATING", "EXPORTING", "REPORTING", "COMPLETED")


class BuildError(RuntimeError):
    pass


class Build:
    """One build of a configuration below a local folder."""

    def __init__(self, spark: SparkSession, folder: str | Path, config: dict[str, Any]) -> None:
        self.spark, self.config = spark, config
        self.build_id = "BUILD-" + content_hash(config)[:20]
        self.folder = Path(folder) / self.build_id
        self.record: dict[str, Any] = {"build_id": self.build_id, "spec_hash": content_hash(config), "history": []}

    def enter(self, state: str, **more: Any) -> None:
        now = datetime.datetime.now(datetime.UTC).isoformat()
        self.record = self.record | more | {"state": state, "updated_at": now, "history": [*self.record["history"], [state, now]]}
        write_json(self.folder / "build.json", self.record)

    def run(self) -> dict[str, Any]:
        try:
            return self._run()
        except Exception as e:
            self.enter("FAILED", error=str(e)[:500])
            raise

    def _run(self) -> dict[str, Any]:
        c = self.config
        self.enter("PREPARING")
        rule_rows = self.spark.createDataFrame(c["rules"], c["rule_schema"])
        self.enter("GENERATING")
        base = scenarios.generate_complete(self.spark, c["templates"], c["counts"], c["tax_year"], c["seed"], rules.active_rules(rule_rows, c["tax_year"]))
        self.enter("MUTATING")
        base = checkpoint(base.withColumn("context", F.array().cast(scenarios.CONTEXT)))
        cols = base.columns
        every = base.withColumn("origin", F.lit("generated"))
        for child in self.mutations(base):
            every = every.unionByName(child.select(*cols).withColumn("origin", F.lit("mutated")))
        every = checkpoint(every)
        full = checkpoint(self.fingerprinted(self.analysed(every, rule_rows)))
        self.enter("SPLITTING")
        placed = clusters.clusters(full, "scenario_id", "family_id", "structure")
        split = checkpoint(full.join(placed.select("scenario_id", "cluster_id", "split"), "scenario_id", "left"))
        self.enter("VALIDATING")
        problems = self.validate(split, rule_rows)
        if problems:
            raise BuildError("; ".join(problems))
        self.enter("EXPORTING")
        examples = export.distinct_examples(export.build_examples(split, c["tasks"], tuple(c.get("renderers", ("structured", "concise")))))
        examples = examples.withColumn("dataset_family", F.concat(F.lit("tax_"), "task"))
        writers.write_examples(examples, str(self.folder / "exports"))
        self.enter("REPORTING")
        counts = split.agg(F.count_if(F.col("origin") == "generated").alias("base"), F.count_if(F.col("origin") == "mutated").alias("mutated"), F.count_distinct("cluster_id").alias("clusters")).first().asDict()
        summary = counts | {"examples": self.spark.read.json(str(self.folder / "exports")).count(), "build_id": self.build_id}
        write_summary(self.folder / "reports", summary)
        self.enter("COMPLETED", summary=summary)
        return summary

    def mutations(self, base: DataFrame) -> list[DataFrame]:
        """Children of all base scenarios: each kind of mutation that the configuration names."""
        c = self.config
        found = [scenarios.mark_unknown(base, concept) for concept in c.get("mark_unknown", [])]
        found += [scenarios.create_conflict(base, concept, str(value)) for concept, value in c.get("create_conflict", [])]
        return found + [scenarios.forced_assumption(base, concept, str(value)) for concept, value in c.get("forced_assumption", [])]

    def analysed(self, every: DataFrame, rule_rows: DataFrame) -> DataFrame:
        """Scenarios, mutated ones too, with the outcome of the rules on their own facts."""
        return every.join(rules.analyse(every, rules.active_rules(rule_rows, self.config["tax_year"]), scenarios.facts_of(every)), "scenario_id", "left")

    def fingerprinted(self, full: DataFrame) -> DataFrame:
        """Adds the hashes of content (``content``), meaning (``semantic``) and structure (``structure``) of scenario and analysis."""
        kinds = {f.name: f.dataType for f in full.schema}
        as_json = lambda names: canonical(F.struct(*names), T.StructType([T.StructField(n, kinds[n]) for n in names]))
        tasks = F.array(*map(F.lit, self.config["tasks"]))
        states = F.transform(tasks, lambda t: F.struct(t.alias("a"), F.coalesce("status", F.lit("")).alias("b")))
        said = [F.col(n) for n in ("facts", "events", "documents")]
        outcome = [n for n in (*export.OUTCOMES, "rules") if n in kinds]
        return full.withColumns({
            "content": scenarios.content_fingerprint(as_json(["tax_year", "facts", "events", "documents", "context"]), as_json(outcome)),
            "semantic": scenarios.semantic_fingerprint(*said, states, F.coalesce("rules", F.array().cast("array<string>")), F.col("tax_year")),
            "structure": scenarios.structural_fingerprint(*said, tasks),
        })

    def validate(self, split: DataFrame, rule_rows: DataFrame) -> list[str]:
        """Leakage across splits, outcomes that a second analysis does not confirm, and hashes that differ from those stored."""
        lost = split.where(F.col("status").isNull() | F.col("cluster_id").isNull()).count()
        problems = [f"NO-CLUSTER: {lost} scenarios without an analysis or a cluster"] if lost else []
        for key in ("family_id", "structure"):
            n = corpus.leakage(split, F.col(key), F.col("split")).count()
            problems += [f"SPLIT-LEAKAGE: {n} values of {key}"] if n else []
        given = ["scenario_id", "tax_year", "facts", "events", "documents", "context"]
        again = checkpoint(self.fingerprinted(self.analysed(split.select(given), rule_rows)))
        outcome = F.struct(*[n for n in (*export.OUTCOMES, "rules") if n in again.columns])
        wrong = split.select("scenario_id", outcome.alias("was")).join(again.select("scenario_id", outcome.alias("now")), "scenario_id").where("was != now").count()
        problems += [f"ANALYSIS-MISMATCH: {wrong} scenarios"] if wrong else []
        stale = integrity.stale(split, again, "scenario_id", ("content", "semantic", "structure")).groupBy("part").agg(F.count("*").alias("n"), F.min("scenario_id").alias("first"))
        return problems + [f"{r['part'].upper()}-MISMATCH: {r['n']} scenarios, {r['first']} first" for r in stale.orderBy("part").collect()]  # three rows at most
