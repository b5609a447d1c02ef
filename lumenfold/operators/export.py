"""Training examples: renderers, chat messages, identity, duplicates, conflicts, sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.hashing import identifier, json_string, stable_hash

SYSTEM = "Answer from the given facts only, in the requested format."


def chat_messages(user: Column, assistant: Column, system: str = SYSTEM) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in (("system", F.lit(system)), ("user", user), ("assistant", assistant))])


def conversation_problem(messages: Column) -> Column:
    """Why a supervised conversation is invalid, or null: its only assistant message must end it, a user must speak."""
    last = F.when(F.size(messages) > 0, F.element_at(messages, -1)["role"])
    n_assistant = F.size(F.filter(messages, lambda m: m["role"] == "assistant"))
    return (
        F.when(F.coalesce(last != "assistant", F.lit(True)), "no final assistant message").when(n_assistant != 1, "not exactly one assistant message")
        .when(~F.exists(messages, lambda m: m["role"] == "user"), "no user message")
    )


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, messages) in turn order."""
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))


# Renderers: (scenario row, task) -> (visible input, target) ----------------


def concise(year: Column, facts: Column, task: Column, analysis: dict[str, Column]) -> tuple[Column, Column]:
    """Facts (array of struct(concept_id, value, state)) and outcome in one line each."""
    said = F.array_join(F.transform(facts, lambda f: F.concat(f["concept_id"], F.lit("="), F.coalesce(f["value"], f["state"]))), "; ")
    prompt = F.concat(F.lit("Tax year "), year.cast("string"), F.lit(". Facts: "), said, F.lit(". Task: "), task, F.lit("."))
    piece = lambda label, name: F.when(F.size(analysis[name]) > 0, F.concat(F.lit(f"{label}: "), F.array_join(analysis[name], ", ")))
    target = F.concat_ws(" | ", analysis["status"], piece("Missing", "missing"), piece("Required forms", "required_forms"), piece("Candidate forms", "candidate_forms"), piece("Calculations", "calculations"))
    return prompt, target


#: Response keys of the structured form, in sorted order, and the outcome each one shows.
RESPONSE = {
    "calculation_requests": "calculations", "candidate_forms": "candidate_forms", "conflicts": "conflicts", "missing_information": "missing", "protocol_version": None,
    "required_forms": "required_forms", "retrieval_requests": "rule_lookups", "source_documents": "source_documents", "status": "status", "topics": "topics",
}


def spaced(json: Column) -> Column:
    """Compact JSON of strings and lists with a blank after separators outside strings."""
    marked = F.regexp_replace(json, r'("(?:[^"\\]|\\.)*")|([,:])', "$1$2\u0001")
    return F.replace(F.replace(marked, F.lit('"\u0001'), F.lit('"')), F.lit("\u0001"), F.lit(" "))


def structured(year: Column, facts: Column, task: Column, analysis: dict[str, Column]) -> tuple[Column, Column]:
    """Request and response as JSON with sorted keys."""
    shown = F.transform(facts, lambda f: F.struct(f["concept_id"].alias("concept_id"), f["state"].alias("state"), f["value"].alias("value")))
    request = F.to_json(F.struct(shown.alias("facts"), F.lit("0.1").alias("protocol_version"), task.alias("task"), year.alias("tax_year")), {"ignoreNullFields": "false"})
    response = F.to_json(F.struct(*[(F.lit("0.1") if name is None else analysis[name]).alias(key) for key, name in RESPONSE.items()]), {"ignoreNullFields": "false"})
    return spaced(request), spaced(response)


class Registry(dict):
    """Named plug-ins: registering a name twice, or running an unknown one, is an error."""

    def register(self, name: str, fn: Callable) -> Callable:
        if name in self:
            raise ValueError(f"{name} is registered already")
        self[name] = fn
        return fn

    def run(self, name: str, *args):
        if name not in self:
            raise KeyError(f"nothing is registered as {name}")
        return self[name](*args)


RENDERERS = Registry(structured=structured, concise=concise)
#: Calculations over struct columns; amounts are integer cents.
CALCULATIONS = Registry(capital_gain=lambda proceeds, basis: proceeds - basis)

OUTCOMES = ("status", "topics", "missing", "conflicts", "source_documents", "candidate_forms", "required_forms", "rule_lookups", "calculations")


def build_examples(scenarios: DataFrame, tasks: list[str], renderers: tuple[str, ...] = ("structured", "concise"), version: str = "0.1") -> DataFrame:
    """Scenario x task x renderer: example_id, scenario_id, task, renderer, input, target, messages.

    ``scenarios``: scenario_id, tax_year, split, facts, and the outcome columns.
    """
    parts = []
    analysis = {c: F.col(c) for c in OUTCOMES}
    by_task = scenarios.withColumn("task", F.explode(F.array(*map(F.lit, tasks))))
    for name in renderers:
        seen, target = RENDERERS.run(name, F.col("tax_year"), F.col("facts"), F.col("task"), analysis)
        example = identifier("EXAMPLE", json_string(F.col("scenario_id")), json_string(F.col("task")), name, version)
        parts.append(by_task.select(example.alias("example_id"), "scenario_id", "task", F.lit(name).alias("renderer"), "split", seen.alias("input"), target.alias("target")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("messages", chat_messages(F.col("input"), F.col("target")))


def conflicting_targets(examples: DataFrame) -> DataFrame:
    """Visible inputs that several different targets answer; must be empty."""
    return examples.groupBy(stable_hash(json_string(F.col("input"))).alias("input_hash")).agg(F.min("target").alias("low"), F.max("target").alias("high")).where("low != high").select("input_hash")


def distinct_examples(examples: DataFrame) -> DataFrame:
    """One example per messages, task and split: the first in (scenario, task, renderer) order."""
    key = F.sha2(F.concat_ws("\0", F.to_json("messages"), "task", "split"), 256)
    rank = F.struct("scenario_id", "task", F.when(F.col("renderer") == "structured", 0).otherwise(1).alias("r"))
    return examples.groupBy(key.alias("key__")).agg(F.min_by(F.struct(*examples.columns), rank).alias("e")).select("e.*")
