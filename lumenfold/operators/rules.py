"""Declarative rules over facts.

Tables: ``rules`` (rule_id, status, tax_years array, conditions array of
struct(concept_id, operator, value, value_ref), effects array of
struct(effect_type, target)); ``facts`` (scenario_id, ord, concept_id, state,
value). Values are compared as exact numbers where both sides are some, else
as text. Predicates are two-valued: nothing is ever null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.sources.storage import broadcast_if_small, checkpoint

OPERATORS = ("EXISTS", "MISSING", "EQ", "NE", "GT", "GTE", "LT", "LTE")
#: Effect types and the result column that each one feeds.
EFFECTS = {
    "ADD_TOPIC": "topics", "REQUIRE_INFORMATION": "missing", "SOURCE_DOCUMENT": "source_documents", "CANDIDATE_FORM": "candidate_forms",
    "REQUIRE_FORM": "required_forms", "REQUIRE_CALCULATION": "calculations", "REQUIRE_RULE_LOOKUP": "rule_lookups",
}
#: Statuses, most pressing first.
STATUSES = ("AMBIGUOUS", "NEEDS_INFORMATION", "NEEDS_RULE_LOOKUP", "OUTSIDE_SCOPE", "ANSWERABLE")


def active_rules(rules: DataFrame, year: int) -> DataFrame:
    return rules.where((F.col("status") == "verified") & ((F.size("tax_years") == 0) | F.array_contains("tax_years", year)))


def first_present(facts: DataFrame) -> DataFrame:
    """(scenario_id, concept_id, value): the first present fact of each concept."""
    return facts.where("state = 'present'").groupBy("scenario_id", "concept_id").agg(F.min_by("value", "ord").alias("value"))


def compare(op: Column, left: Column, right: Column, keys: tuple[Column, Column] | None = None) -> Column:
    """EQ to LTE, on numbers where both sides are some, else on text; anything unknown raises.

    Numbers compare exactly, with any number of digits and exponents of up to
    17 digits, by ``keys``: each side's `number_key`, where those are at hand.
    """
    a, b = keys or (number_key(left), number_key(right))
    sides = F.struct(a.alias("a"), b.alias("b"), left.cast("string").alias("left"), right.cast("string").alias("right"))

    def order(x: Column) -> Column:
        side = lambda p, q: F.when(p < q, -1).when(p > q, 1).otherwise(0)
        return F.when(x["a"].isNotNull() & x["b"].isNotNull(), side(x["a"], x["b"])).otherwise(F.coalesce(side(x["left"], x["right"]), F.lit(0)))

    code = F.upper(op)

    def holds(o: Column) -> Column:
        return (
            F.when(code == "EQ", o == 0).when(code == "NE", o != 0).when(code == "GT", o > 0).when(code == "GTE", o >= 0).when(code == "LT", o < 0).when(code == "LTE", o <= 0)
            .otherwise(F.raise_error(F.concat(F.lit("unknown operator "), op)))
        )

    return _let(_let(sides, order), holds)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def number_key(value: Column) -> Column:
    """struct(sign, place, digits) that orders as the numbers do; null where the text is no number.

    ``place`` is the power of ten of the first digit and ``digits`` are all
    from there, without zeros at the end; of negative numbers the place is
    negated and each digit replaced by its complement, ended by a mark that
    stands after all digits.
    """
    text = F.trim(value.cast("string"))
    number = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,17})?$")

    def parts(t: Column) -> Column:
        whole, rest = F.regexp_extract(t, r"^[+-]?(\d*)", 1), F.regexp_extract(t, r"^[+-]?\d*\.(\d*)", 1)
        power = F.coalesce(F.nullif(F.regexp_extract(t, r"[eE]([+-]?\d+)$", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
        return F.struct(t.startswith("-").alias("minus"), F.concat(whole, rest).alias("all"), (F.length(whole) + power).alias("place"))

    def key(p: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(p["all"], "^0+", ""), "0+$", "")
        first = p["place"] - (F.length(p["all"]) - F.length(F.regexp_replace(p["all"], "^0+", "")))
        zero = F.struct(F.lit(0).alias("sign"), F.lit(0).cast("long").alias("place"), F.lit("").alias("digits"))
        below = F.struct(F.lit(-1).alias("sign"), (-first).alias("place"), F.concat(F.translate(digits, "0123456789", "9876543210"), F.lit("~")).alias("digits"))
        above = F.struct(F.lit(1).alias("sign"), first.alias("place"), digits.alias("digits"))
        return F.when(digits == "", zero).when(p["minus"], below).otherwise(above)

    return F.when(number, _let(_let(F.when(number, text), parts), key))


def condition_holds(op: Column, present: Column, left: Column, right: Column, keys: tuple[Column, Column] | None = None) -> Column:
    """A condition against the first present value; comparisons without a value on either side fail."""
    code = F.upper(op)
    return F.when(code == "EXISTS", present).when(code == "MISSING", ~present).when(~present | left.isNull() | right.isNull(), F.lit(False)).otherwise(compare(op, left, right, keys))


def activated(scenarios: DataFrame, rules: DataFrame, facts: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(scenario_id, rule_id) of rules all of whose conditions hold; no conditions: active.

    Conditions meet facts on the concept and are counted: a rule is active where
    as many hold as it has, and no MISSING one meets a fact. Rules that need no
    fact are active wherever nothing speaks against them; these alone are paired
    with every scenario, which is their result.
    """
    listed = rules.select("rule_id", F.posexplode_outer("conditions").alias("n", "c")).select("rule_id", "n", "c.*")
    if values is not None:
        known = values.select(F.col("value_id").alias("value_ref"), F.col("value").cast("string").alias("resolved"))
        listed = listed.join(known, "value_ref", "left")
    else:
        listed = listed.withColumn("resolved", F.lit(None).cast("string"))
    listed = listed.withColumn("right", F.when(F.col("value_ref").isNotNull(), F.col("resolved")).otherwise(F.col("value"))).select("rule_id", "n", "concept_id", "operator", "right", number_key(F.col("right")).alias("right_key"))
    held = first_present(facts).select("scenario_id", "concept_id", F.col("value").cast("string").alias("left")).withColumn("left_key", number_key(F.col("left")))
    missing = F.upper("operator") == "MISSING"
    listed = broadcast_if_small(checkpoint(listed))
    met = scenarios.select("scenario_id").distinct().join(held, "scenario_id").join(listed.where("n IS NOT NULL"), "concept_id")
    ok = condition_holds(F.col("operator"), F.lit(True), F.col("left"), F.col("right"), (F.col("left_key"), F.col("right_key")))
    counts = met.groupBy("scenario_id", "rule_id").agg(F.count_if(missing).alias("against"), F.count_if(~missing & ok).alias("held"))
    needs = listed.groupBy("rule_id").agg(F.count_if(F.col("n").isNotNull() & ~F.coalesce(missing, F.lit(False))).alias("needed"))
    needs = broadcast_if_small(checkpoint(needs))
    full = counts.join(needs.where("needed > 0"), "rule_id").where("against = 0 AND held = needed").select("scenario_id", "rule_id")
    free = scenarios.select("scenario_id").distinct().crossJoin(needs.where("needed = 0").select("rule_id"))
    against = counts.where("against > 0").select("scenario_id", "rule_id")
    return full.unionByName(free.join(against, ["scenario_id", "rule_id"], "left_anti"))


def analyse(scenarios: DataFrame, rules: DataFrame, facts: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Per scenario the sorted distinct outcome lists of its active rules, and its status."""
    active = activated(scenarios, rules, facts, values)
    effects = rules.select("rule_id", F.explode("effects").alias("e")).select("rule_id", F.upper("e.effect_type").alias("effect"), "e.target")
    reached = active.join(broadcast_if_small(effects), "rule_id", "left")
    known = facts.where("state = 'present'").select("scenario_id", F.col("concept_id").alias("target")).distinct().withColumn("known", F.lit(True))
    reached = reached.join(known, ["scenario_id", "target"], "left")
    counts = lambda kind: (F.col("effect") == kind) & (F.lit(True) if kind != "REQUIRE_INFORMATION" else F.col("known").isNull())
    lists = reached.groupBy("scenario_id").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"), *[F.array_sort(F.collect_set(F.when(counts(kind), F.col("target")))).alias(name) for kind, name in EFFECTS.items()])
    conflicts = facts.where("state = 'conflicting'").groupBy("scenario_id").agg(F.array_sort(F.collect_set("concept_id")).alias("conflicts"))
    both = scenarios.select("scenario_id").join(lists, "scenario_id", "left").join(conflicts, "scenario_id", "left")
    none = F.array().cast("array<string>")
    full = both.select("scenario_id", *[F.coalesce(c, none).alias(c) for c in ("rules", *EFFECTS.values(), "conflicts")])
    return full.withColumn("status", answerability(F.size("conflicts") > 0, F.size("missing") > 0, F.size("rule_lookups") > 0))


def answerability(conflicts: Column, missing: Column, lookups: Column) -> Column:
    return F.when(conflicts, "AMBIGUOUS").when(missing, "NEEDS_INFORMATION").when(lookups, "NEEDS_RULE_LOOKUP").otherwise("ANSWERABLE")


def overall_status(rows: DataFrame, status: str, *by: str) -> DataFrame:
    """The most pressing status of a group."""
    place = F.array_position(F.array(*map(F.lit, STATUSES)), F.col(status))
    return rows.groupBy(*by).agg(F.element_at(F.array(*map(F.lit, STATUSES)), F.min(place).cast("int")).alias("status"))


def constraint_holds(kind: Column, left: Column, right: Column) -> Column:
    """before/lt, after/gt, lte, gte, eq, ne between values; unknown kinds pass."""
    k = F.lower(kind)
    return F.coalesce(F.when(k.isin("before", "lt"), left < right).when(k.isin("after", "gt"), left > right).when(k == "lte", left <= right).when(k == "gte", left >= right).when(k == "eq", left == right).when(k == "ne", left != right).otherwise(True), F.lit(False))


def unique_lookup(rows: DataFrame, table: DataFrame, on: list[str], value: str) -> DataFrame:
    """``rows`` with ``value`` looked up by equality of ``on``; null where absent, an error where several match."""
    found = table.groupBy(*on).agg(F.count("*").alias("matches__"), F.first(value).alias(value))
    checked = found.withColumn(value, F.when(F.col("matches__") == 1, F.col(value)).otherwise(F.raise_error(F.lit("ambiguous lookup")))).drop("matches__")
    return rows.join(checked, on, "left")


def map_key(dimensions: Column) -> Column:
    """A map as sorted entries, which can be compared and joined."""
    return F.array_sort(F.map_entries(dimensions))


def latest(rows: DataFrame, key: str, revision: str) -> DataFrame:
    """The whole row of the highest revision per key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), revision).alias("r")).select("r.*")


def last_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """A registry: of rows with one key the last read stays."""
    return latest(rows, key, ordinal)


def unknown_members(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Rows whose key a registry lacks; must be empty."""
    return rows.join(known.select(key).distinct(), key, "left_anti")
