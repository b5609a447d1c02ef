"""Queries of the rule engine, lookups, scenarios and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.hashing import json_string, stable_hash
from lumenfold.operators import export, integrity, rules, scenarios
from lumenfold.plans.base import query, table
from lumenfold.sources.storage import literal_rows, written

_CONDITION = "array<struct<concept_id:string,operator:string,value:string,value_ref:string>>"
RULE_SCHEMA = f"rule_id string, status string, tax_years array<int>, conditions {_CONDITION}, effects array<struct<effect_type:string,target:string>>"
#: Rules over customers as scenarios; amounts are cents.
RULES = [
    ("R-ALL", "verified", [], [], [("REQUIRE_INFORMATION", "account.balance"), ("SOURCE_DOCUMENT", "D-1")]),
    ("R-DRAFT", "draft", [], [], [("ADD_TOPIC", "never")]),
    ("R-HIGH", "verified", [2024, 2025], [("account.balance", "GTE", "500000", None), ("account.segment", "EQ", "BUILDING", None)], [("ADD_TOPIC", "wealth"), ("CANDIDATE_FORM", "F-1")]),
    ("R-IDLE", "verified", [2025], [("orders.count", "MISSING", None, None)], [("REQUIRE_INFORMATION", "orders.count"), ("ADD_TOPIC", "idle")]),
    ("R-LIMIT", "verified", [2025], [("account.balance", "GT", None, "limit")], [("REQUIRE_RULE_LOOKUP", "L-1"), ("REQUIRE_FORM", "F-2")]),
    ("R-OLD", "verified", [2020], [], [("ADD_TOPIC", "never")]),
    ("R-OTHER", "verified", [], [("account.segment", "ne", "BUILDING", None), ("account.balance", "LT", "0", None)], [("REQUIRE_CALCULATION", "C-1")]),
]
LIMIT_CENTS = 900_000


def rule_table(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, RULES, RULE_SCHEMA)


def customer_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as scenarios; balance, segment and order count as facts."""
    people = table(spark, sf_dir, "customer").withColumn("scenario_id", F.col("c_custkey").cast("string")).withColumn("cents", F.round(F.col("c_acctbal") * 100).cast("long"))
    state = F.when(F.col("cents") < -90_000, "conflicting").when(F.col("cents") < 0, "unknown").otherwise("present")
    balance = people.select("scenario_id", F.lit(0).alias("ord"), F.lit("account.balance").alias("concept_id"), state.alias("state"), F.col("cents").cast("string").alias("value"))
    segment = people.select("scenario_id", F.lit(1).alias("ord"), F.lit("account.segment").alias("concept_id"), F.lit("present").alias("state"), F.col("c_mktsegment").alias("value"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("scenario_id")).agg(F.count("*").cast("string").alias("value"))
    counts = orders.select("scenario_id", F.lit(2).alias("ord"), F.lit("orders.count").alias("concept_id"), F.lit("present").alias("state"), "value")
    return people.select("scenario_id"), balance.unionByName(segment).unionByName(counts)


_FACTS = """p AS (SELECT c_custkey::VARCHAR AS id, round(c_acctbal * 100)::BIGINT AS cents, c_mktsegment AS seg, (SELECT count(*) FROM orders o WHERE o.o_custkey = c_custkey) AS n FROM customer),
f AS (SELECT *, CASE WHEN cents < -90000 THEN 'conflicting' WHEN cents < 0 THEN 'unknown' ELSE 'present' END AS state FROM p),
a AS (SELECT *, state = 'present' AND cents >= 500000 AND seg = 'BUILDING' AS high, n = 0 AS idle, state = 'present' AND cents > 900000 AS lim, state = 'present' AND cents < 0 AND seg <> 'BUILDING' AS other FROM f)"""


@query(f"WITH {_FACTS} SELECT id AS scenario_id, rule_id FROM (SELECT id, unnest(list_filter(['R-ALL', CASE WHEN high THEN 'R-HIGH' END, CASE WHEN idle THEN 'R-IDLE' END, CASE WHEN lim THEN 'R-LIMIT' END, CASE WHEN other THEN 'R-OTHER' END], lambda x: x IS NOT NULL)) AS rule_id FROM a)")
def rule_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, facts = customer_facts(spark, sf_dir)
    limits = literal_rows(spark, [("limit", LIMIT_CENTS)], "value_id string, value long")
    return rules.activated(people, rules.active_rules(rule_table(spark), 2025), facts, limits)


@query(f"""WITH {_FACTS} SELECT id AS scenario_id, concat_ws(',', 'R-ALL', CASE WHEN high THEN 'R-HIGH' END, CASE WHEN idle THEN 'R-IDLE' END, CASE WHEN lim THEN 'R-LIMIT' END, CASE WHEN other THEN 'R-OTHER' END) AS rules,
  concat_ws(',', CASE WHEN idle THEN 'idle' END, CASE WHEN high THEN 'wealth' END) AS topics, concat_ws(',', CASE WHEN state <> 'present' THEN 'account.balance' END, CASE WHEN idle THEN 'orders.count' END) AS missing, 'D-1' AS source_documents,
  CASE WHEN high THEN 'F-1' ELSE '' END AS candidate_forms, CASE WHEN lim THEN 'F-2' ELSE '' END AS required_forms, CASE WHEN other THEN 'C-1' ELSE '' END AS calculations, CASE WHEN lim THEN 'L-1' ELSE '' END AS rule_lookups,
  CASE WHEN state = 'conflicting' THEN 'account.balance' ELSE '' END AS conflicts,
  CASE WHEN state = 'conflicting' THEN 'AMBIGUOUS' WHEN state <> 'present' OR idle THEN 'NEEDS_INFORMATION' WHEN lim THEN 'NEEDS_RULE_LOOKUP' ELSE 'ANSWERABLE' END AS status FROM a""")
def rule_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _analysis(spark, sf_dir)
    return found.select("scenario_id", "status", *[F.array_join(c, ",").alias(c) for c in found.columns if c not in ("scenario_id", "status")])


def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, facts = customer_facts(spark, sf_dir)
    limits = literal_rows(spark, [("limit", LIMIT_CENTS)], "value_id string, value long")
    return rules.analyse(people, rules.active_rules(rule_table(spark), 2025), facts, limits)


@query("""WITH f AS (SELECT c_custkey::VARCHAR AS scenario_id, 'account.balance' AS concept_id FROM customer WHERE round(c_acctbal * 100) < 0
  UNION ALL SELECT c_custkey::VARCHAR, 'orders.count' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) SELECT * FROM f""")
def missing_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted concepts without a present fact: an anti-join."""
    people, facts = customer_facts(spark, sf_dir)
    wanted = people.withColumn("concept_id", F.explode(F.array(F.lit("account.balance"), F.lit("orders.count"))))
    return wanted.join(facts.where("state = 'present'").select("scenario_id", "concept_id"), ["scenario_id", "concept_id"], "left_anti")


@query(f"""WITH {_FACTS}, s AS (SELECT seg, CASE WHEN state = 'conflicting' THEN 1 WHEN state <> 'present' OR idle THEN 2 WHEN lim THEN 3 ELSE 5 END AS place FROM a)
SELECT seg AS segment, ['AMBIGUOUS', 'NEEDS_INFORMATION', 'NEEDS_RULE_LOOKUP', 'OUTSIDE_SCOPE', 'ANSWERABLE'][min(place)] AS status FROM s GROUP BY seg""")
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("scenario_id"), F.col("c_mktsegment").alias("segment"))
    return rules.overall_status(_analysis(spark, sf_dir).join(segments, "scenario_id"), "status", "segment")


@query("SELECT o_custkey AS key, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate)::VARCHAR AS latest FROM orders GROUP BY 1")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderdate", F.struct("o_orderdate", "o_orderkey").alias("revision"))
    return rules.latest(orders, "key", "revision").select("key", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("SELECT s_suppkey, s_nationkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def unique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return rules.unique_lookup(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), nations, ["s_nationkey"], "n_name")


@query("""WITH v(value_id, kind, value) AS (VALUES ('cap', 'BUILDING', 10), ('cap', 'MACHINERY', 20), ('cap', 'FURNITURE', 30))
SELECT c_custkey, coalesce(value, -1) AS value FROM customer LEFT JOIN v ON kind = c_mktsegment""")
def value_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values looked up by id and equality of a whole map of dimensions."""
    values = spark.createDataFrame([("cap", {"kind": k, "year": "2025"}, v) for k, v in (("BUILDING", 10), ("MACHINERY", 20), ("FURNITURE", 30))], "value_id string, dims map<string,string>, value int")
    wanted = table(spark, sf_dir, "customer").select("c_custkey", F.lit("cap").alias("value_id"), F.create_map(F.lit("year"), F.lit("2025"), F.lit("kind"), F.col("c_mktsegment")).alias("dims"))
    keyed = values.select("value_id", rules.map_key(F.col("dims")).alias("dims_key"), "value")
    return rules.unique_lookup(wanted.withColumn("dims_key", rules.map_key(F.col("dims"))).drop("dims"), keyed, ["value_id", "dims_key"], "value").select("c_custkey", F.coalesce("value", F.lit(-1)).alias("value"))


@query("SELECT DISTINCT p_brand AS key FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13')")
def unknown_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(f"Brand#{i}",) for i in (11, 12, 13)], "key string")
    return rules.unknown_members(table(spark, sf_dir, "part").select(F.col("p_brand").alias("key")).distinct(), "key", known)


@query("""SELECT o_orderkey, CASE o_orderpriority[1] WHEN '1' THEN o_totalprice < 100000 WHEN '2' THEN o_totalprice > 100000 WHEN '3' THEN o_totalprice <= 100000 WHEN '4' THEN o_totalprice >= 100000 ELSE o_totalprice <> 100000 END AS holds FROM orders""")
def constraint_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    kind = F.when(first == "1", "before").when(first == "2", "gt").when(first == "3", "LTE").when(first == "4", "gte").otherwise("ne")
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.constraint_holds(kind, F.col("o_totalprice"), F.lit(100000.0)).alias("holds"))


_CONFIG = """'{"event":{"kind":"' || event_type || '","user":' || user_id || CASE WHEN event_id % 3 = 0 THEN ',"notes":{}' WHEN event_id % 3 = 1 THEN ',"notes":{"seen":[1,{"b":2}]}' ELSE '' END || '},"props":' || props || '}'"""


@query(f"""WITH c AS (SELECT event_id, {_CONFIG} AS config FROM events), f AS (SELECT c.event_id, t.fullkey[3:] AS path, t.value::VARCHAR AS value FROM c, json_tree(c.config) t WHERE (t.type <> 'OBJECT' OR t.value::VARCHAR = '{{}}') AND NOT contains(t.fullkey, '[')),
p AS (SELECT f.event_id + 1 AS event_id, path, value FROM f WHERE event_id + 1 IN (SELECT event_id FROM events)), n AS (SELECT f.* FROM f WHERE event_id - 1 IN (SELECT event_id FROM events))
SELECT coalesce(p.event_id, n.event_id) AS event_id, coalesce(p.path, n.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM p FULL JOIN n ON p.event_id = n.event_id AND p.path = n.path WHERE p.value IS DISTINCT FROM n.value""")
def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event's configuration changes against that of the event before, leaf by leaf."""
    notes = F.when(F.col("event_id") % 3 == 0, ',"notes":{}').when(F.col("event_id") % 3 == 1, ',"notes":{"seen":[1,{"b":2}]}').otherwise("")
    config = F.concat(F.lit('{"event":{"kind":"'), "event_type", F.lit('","user":'), F.col("user_id").cast("string"), notes, F.lit('},"props":'), "props", F.lit("}"))
    events = table(spark, sf_dir, "events").select("event_id", config.alias("config"))
    beside = events.select(F.col("event_id").alias("id"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("step")).groupBy((F.col("id") + F.col("step")).alias("event_id"))
    beside = beside.agg(F.max(F.col("step") == 1).alias("before"), F.max(F.col("step") == -1).alias("after"))  # whether the event before, and the one after, is there
    known = events.join(beside, "event_id").select(F.struct("event_id", "before", "after").alias("event"), "config")
    found = integrity.leaves(known, "event", "config").select("event.*", "path", "value")
    after = found.where("after").withColumn("event_id", F.col("event_id") + 1)
    return integrity.differing_paths(after, found.where("before"), "event_id")


_PAIRS = "'[[\"account.balance\",\"' || state || '\"],[\"account.segment\",\"present\"]' || CASE WHEN n > 0 THEN ',[\"orders.count\",\"present\"]' ELSE '' END || ']'"


@query(f"""WITH {_FACTS} SELECT id AS scenario_id, sha256('[{{"concept_states":' || {_PAIRS} || ',"documents":["D-1"],"events":["sale"],"tasks":["t1","t2"]}}]') AS structural FROM a""")
def structural_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, facts = customer_facts(spark, sf_dir)
    grouped = facts.groupBy("scenario_id").agg(F.collect_list(F.struct("concept_id", "state")).alias("facts"))
    return grouped.select("scenario_id", scenarios.structural_fingerprint(F.col("facts"), F.array(F.lit("sale")), F.array(F.lit("D-1")), F.array(F.lit("t2"), F.lit("t1"))).alias("structural"))


def _example_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, facts = customer_facts(spark, sf_dir)
    said = facts.groupBy("scenario_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "concept_id", F.when(F.col("state") == "present", F.col("value")).alias("value"), "state"))), lambda f: F.struct(f["concept_id"].alias("concept_id"), f["value"].alias("value"), f["state"].alias("state"))).alias("facts"))
    return _analysis(spark, sf_dir).join(said, "scenario_id").withColumn("tax_year", F.lit(2025)).withColumn("split", F.lit("train"))


_SAID = "'account.balance=' || CASE WHEN state = 'present' THEN cents::VARCHAR ELSE state END || '; account.segment=' || seg || CASE WHEN n > 0 THEN '; orders.count=' || n ELSE '' END"
_STATUS = "CASE WHEN state = 'conflicting' THEN 'AMBIGUOUS' WHEN state <> 'present' OR idle THEN 'NEEDS_INFORMATION' WHEN lim THEN 'NEEDS_RULE_LOOKUP' ELSE 'ANSWERABLE' END"


@query(f"""WITH {_FACTS} SELECT 'EXAMPLE-' || substr(sha256('["' || id || '","' || task || '","concise","0.1"]'), 1, 24) AS example_id, id AS scenario_id, task, 'Tax year 2025. Facts: ' || {_SAID} || '. Task: ' || task || '.' AS input,
  concat_ws(' | ', {_STATUS}, CASE WHEN state <> 'present' OR idle THEN 'Missing: ' || concat_ws(', ', CASE WHEN state <> 'present' THEN 'account.balance' END, CASE WHEN idle THEN 'orders.count' END) END, CASE WHEN lim THEN 'Required forms: F-2' END, CASE WHEN high THEN 'Candidate forms: F-1' END, CASE WHEN other THEN 'Calculations: C-1' END) AS target
FROM a, (VALUES ('t1'), ('t2')) t(task)""")
def concise_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.build_examples(_example_rows(spark, sf_dir), ["t1", "t2"], ("concise",)).select("example_id", "scenario_id", "task", "input", "target")


_LIST = "CASE WHEN {0} THEN '[\"{1}\"]' ELSE '[]' END"


@query(f"""WITH {_FACTS} SELECT id AS scenario_id, '{{"facts": [{{"concept_id": "account.balance", "state": "' || state || '", "value": ' || CASE WHEN state = 'present' THEN '"' || cents || '"' ELSE 'null' END || '}}, {{"concept_id": "account.segment", "state": "present", "value": "' || seg || '"}}'
  || CASE WHEN n > 0 THEN ', {{"concept_id": "orders.count", "state": "present", "value": "' || n || '"}}' ELSE '' END || '], "protocol_version": "0.1", "task": "t1", "tax_year": 2025}}' AS input,
  '{{"calculation_requests": ' || {_LIST.format('other', 'C-1')} || ', "candidate_forms": ' || {_LIST.format('high', 'F-1')} || ', "conflicts": ' || {_LIST.format("state = 'conflicting'", 'account.balance')} || ', "missing_information": [' || concat_ws(', ', CASE WHEN state <> 'present' THEN '"account.balance"' END, CASE WHEN idle THEN '"orders.count"' END)
  || '], "protocol_version": "0.1", "required_forms": ' || {_LIST.format('lim', 'F-2')} || ', "retrieval_requests": ' || {_LIST.format('lim', 'L-1')} || ', "source_documents": ["D-1"], "status": "' || {_STATUS} || '", "topics": [' || concat_ws(', ', CASE WHEN idle THEN '"idle"' END, CASE WHEN high THEN '"wealth"' END) || ']}}' AS target FROM a""")
def structured_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.build_examples(_example_rows(spark, sf_dir), ["t1"], ("structured",)).select("scenario_id", "input", "target")


@query(f"""WITH {_FACTS}, e AS (SELECT id, task, 'Tax year 2025. Facts: ' || {_SAID} || '. Task: ' || task || '.' AS input FROM a, (VALUES ('t1'), ('t2')) t(task)), c AS (SELECT input FROM e WHERE id LIKE '%7' GROUP BY input)
SELECT (SELECT count(*) FROM e) + (SELECT count(*) FROM e WHERE id LIKE '%7') AS examples, (SELECT count(DISTINCT input) FROM e) AS inputs, (SELECT count(*) FROM c) AS conflicts""")
def export_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples, distinct visible inputs, and inputs with incompatible targets: those of scenarios that end in 7 are answered once more, otherwise."""
    examples = export.build_examples(_example_rows(spark, sf_dir), ["t1", "t2"], ("concise",))
    again = examples.where(F.col("scenario_id").endswith("7")).withColumn("target", F.concat("target", F.lit(" (revised)")))
    both = examples.unionByName(again)
    bad = export.conflicting_targets(both).agg(F.count("*").alias("conflicts"))
    return both.agg(F.count("*").alias("examples"), F.count_distinct(stable_hash(json_string(F.col("input")))).alias("inputs")).crossJoin(F.broadcast(bad))  # one row each


TEMPLATES = [
    {"template_id": "T-SALE", "max_attempts": 100, "documents": ["FORM-B"], "constraints": [{"type": "before", "left": "bought", "right": "sold"}, {"type": "gte", "left": "proceeds", "right": 1000}],
     "events": [{"id": "e1", "type": "sale", "variables": ["bought", "sold", "proceeds"]}],
     "variables": [
         {"id": "bought", "concept_id": "asset.acquired", "generator": {"type": "date_year_offset", "values": [-2, -1, 0]}}, {"id": "sold", "concept_id": "asset.sold", "generator": {"type": "date_in_tax_year"}},
         {"id": "proceeds", "concept_id": "asset.proceeds", "generator": {"type": "money_range", "min": 0, "max": 100_000, "step": 100}}, {"id": "kind", "concept_id": "asset.kind", "generator": {"type": "weighted_choice", "values": ["share", "fund"], "weights": [3, 1]}},
     ]},
]


@query()
def generated_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scenario per supplier, with its child that lacks the proceeds."""
    n = table(spark, sf_dir, "supplier").count()
    base = scenarios.generate(spark, TEMPLATES, {"T-SALE": n}, 2025, 42)
    child = scenarios.mark_unknown(base, "asset.proceeds")
    cols = ["scenario_id", "family_id", "template_id", "tax_year", "attempt", "facts"]
    return base.select(*cols, F.lit("generated").alias("origin")).unionByName(child.select(*cols, F.lit("mutated").alias("origin")))
