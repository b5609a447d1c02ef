"""Queries of scores, losses, seeds, routing, benchmarks and tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import metrics
from lumenfold.plans.base import query, table

_R = "round({0}, 9)"


@query("""WITH l AS (SELECT doc_id, list_filter(['good', CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL AND (quality = 1 OR x <> 'good')) AS gold, list_filter(['good', CASE WHEN doc_id % 5 = 0 THEN 'toxic' END], lambda x: x IS NOT NULL AND (doc_id % 7 <> 0 OR x <> 'good')) AS pred FROM labels),
n AS (SELECT *, len(list_intersect(pred, gold)) AS k, len(pred) AS p, len(gold) AS g FROM l),
s AS (SELECT doc_id, CASE WHEN p + g = 0 THEN 1.0 WHEN p = 0 THEN 0.0 ELSE k / p END AS precision, CASE WHEN p + g = 0 THEN 1.0 WHEN g = 0 THEN 0.0 ELSE k / g END AS recall, CASE WHEN k = p AND k = g THEN 1.0 ELSE 0.0 END AS exact FROM n)
SELECT doc_id, round(precision, 9)::DOUBLE AS precision, round(recall, 9)::DOUBLE AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9)::DOUBLE AS f1, exact::DOUBLE AS exact FROM s""")
def label_set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as sets against a rule of thumb."""
    names = lambda good, toxic: F.array_compact(F.array(F.when(good, "good"), F.when(toxic, "toxic")))
    scores = metrics.set_scores(names(F.col("doc_id") % 7 != 0, F.col("doc_id") % 5 == 0), names(F.col("quality") == 1, F.col("toxic") == 1))
    found = table(spark, sf_dir, "labels").select("doc_id", scores.alias("s"))
    return found.select("doc_id", *[F.round(f"s.{c}", 9).alias(c) for c in ("precision", "recall", "f1", "exact")])


@query("""WITH e AS (SELECT n_regionkey AS r, list_sort(list([n_nationkey % 3, n_nationkey % 4])) AS gold, list_sort(list([n_nationkey % 3, n_nationkey % 2])) AS pred FROM nation GROUP BY 1),
n AS (SELECT r, len(list_intersect(list_distinct(pred), list_distinct(gold))) AS k, len(list_distinct(pred)) AS p, len(list_distinct(gold)) AS g FROM e)
SELECT r AS region, round(k / p, 9)::DOUBLE AS precision, round(k / g, 9)::DOUBLE AS recall FROM n""")
def edge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set scores over edges: arrays of pairs."""
    key = F.col("n_nationkey")
    edges = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.collect_list(F.struct((key % 3).alias("a"), (key % 2).alias("b"))).alias("pred"), F.collect_list(F.struct((key % 3).alias("a"), (key % 4).alias("b"))).alias("gold"))
    found = edges.select("region", metrics.set_scores(F.col("pred"), F.col("gold")).alias("s"))
    return found.select("region", F.round("s.precision", 9).alias("precision"), F.round("s.recall", 9).alias("recall"))


@query("SELECT count(*) FILTER (WHERE b AND a) AS unchanged_correct, count(*) FILTER (WHERE b AND NOT a) AS regression, count(*) FILTER (WHERE NOT b AND a) AS fix, count(*) FILTER (WHERE NOT b AND NOT a) AS unchanged_wrong FROM (SELECT quality = 1 AS b, toxic = 0 AS a FROM labels)")
def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.paired_counts(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0)


@query("SELECT avg((quality = 1 - toxic)::INT)::DOUBLE AS accuracy, avg(quality) - avg(toxic) AS delta_higher, avg(toxic) - avg(quality) AS delta_lower FROM labels")
def status_and_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    found = rows.agg(F.avg(metrics.status_accuracy(F.col("quality"), 1 - F.col("toxic"))).alias("accuracy"), F.avg("toxic").alias("t"), F.avg("quality").alias("q"))
    delta = lambda d: metrics.metric_delta(F.col("t"), F.col("q"), F.lit(d))
    return found.select("accuracy", delta("higher").alias("delta_higher"), delta("lower").alias("delta_lower"))


@query("SELECT event_id, json_valid(t)::INT::DOUBLE AS json_valid, CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' AND json_exists(t, '$.k') THEN 1.0 ELSE 0.0 END::DOUBLE AS schema_valid FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props || '}' WHEN 1 THEN '[' || props || ']' ELSE props END AS t FROM events)")
def json_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties, some of which are broken or wrapped in a list."""
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, F.concat("props", F.lit("}"))).when(kind == 1, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("t")).select("event_id", metrics.json_scores(F.col("t"), ["k"]).alias("s")).select("event_id", "s.*")


@query("SELECT user_id, event_id, consumed, round(consumed / 50.0, 9)::DOUBLE AS effective_passes FROM (SELECT user_id, event_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS consumed FROM events)")
def cumulative_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.length("props").alias("tokens"))
    return metrics.effective_passes(rows, "event_id", "tokens", 50, "user_id").select("user_id", "event_id", "consumed", F.round("effective_passes", 9).alias("effective_passes"))


@query("SELECT round(loss, 9) AS loss, round(exp(loss), 6) AS perplexity FROM (SELECT sum(cents)::DOUBLE / 10000.0 / sum(n)::BIGINT AS loss FROM (SELECT round(value * 100)::BIGINT AS cents, length(props) AS n FROM events))")
def teacher_forced_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.round(F.col("value") * 100).cast("long").alias("cents"), F.length("props").alias("tokens"))
    total = rows.agg(F.sum("cents").cast("double").alias("c"), F.sum("tokens").alias("tokens")).select((F.col("c") / 10000.0).alias("loss_sum"), "tokens")
    return metrics.token_weighted_loss(total).select(F.round("loss", 9).alias("loss"), F.round("perplexity", 6).alias("perplexity"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.seed_summary(table(spark, sf_dir, "events"), "value", "event_type").select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@query("SELECT event_type, count(*) FILTER (WHERE value > 10) AS better, count(*) AS n FROM events GROUP BY event_type")
def direction_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.direction_consistency(table(spark, sf_dir, "events"), "value", 10.0, True, "event_type")


@query("SELECT event_type, user_id % 10 AS step, round(avg(value), 6) AS loss, sum(length(props))::BIGINT AS tokens, count(*) AS microbatches FROM events GROUP BY ALL")
def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("step"), F.col("value").alias("loss"), F.length("props").alias("tokens"))
    return metrics.step_metrics(rows, "event_type", "step").withColumn("loss", F.round("loss", 6))


@query("SELECT event_type, round(avg(value), 6) AS loss, round(sum(length(props)) / sum((event_id % 7 + 1) / 8.0), 6)::DOUBLE AS tokens_per_second FROM events WHERE user_id >= 3 GROUP BY event_type")
def benchmark_after_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("step"), F.col("value").alias("loss"), F.length("props").alias("tokens"), ((F.col("event_id") % 7 + 1) / 8.0).alias("step_time"))
    return metrics.after_warmup(rows, 3, "event_type").select("event_type", F.round("loss", 6).alias("loss"), F.round("tokens_per_second", 6).alias("tokens_per_second"))


# Routing: the dimensions of an embedding are the logits of as many experts -----

EXPERTS = 64

_LOGITS = "l AS (SELECT vec_id, embedding AS x FROM embeddings), e AS (SELECT vec_id, unnest(range(64))::INT AS expert, unnest(x)::DOUBLE AS v FROM l)"
_ROUTED = f"{_LOGITS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, expert) AS place, exp(v - max(v) OVER (PARTITION BY vec_id)) AS ex FROM e), p AS (SELECT *, ex / sum(ex) OVER (PARTITION BY vec_id) AS prob FROM r)"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", logits.alias("logits"))
    return rows.select("vec_id", metrics.top_k_experts(F.col("logits"), 2).alias("t"), metrics.softmax(F.col("logits")).alias("probabilities")).select("vec_id", "probabilities", "t.experts", "t.weights")


@query(f"WITH {_ROUTED}, k AS (SELECT vec_id, expert, place, round(ex / sum(ex) OVER (PARTITION BY vec_id), 9) AS weight FROM r WHERE place <= 2) SELECT vec_id, place::INT AS place, expert, weight FROM k")
def topk_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _routed(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip("experts", "weights")).alias("pos", "e"))
    return found.select("vec_id", (F.col("pos") + 1).alias("place"), F.col("e.experts").alias("expert"), F.round("e.weights", 9).alias("weight"))


_BALANCE = f"""{_ROUTED}, n AS (SELECT count(*) AS n FROM l), b AS (SELECT expert, sum(prob) / any_value(n) AS probability_mass, count(*) FILTER (WHERE place <= 2) AS assignment_count, count(*) FILTER (WHERE place <= 2) / (any_value(n) * 2) AS assignment_fraction,
  count(*) FILTER (WHERE place <= 2) / any_value(n) AS inclusion_rate, count(*) FILTER (WHERE place = 1) / any_value(n) AS top1_share FROM p, n GROUP BY expert)"""


@query(f"WITH {_BALANCE} SELECT expert, round(probability_mass, 9) AS probability_mass, assignment_count, round(assignment_fraction, 9) AS assignment_fraction, round(inclusion_rate, 9) AS inclusion_rate, round(top1_share, 9) AS top1_share FROM b")
def balance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.expert_balance(_routed(spark, sf_dir), EXPERTS, 2)
    return found.select("expert", "assignment_count", *[F.round(c, 9).alias(c) for c in ("probability_mass", "assignment_fraction", "inclusion_rate", "top1_share")])


@query(f"WITH {_BALANCE}, h AS (SELECT avg(x) AS mean_entropy FROM (SELECT -sum(greatest(prob, 1e-12) * ln(greatest(prob, 1e-12))) AS x FROM p GROUP BY vec_id)) SELECT round(64 * sum(assignment_fraction * probability_mass), 9) AS loss, round(any_value(mean_entropy), 9) AS mean_entropy, min(assignment_fraction) > 0 AND max(top1_share) < 0.95 AS healthy FROM b, h")
def routing_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance loss, entropy and health of the routing: one row."""
    rows = _routed(spark, sf_dir)
    balance = metrics.expert_balance(rows, EXPERTS, 2)
    one = metrics.balance_loss(balance, EXPERTS).crossJoin(F.broadcast(metrics.mean_entropy(rows))).crossJoin(F.broadcast(metrics.routing_health(balance)))  # one row each
    return one.select(F.round("loss", 9).alias("loss"), F.round("mean_entropy", 9).alias("mean_entropy"), "healthy")


@query(f"WITH {_ROUTED} SELECT a.expert || '-' || b.expert AS pair, count(*) AS n FROM (SELECT * FROM r WHERE place <= 2) a JOIN (SELECT * FROM r WHERE place <= 2) b ON a.vec_id = b.vec_id AND a.expert < b.expert GROUP BY 1")
def expert_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.expert_pairs(_routed(spark, sf_dir))


@query(f"WITH {_ROUTED}, k AS (SELECT vec_id, expert, ex / sum(ex) OVER (PARTITION BY vec_id) AS weight FROM r WHERE place <= 2) SELECT vec_id AS token, round(sum(weight * (expert + 1)), 9) AS y FROM k GROUP BY 1")
def weighted_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of the chosen experts, weighted and added; expert e answers e + 1."""
    chosen = _routed(spark, sf_dir).select(F.col("vec_id").alias("token"), F.explode(F.arrays_zip("experts", "weights")).alias("e")).select("token", F.col("e.experts").alias("expert"), F.col("e.weights").alias("weight"))
    outputs = chosen.select("token", "expert", (F.col("expert") + 1).cast("double").alias("y"))
    return metrics.dispatch(chosen, outputs).withColumn("y", F.round("y", 9))


@query("SELECT vec_id, 'expert' AS problem FROM embeddings WHERE vec_id % 5 = 1 UNION ALL SELECT vec_id, 'not normalised' FROM embeddings WHERE vec_id % 5 = 2 UNION ALL SELECT vec_id, 'shape' FROM embeddings WHERE vec_id % 5 = 3")
def routing_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router outputs that are spoilt in three ways."""
    kind = F.col("vec_id") % 5
    rows = _routed(spark, sf_dir).withColumn("experts", F.when(kind == 1, F.array(F.lit(EXPERTS), F.lit(0))).when(kind == 3, F.array(F.lit(0))).otherwise(F.col("experts")))
    rows = rows.withColumn("probabilities", F.when(kind == 2, F.transform("probabilities", lambda p: p * 2)).otherwise(F.col("probabilities")))
    return metrics.routing_problems(rows, EXPERTS, 2).select("vec_id", "problem")


@query("""WITH e AS (SELECT vec_id // 16 AS token, vec_id % 3 AS feature, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT token, i::INT AS i, round(coalesce(avg(v) FILTER (WHERE feature <> 0), 0), 6) AS pooled FROM e GROUP BY ALL""")
def masked_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each token's features, sixteen of them, of which every third is padding."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 16").alias("token"), F.struct("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("vector")).alias("r"))
    held = rows.groupBy("token").agg(F.array_sort(F.collect_list("r")).alias("rows"))  # sixteen at most
    pooled = metrics.masked_mean(F.transform("rows", lambda r: r["vec_id"] % 3), F.transform("rows", lambda r: r["vector"]))
    return held.select("token", F.posexplode(pooled).alias("i", "v")).select("token", "i", F.round("v", 6).alias("pooled"))


@query("WITH r AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'bf16' ELSE 'fp32' END AS precision, (256 * (1 + o_custkey % 4))::INT AS sequence_length, (1 + o_orderkey % 7)::INT AS microbatch_size, o_orderstatus = 'F' AS ok, o_orderpriority < '3' AS ck FROM orders), m AS (SELECT sequence_length, max(microbatch_size) FILTER (WHERE ok) AS mx FROM r WHERE precision = 'bf16' GROUP BY 1) SELECT m.sequence_length, mx AS max_microbatch, greatest(1, mx // 2)::INT AS recommended, bool_and(ck) AS checkpointing FROM m JOIN r ON r.sequence_length = m.sequence_length AND microbatch_size = mx AND ok AND precision = 'bf16' GROUP BY ALL")
def safe_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.when(F.col("o_orderkey") % 2 == 0, "bf16").otherwise("fp32").alias("precision"), (256 * (1 + F.col("o_custkey") % 4)).cast("int").alias("sequence_length"), (1 + F.col("o_orderkey") % 7).cast("int").alias("microbatch_size"), F.when(F.col("o_orderstatus") == "F", "pass").otherwise("fail").alias("status"), (F.col("o_orderpriority") < "3").alias("gradient_checkpointing"))
    return metrics.safe_envelope(rows, "bf16")


@query("SELECT p_brand AS kind, sum(p_size)::BIGINT AS parameters, sum(CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END)::BIGINT AS trainable FROM part GROUP BY p_brand")
def parameter_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), F.col("p_size").cast("long").alias("numel"), (F.col("p_partkey") % 2 == 0).alias("trainable"))
    return metrics.parameter_inventory(rows, "kind")


@query("SELECT round(max(abs(a - b)), 6) AS max_abs, round(avg(abs(a - b)), 6) AS mean_abs, round(max(abs(a - b) / greatest(abs(b), 1e-12)), 6) AS max_rel, bool_and(abs(a - b) <= 1e-5 + 1e-4 * abs(b)) AS allclose FROM (SELECT o_totalprice AS a, o_totalprice * (1 + (o_custkey % 10) / 100000.0::DOUBLE) AS b FROM orders)")
def tensor_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("a"), (F.col("o_totalprice") * (1 + F.col("o_custkey") % 10 / 100000.0)).alias("b"))
    return metrics.compare_tensors(rows.select("i", F.col("a").alias("v")), rows.select("i", F.col("b").alias("v"))).select(*[F.round(c, 6).alias(c) for c in ("max_abs", "mean_abs", "max_rel")], "allclose")


@query("SELECT o_orderkey, (round(o_totalprice * 100)::BIGINT - round(o_totalprice * 90)::BIGINT) AS gain_cents, (o_orderdate::DATE + (o_custkey % 365)::INT)::VARCHAR AS due, make_date(year(o_orderdate) - 1, 1, 1)::VARCHAR AS earliest FROM orders")
def money_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains in cents and calendar shifts."""
    from lumenfold.operators.export import CALCULATIONS

    cents = lambda k: F.round(F.col("o_totalprice") * k).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", CALCULATIONS.run("capital_gain", cents(100), cents(90)).alias("gain_cents"), F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 365).cast("int")).cast("string").alias("due"), F.make_date(F.year("o_orderdate") - 1, F.lit(1), F.lit(1)).cast("string").alias("earliest"))
