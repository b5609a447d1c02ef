"""Metrics: set scores, paired outcomes, losses, seeds, routing, balance, benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scores ------------------------------------------------------------------


def set_scores(predicted: Column, gold: Column) -> Column:
    """struct(precision, recall, f1, exact) of two arrays as sets; two empty ones agree wholly."""
    p, g = (F.array_distinct(F.coalesce(c, F.array())) for c in (predicted, gold))
    common = F.size(F.array_intersect(p, g))
    share = lambda n: F.when(F.size(n) > 0, common / F.size(n)).otherwise(F.lit(0.0))
    both_empty = (F.size(p) == 0) & (F.size(g) == 0)
    precision, recall = share(p), share(g)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    one = lambda c: F.when(both_empty, F.lit(1.0)).otherwise(c)
    exact = ((F.size(F.array_except(p, g)) == 0) & (F.size(F.array_except(g, p)) == 0)).cast("double")
    return F.struct(one(precision).alias("precision"), one(recall).alias("recall"), one(f1).alias("f1"), exact.alias("exact"))


def status_accuracy(predicted: Column, gold: Column) -> Column:
    return predicted.eqNullSafe(gold).cast("double")


def json_scores(text: Column, required: list[str]) -> Column:
    """struct(json_valid, schema_valid): whether a text is JSON, and an object with the keys.

    The parser stops after one value; what follows it shows when the text is
    read once inside a list and once inside an object: no text but a single
    value is good in both places.
    """
    parsed = F.try_parse_json(text)
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    has = F.lit(True)
    for key in required:
        has = has & F.array_contains(F.json_object_keys(text), key)
    valid = F.coalesce(parsed.isNotNull() & whole, F.lit(False))
    return F.struct(valid.cast("double").alias("json_valid"), F.coalesce(valid & is_object & has, F.lit(False)).cast("double").alias("schema_valid"))


def paired_counts(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    return rows.agg(
        F.count_if(before & after).alias("unchanged_correct"), F.count_if(before & ~after).alias("regression"), F.count_if(~before & after).alias("fix"), F.count_if(~before & ~after).alias("unchanged_wrong")
    )


def metric_delta(baseline: Column, candidate: Column, direction: Column) -> Column:
    return F.when(direction == "higher", candidate - baseline).otherwise(baseline - candidate)


def token_weighted_loss(rows: DataFrame, loss_sum: str = "loss_sum", tokens: str = "tokens") -> DataFrame:
    """(loss, perplexity) over all tokens: infinite at 50 and beyond, NaN without tokens."""
    total = rows.agg(F.sum(loss_sum).cast("double").alias("l"), F.coalesce(F.sum(tokens), F.lit(0)).alias("n"))
    loss = F.when(F.col("n") > 0, F.col("l") / F.col("n")).otherwise(F.lit(float("nan")))
    return total.select(loss.alias("loss")).select("loss", F.when(F.isnan("loss"), F.col("loss")).when(F.col("loss") >= 50, F.lit(float("inf"))).otherwise(F.exp("loss")).alias("perplexity"))


def seed_summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, sample deviation (0 for fewer than two values), min and max."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def direction_consistency(rows: DataFrame, value: str, baseline: Column | float, higher: bool = True, *by: str) -> DataFrame:
    base = F.lit(baseline) if isinstance(baseline, float) else baseline
    better = F.col(value) > base if higher else F.col(value) < base
    return rows.groupBy(*by).agg(F.count_if(better).alias("better"), F.count("*").alias("n"))


def effective_passes(rows: DataFrame, step: str, tokens: str, unique_tokens: Column | int, *by: str) -> DataFrame:
    """Adds tokens consumed so far and how many passes over the unique tokens they are."""
    total = F.lit(unique_tokens) if isinstance(unique_tokens, int) else unique_tokens
    so_far = F.sum(tokens).over(Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("consumed", so_far).withColumn("effective_passes", F.when(total > 0, F.col("consumed") / total).otherwise(F.lit(0.0)))


def step_metrics(micro: DataFrame, *by: str) -> DataFrame:
    """Losses averaged and tokens summed over the microbatches of a step."""
    return micro.groupBy(*by).agg(F.avg("loss").alias("loss"), F.sum("tokens").alias("tokens"), F.count("*").alias("microbatches"))


# Routing -----------------------------------------------------------------


def softmax(values: Column) -> Column:
    """Exponentials over their sum; maximum and sum are computed once, so that the work is linear in the values."""
    once = lambda value, body: F.transform(F.array(value), body)[0]
    shifted = once(values, lambda v: once(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    return once(shifted, lambda e: once(F.aggregate(e, F.lit(0.0).cast("double"), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))


def top_k_experts(logits: Column, k: int = 2) -> Column:
    """struct(experts, weights): the k largest logits, of equals the smaller expert, and their softmax."""
    placed = F.transform(logits, lambda v, i: F.struct((-v.cast("double")).alias("key"), i.alias("expert")))
    best = F.slice(F.array_sort(placed), 1, k)
    return F.struct(F.transform(best, lambda b: b["expert"]).alias("experts"), softmax(F.transform(best, lambda b: -b["key"])).alias("weights"))


def expert_balance(rows: DataFrame, n_experts: int, k: int, probs: str = "probabilities", experts: str = "experts") -> DataFrame:
    """Per expert: probability mass, assignment count and fraction, inclusion rate, top-1 share.

    ``rows`` are the valid tokens. One pass: each row gives its k assignments
    and n probabilities as struct arrays, summed per expert with map-side
    combination.
    """
    tokens = rows.agg(F.count("*").alias("n_tokens"))
    per_prob = rows.select(F.posexplode(probs).alias("expert", "p"))
    mass = per_prob.groupBy("expert").agg(F.sum("p").alias("p"))
    counts = rows.select(F.explode(experts).alias("expert")).groupBy("expert").agg(F.count("*").alias("c"))
    first = rows.select((F.array_position(probs, F.array_max(probs)) - 1).cast("int").alias("expert")).groupBy("expert").agg(F.count("*").alias("t"))
    every = rows.sparkSession.range(n_experts).select(F.col("id").cast("int").alias("expert"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    # n_experts rows and one row: small by construction
    joined = every.join(F.broadcast(mass), "expert", "left").join(F.broadcast(counts), "expert", "left").join(F.broadcast(first), "expert", "left").crossJoin(F.broadcast(tokens))
    return joined.select(
        "expert", (F.coalesce("p", F.lit(0.0)) / F.col("n_tokens")).alias("probability_mass"), zero(F.col("c")).alias("assignment_count"), (zero(F.col("c")) / (F.col("n_tokens") * k)).alias("assignment_fraction"),
        (zero(F.col("c")) / F.col("n_tokens")).alias("inclusion_rate"), (zero(F.col("t")) / F.col("n_tokens")).alias("top1_share"),
    )


def balance_loss(balance: DataFrame, n_experts: int, *by: str) -> DataFrame:
    return balance.groupBy(*by).agg((n_experts * F.sum(F.col("assignment_fraction") * F.col("probability_mass"))).alias("loss"))


def mean_entropy(rows: DataFrame, probs: str = "probabilities") -> DataFrame:
    h = F.aggregate(F.transform(probs, lambda p: F.greatest(p, F.lit(1e-12))), F.lit(0.0).cast("double"), lambda a, p: a - p * F.log(p))
    return rows.agg(F.avg(h).alias("mean_entropy"))


def expert_pairs(rows: DataFrame, experts: str = "experts") -> DataFrame:
    """Unordered pairs of the two experts of a token, counted."""
    e = F.col(experts)
    return rows.groupBy(F.concat_ws("-", F.least(e[0], e[1]), F.greatest(e[0], e[1])).alias("pair")).agg(F.count("*").alias("n"))


def routing_problems(rows: DataFrame, n_experts: int, k: int, probs: str = "probabilities", experts: str = "experts") -> DataFrame:
    """Rows whose router output has a wrong shape, is not normalised, or names an unknown expert."""
    total = F.aggregate(probs, F.lit(0.0).cast("double"), lambda a, p: a + p)
    what = (
        F.when((F.size(probs) != n_experts) | (F.size(experts) != k), "shape")
        .when(F.exists(probs, lambda p: p.isNull() | F.isnan(p) | (p < 0) | (p == float("inf"))), "probability")
        .when(F.abs(total - 1) > 1e-5, "not normalised")
        .when(F.exists(experts, lambda e: (e < 0) | (e >= n_experts)), "expert")
    )
    return rows.withColumn("problem", what).where("problem IS NOT NULL")


def routing_health(balance: DataFrame, *by: str, most_top1: float = 0.95) -> DataFrame:
    """Healthy: all finite, every expert used, none the first choice too often."""
    finite = F.bool_and(~F.isnan("probability_mass") & (F.abs("probability_mass") < float("inf")))
    return balance.groupBy(*by).agg((finite & (F.min("assignment_fraction") > 0) & (F.max("top1_share") < most_top1)).alias("healthy"))


def dispatch(assignments: DataFrame, outputs: DataFrame, token: str = "token") -> DataFrame:
    """Per token the weighted sum of its experts' outputs: assignments (token, expert, weight), outputs (token, expert, y)."""
    return assignments.join(outputs, [token, "expert"]).groupBy(token).agg(F.sum(F.col("weight") * F.col("y")).alias("y"))


def masked_mean(features: Column, vectors: Column) -> Column:
    """Mean of the vectors (array of arrays) whose feature id is not the padding 0; zeros if none."""
    used = F.filter(F.arrays_zip(features.alias("f"), vectors.alias("v")), lambda x: x["f"] != 0)
    width = F.size(vectors[0])
    return F.transform(F.sequence(F.lit(0), width - 1), lambda d: F.when(F.size(used) > 0, F.aggregate(used, F.lit(0.0).cast("double"), lambda a, x: a + F.element_at(x["v"], d + 1)) / F.size(used)).otherwise(F.lit(0.0)))


# Benchmarks and tensors --------------------------------------------------


def safe_envelope(results: DataFrame, precision: str) -> DataFrame:
    """Per sequence length: largest passing microbatch, the recommended half of it, whether it needs checkpointing."""
    own = results.where(F.col("precision") == precision)
    passed = F.col("status") == "pass"
    most = own.groupBy("sequence_length").agg(F.max(F.when(passed, F.col("microbatch_size"))).alias("max_microbatch"))
    at_most = own.where(passed).groupBy("sequence_length", "microbatch_size").agg(F.bool_and("gradient_checkpointing").alias("all_checkpointed"))
    joined = most.join(at_most.withColumnRenamed("microbatch_size", "max_microbatch"), ["sequence_length", "max_microbatch"], "left")
    return joined.select("sequence_length", "max_microbatch", F.when(F.col("max_microbatch").isNotNull(), F.greatest(F.lit(1), F.floor(F.col("max_microbatch") / 2))).cast("int").alias("recommended"), F.coalesce("all_checkpointed", F.lit(False)).alias("checkpointing"))


def after_warmup(steps: DataFrame, warmup: int, *by: str) -> DataFrame:
    return steps.where(F.col("step") >= warmup).groupBy(*by).agg(F.avg("step_time").alias("step_time"), F.avg("loss").alias("loss"), (F.sum("tokens") / F.sum("step_time")).alias("tokens_per_second"))


def parameter_inventory(parameters: DataFrame, *by: str) -> DataFrame:
    return parameters.groupBy(*by).agg(F.sum("numel").alias("parameters"), F.sum(F.when(F.col("trainable"), F.col("numel")).otherwise(0)).alias("trainable"))


def compare_tensors(left: DataFrame, right: DataFrame, atol: float = 1e-5, rtol: float = 1e-4, key: str = "i") -> DataFrame:
    """Largest and mean absolute difference, largest relative one, and closeness, by position."""
    both = left.select(key, F.col("v").alias("a")).join(right.select(key, F.col("v").alias("b")), key)
    diff = F.abs(F.col("a") - F.col("b"))
    return both.agg(F.max(diff).alias("max_abs"), F.avg(diff).alias("mean_abs"), F.max(diff / F.greatest(F.abs(F.col("b")), F.lit(1e-12))).alias("max_rel"), F.bool_and(diff <= atol + rtol * F.abs(F.col("b"))).alias("allclose"))
