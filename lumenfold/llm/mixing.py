"""Mixing sources to target weights: capped water-filling and seeded repetition.

Every source has a weight; together they should give a stated total of words.
A source can be repeated at most ``epochs`` times, so its target is
``min(epochs * size, level * weight)``, with the water level at which targets
add up to the total. Clamping the sources above it and resharing their excess
by weight until none is above gives the same targets; here they come at once,
from one ordered pass over the table of sources.

A source's documents are taken ``floor(target / size)`` times, and in a seeded
order once more as long as they fit into the rest of the target; what is then
missing is filled with the one other document nearest to it in size, if that
lands nearer. Only whole documents are taken, and reruns agree.

Native: only DataFrame functions. Documents are not shuffled: the seeded order
is cut into ``BINS`` bins by hash prefix, bin totals (a small table) tell which
bins are wholly taken, and only the one bin per source that the target cuts is
sorted.

Defined results: null texts have size 0 and are taken as often as their source
asks; null sources are one source, last in order; sources without any word have
target 0. Every row is a document of its own, whether its doc_id is null or
repeats: the seeded order goes by doc_id and text. Which of several rows alike
in doc_id, source and text is taken once more is open. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import WORD_PATTERN, broadcast_if_small, fresh, stash

#: Bins of the seeded order, by the first three hex digits of its hash.
BINS = 4096


def n_words(text: str | Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: Column | None = None, epochs: int = 3) -> DataFrame:
    """Adds ``target`` (double) to a table of source, size (long) and weight (long).

    One row per source; ``total`` defaults to all sizes. The window runs over
    that table alone, which has as many rows as there are sources.
    """
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Fullest first: a source is clamped before another if its cap per weight is lower.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    levelled = (
        sources.withColumn("cap", F.col("size") * epochs)
        .withColumn("before", F.coalesce(F.sum("cap").over(order), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(order), F.lit(0)))
        .withColumn("total", (F.sum("size").over(everyone) if total is None else total))
        .withColumn("own_level", (F.col("total") - F.col("before")) / F.col("weight_left"))
    )
    open_level = F.min(F.when(F.col("own_level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("own_level").alias("level")))).over(everyone)
    level = F.coalesce(open_level["level"], F.lit(float("inf")))
    return levelled.withColumn("target", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap").cast("double"), level * F.col("weight")))).drop("cap", "before", "weight_left", "total", "own_level")


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Adds ``weight``: 1 to ``cycle``, repeating, in code point order with null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", ((place - 1) % cycle + 1).cast("long"))


def mix(docs: DataFrame, weights: DataFrame | None = None, epochs: int = 3, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, times, taken.

    ``weights`` (source, weight) defaults to the cyclic rule. A source that it
    lacks has weight 0 and target 0.
    """
    clear, edge, _ = _decide(docs, weights, epochs, seed)
    times = (F.col("whole") + F.col("once_more").cast("long")).cast("long")
    return clear.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def seeded_order(seed: int) -> Column:
    """The place of a row: a hash of seed, doc_id and text, as hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))


def bin_of(order: str | Column) -> Column:
    return F.conv(F.substring(order, 1, 3), 16, 10).cast("int")


def _decide(docs: DataFrame, weights: DataFrame | None, epochs: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clear, edge, plan): rows with ``whole`` and ``once_more``, and a row per source.

    The plan alone decides about clear rows: those outside a source's cut bin, but for the one
    document that fills the gap. The edge holds the others.
    """
    sized = stash(docs.select("doc_id", "source", n_words("text").alias("size"), seeded_order(seed).alias("order"), F.monotonically_increasing_id().alias("row")), "sizes")
    sized = sized.withColumn("bin", bin_of("order"))
    bins = stash(sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    sources = bins.groupBy("source").agg(F.sum("bin_size").alias("size"))
    if weights is None:
        weighted = cyclic_weights(sources)
    else:
        given = weights.select(F.col("source").alias("of"), F.col("weight").cast("long").alias("weight"))
        weighted = sources.join(given, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn("weight", F.coalesce("weight", F.lit(0)))
    filled = water_fill(weighted.where("weight > 0"), None, epochs).unionByName(weighted.where("weight <= 0").withColumn("target", F.lit(0.0)))
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0))
    plan = filled.withColumn("whole", F.floor(rate)).withColumn("rest", F.col("target") - F.col("whole") * F.col("size"))

    # Where in the seeded order the rest of the target runs out.
    left = plan.select(F.col("source").alias("of"), "rest")
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        bins.withColumn("before", F.coalesce(F.sum("bin_size").over(run), F.lit(0)))
        .join(left, F.col("source").eqNullSafe(F.col("of")))
        .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("bin_size") > F.col("rest")))
        .groupBy("source")
        .agg(F.min(F.struct("bin", "before")).alias("cut"))
        .select(F.col("source").alias("of"), "cut")
    )
    ready = plan.join(cut, F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("source").alias("of"), F.col("size").alias("source_size"), "target", "whole", "rest", F.coalesce("cut.bin", F.lit(BINS)).alias("cut_bin"), F.coalesce("cut.before", F.lit(0)).alias("cut_before")
    )
    ready = stash(ready, "mix-plan")
    planned = sized.join(broadcast_if_small(ready), F.col("source").eqNullSafe(F.col("of"))).drop("of")

    before_cut = (F.col("rest") > 0) & (F.col("bin") < F.col("cut_bin"))
    outside = planned.where(F.col("bin") != F.col("cut_bin")).withColumn("once_more", before_cut)
    inside = Window.partitionBy("source").orderBy("order", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = stash(planned.where(F.col("bin") == F.col("cut_bin")).withColumn("end", F.col("cut_before") + F.sum("size").over(inside)), "mix-edge")
    reached = F.coalesce(F.max(F.when(F.col("end") <= F.col("rest"), F.col("end"))), F.first("cut_before"))
    gaps = edge.groupBy("source").agg((F.first("rest") - reached).alias("gap")).select(F.col("source").alias("gap_of"), "gap")
    gaps = broadcast_if_small(stash(gaps, "mix-gaps"))
    edge = edge.withColumn("once_more", (F.col("rest") > 0) & (F.col("end") <= F.col("rest"))).drop("end")
    # The one document whose size is nearest to what is still missing, if that is nearer than none.
    spare = outside.unionByName(edge).where("NOT once_more").join(gaps, F.col("source").eqNullSafe(F.col("gap_of"))).withColumn("off", F.abs(F.col("size") - F.col("gap"))).where("off < gap")
    last = spare.groupBy("source").agg(F.min(F.struct("off", "order", "doc_id", "row")).alias("best")).select(F.col("source").alias("last_of"), F.col("best.order").alias("last_order"), F.col("best.row").alias("last_row"))
    full_plan = stash(ready.join(last, F.col("of").eqNullSafe(F.col("last_of")), "left").drop("last_of"), "mix-decided")
    last_row = broadcast_if_small(full_plan.where("last_row IS NOT NULL").select("last_row", "last_order", F.col("of").alias("last_of")))
    mark = lambda rows: rows.join(last_row, F.col("row") == F.col("last_row"), "left").withColumn("once_more", F.col("once_more") | F.col("last_row").isNotNull()).drop("last_row", "last_order", "last_of")
    return mark(outside), mark(edge), full_plan


def take_mix(docs: DataFrame, weights: DataFrame | None = None, epochs: int = 3, seed: int = 7) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; columns unchanged.

    Decisions follow from the row and the plan of its source; only rows of the
    bin that a target cuts, and those like the one that fills the gap, are
    looked up: by source and place in the seeded order.
    """
    names = ("order", "bin", "of", "whole", "rest", "cut_bin", "last_order", "at", "like", "more", "rows", "part", "place", "start", "times", "copy")
    own = {n: fresh(docs, f"mix_{n}") for n in names}
    outside, edge, plan = _decide(docs, weights, epochs, seed)
    plan = broadcast_if_small(plan.select(*[F.col(n).alias(own[n]) for n in ("of", "whole", "rest", "cut_bin", "last_order")]))
    c = {n: F.col(x) for n, x in own.items()}
    placed = docs.withColumn(own["order"], seeded_order(seed)).withColumn(own["bin"], bin_of(c["order"]))
    placed = placed.join(plan, docs["source"].eqNullSafe(c["of"]))
    open_ = (c["bin"] == c["cut_bin"]) | F.coalesce(c["order"] == c["last_order"], F.lit(False))
    clear = placed.where(~open_).withColumn(own["times"], c["whole"] + ((c["rest"] > 0) & (c["bin"] < c["cut_bin"])).cast("long"))

    # How many rows of one source and place are taken once more.
    gap_rows = outside.join(F.broadcast(plan.select(c["of"], c["last_order"])), F.col("source").eqNullSafe(c["of"]) & (F.col("order") == c["last_order"])).select("source", "order", "once_more")
    decided = edge.select("source", "order", "once_more").unionByName(gap_rows)
    counts = stash(decided.groupBy(F.col("source").alias(own["like"]), F.col("order").alias(own["at"])).agg(F.sum(F.col("once_more").cast("long")).alias(own["more"]), F.count("*").alias(own["rows"])), "mix-counts")
    looked_up = placed.where(open_).join(broadcast_if_small(counts), docs["source"].eqNullSafe(c["like"]) & (c["order"] == c["at"]))
    looked_up = stash(looked_up.withColumn(own["part"], F.spark_partition_id()), "mix-open")
    whole = looked_up.where((c["more"] == 0) | (c["more"] == c["rows"])).withColumn(own["times"], c["whole"] + (c["more"] > 0).cast("long"))
    # Rows alike of which some are taken once more are numbered in runs, one per written part.
    alike = (own["like"], own["at"], own["part"])
    some = looked_up.where((c["more"] > 0) & (c["more"] < c["rows"]))
    before = Window.partitionBy(own["like"], own["at"]).orderBy(own["part"]).rowsBetween(Window.unboundedPreceding, -1)
    starts = some.groupBy(*alike).agg(F.count("*").alias("n")).select(*alike, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(own["start"]))
    starts = broadcast_if_small(stash(starts.select(F.col(own["like"]).alias("s"), F.col(own["at"]).alias("o"), F.col(own["part"]).alias("p"), own["start"]), "mix-starts"))
    numbered = some.withColumn(own["place"], F.row_number().over(Window.partitionBy(*alike).orderBy(own["order"])))
    numbered = numbered.join(starts, c["like"].eqNullSafe(F.col("s")) & (c["at"] == F.col("o")) & (c["part"] == F.col("p"))).drop("s", "o", "p")
    numbered = numbered.withColumn(own["times"], c["whole"] + (c["start"] + c["place"] <= c["more"]).cast("long"))

    every = clear.select(*docs.columns, own["times"])
    for part in (whole, numbered):
        every = every.unionByName(part.select(*docs.columns, own["times"]))
    taken = every.where(c["times"] > 0).withColumn(own["copy"], F.explode(F.sequence(F.lit(1).cast("long"), c["times"].cast("long"))))
    return taken.select(*docs.columns)


#: The same mix by SQL alone.
ORACLE_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS ord, row_number() OVER () AS row FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM sized GROUP BY source),
l AS (SELECT *, 3 * size AS cap, (3 * size)::DOUBLE / weight AS fill, sum(size) OVER ()::BIGINT AS total,
  coalesce(sum(3 * size) OVER (ORDER BY (3 * size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY (3 * size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS weight_left FROM s),
o AS (SELECT *, (total - before)::DOUBLE / weight_left AS own_level FROM l),
v AS (SELECT coalesce(min_by(own_level, fill), 'inf'::DOUBLE) AS level FROM o WHERE own_level * weight <= cap),
t AS (SELECT source, size AS source_size, CASE WHEN size = 0 THEN 0.0::DOUBLE ELSE least(cap::DOUBLE, level * weight) END AS target FROM o, v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
q AS (SELECT *, target - whole * source_size AS rest FROM p),
r AS (SELECT d.doc_id, d.source, d.size, ord, row, source_size, target, whole, rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY ord, d.doc_id, d.size, row ROWS UNBOUNDED PRECEDING) AS ends
  FROM sized d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
g AS (SELECT source, rest - coalesce(max(ends) FILTER (WHERE ends <= rest), 0) AS gap FROM r GROUP BY source, rest),
n AS (SELECT r.source, min({'off': abs(size - gap), 'ord': ord, 'doc_id': doc_id, 'row': row}) AS best FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source WHERE ends > rest AND abs(size - gap) < gap GROUP BY r.source),
u AS (SELECT r.*, (whole + CASE WHEN (rest > 0 AND ends <= rest) OR coalesce(row = best.row, FALSE) THEN 1 ELSE 0 END)::BIGINT AS times
  FROM r LEFT JOIN n ON r.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, source, size, source_size, target, times, times * size AS taken FROM u
"""
