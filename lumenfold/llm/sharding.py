"""Sharding by a k-d tree over metadata, split at distributed weighted medians.

A node is cut along the dimension that is widest there, relative to the
dimension's spread over all rows, at the weighted median, until leaves reach
the target bytes. One aggregation a level gives, for every node and dimension,
the spread and the one of ``BINS`` intervals that holds the middle of the
weight; the chosen dimension's interval, drawn in to the values that occur, is
halved further by the same histogram, now over its own rows only. Of each node
one row a dimension reaches the driver.

Metadata are those of a row's text: its length, and the smallest language,
source and doc_id that rows of equal text have. Languages and sources count by
their rank among all that occur, so whole names decide and each is a value of
its own. Rows that tie in a dimension are told apart by the text's hash, and
rows of one text by a hash of the row; so equal texts stay in one shard unless
the group alone is too heavy for an even cut, and a hot group is split rather
than making a shard too large.

Defined results: a null text has size 1 and crc32 of the empty text; null
metadata counts as the smallest value; rows that repeat are rows of their own;
an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import broadcast_if_small, hot_limit, meet, stash

BINS = 2048
#: A cut may miss the middle of its node by this share of the node's bytes.
TOLERANCE = 0.001
#: Up to this share, a cut beside a group of equal texts is better than one through it.
GROUP_TOLERANCE = 0.01
#: Rows that are numbered together within a shard.
SLOT_ROWS = 50_000
#: Bytes of values up to which a table of ranks is broadcast.
BROADCAST_BYTES = 16 << 20

#: Below all values: a tie that a cut does not look at.
_NONE = -(1 << 63)


@dataclass
class Cut:
    """Rows before the cut: those less in dimension ``dim``, then in each tie; values are in that order."""

    dim: int
    values: list[int]


def _value_of(dims: list[str], dim: str) -> Column:
    """The value of the dimension whose number is in column ``dim``."""
    return reduce(lambda out, k: F.when(F.col(dim) == k, F.col(dims[k])).otherwise(out), range(len(dims) - 1), F.col(dims[-1]))


def _with_row(placed: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """``placed`` with the row of its node (``rows``: node, then ``names``; longs) in column ``of``; null where there is none.

    Few rows become part of the plan; more are a broadcast of one row a node.
    """
    if len(rows) <= 64:
        each = [F.when(F.col("node") == r[0], F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(names, r[1:], strict=True)])) for r in rows]
        return placed.withColumn("of", F.coalesce(*each) if each else F.lit(None).cast(f"struct<{','.join(f'{n}:long' for n in names)}>"))
    table = placed.sparkSession.createDataFrame(rows, ", ".join(f"{x} long" for x in ["at_node", *names]))
    table = table.select("at_node", F.struct(*names).alias("of"))
    return placed.join(F.broadcast(table), F.col("node") == F.col("at_node"), "left").drop("at_node")


def _below(placed: DataFrame, cuts: dict[int, Cut], dims: list[str], ties: list[str]) -> DataFrame:
    """``placed`` with rows of cut nodes moved to the node's children, 2n and 2n + 1."""
    if not cuts:
        return placed
    names = ["dim", *[f"cut_{k}" for k in range(len(ties) + 1)]]
    rows = [(n, c.dim, *c.values, *[_NONE] * (1 + len(ties) - len(c.values))) for n, c in cuts.items()]
    found = _with_row(placed, rows, names)
    less = F.lit(False)
    for k, col in reversed(list(enumerate([_value_of(dims, "of.dim"), *map(F.col, ties)]))):
        less = (col < F.col(f"of.cut_{k}")) | ((col == F.col(f"of.cut_{k}")) & less)
    moved = F.when(F.col("of").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(less, 0).otherwise(1))
    return found.withColumn("node", moved.cast("long")).drop("of")


def _bin(value: Column, low: Column, high: Column) -> Column:
    """Which of ``BINS`` intervals from low to high holds the value."""
    return F.least(F.floor((value - low) / ((high - low) / BINS + F.lit(1e-300))), F.lit(BINS - 1)).cast("long")


def _middles(binned: DataFrame, by: list[str], weight: str, total: Column, known: Column) -> DataFrame:
    """Of each ``by`` the bin with the middle of ``total``: its least and greatest value, and the weight up to and in it.

    ``known`` is the weight before the first bin; at most ``BINS`` rows of a
    node are looked at together.
    """
    sums = binned.groupBy(*by, "bin").agg(F.sum(weight).alias("w"), F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.first(known).alias("known"), F.first(total).alias("given"))
    run, whole = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    upto = sums.withColumns({"upto": F.col("known") + F.sum("w").over(run), "total": F.coalesce("given", F.sum("w").over(whole)), "rows": F.sum("n").over(whole), "least": F.min("low").over(whole), "most": F.max("high").over(whole)})
    middle = upto.where(2 * F.col("upto") >= F.col("total"))
    return middle.groupBy(*by).agg(F.min(F.struct("bin", "upto", "w", "low", "high", "total", "rows", "least", "most")).alias("m")).select(*by, "m.*")


def _level_cuts(placed: DataFrame, dims: list[str], ties: list[str], weight: str, whole: dict, leaves: int | None, most: int) -> dict[int, Cut]:
    """For each node that is to be cut, the cut along its widest dimension that halves its weight."""
    ends = lambda c: (F.lit(whole[f"lo_{c}"]).cast("long"), F.lit(whole[f"hi_{c}"]).cast("long"))
    coordinates = F.array(*[F.struct(F.lit(k).alias("dim"), F.col(c).alias("value"), _bin(F.col(c), *ends(c)).alias("bin")) for k, c in enumerate(dims)])
    flat = placed.select("node", weight, F.inline(coordinates))
    found: dict[int, dict[int, Row]] = {}
    for r in _middles(flat, ["node", "dim"], weight, F.lit(None).cast("long"), F.lit(0).cast("long")).collect():
        found.setdefault(r["node"], {})[r["dim"]] = r
    done: dict[int, Cut] = {}
    state: dict[int, dict] = {}
    for n, per in found.items():
        if per[0]["rows"] > 1 and (leaves is not None or per[0]["total"] > most):
            share = lambda k, per=per: (per[k]["most"] - per[k]["least"]) / max(1, whole[f"hi_{dims[k]}"] - whole[f"lo_{dims[k]}"])
            dim = min(range(len(dims)), key=lambda k, share=share: (-share(k), k))
            state[n] = {"dim": dim, "fixed": []}
            _settle(n, per[dim], state, done, dims, ties, whole)
    names = ["dim", "k", "lo", "hi", "known", "total", *[f"fix_{k}" for k in range(len(ties) + 1)]]
    while state:
        rows = [(n, s["dim"], len(s["fixed"]), *s["range"], s["before"], s["total"], *s["fixed"], *[None] * (len(ties) + 1 - len(s["fixed"]))) for n, s in state.items()]
        columns = [_value_of(dims, "of.dim"), *map(F.col, ties)]
        here = reduce(lambda a, b: a & b, [F.col(f"of.fix_{k}").isNull() | (c == F.col(f"of.fix_{k}")) for k, c in enumerate(columns)])
        value = reduce(lambda out, k: F.when(F.col("of.k") == k, columns[k]).otherwise(out), range(len(columns) - 1), columns[-1])
        near = _with_row(placed, rows, names).where("of IS NOT NULL").withColumn("value", value).where(here & F.col("value").between(F.col("of.lo"), F.col("of.hi")))
        binned = near.select("node", weight, "value", _bin(F.col("value"), F.col("of.lo"), F.col("of.hi")).alias("bin"), F.col("of.known").alias("before"), F.col("of.total").alias("goal"))
        for r in _middles(binned, ["node"], weight, F.col("goal"), F.col("before")).collect():
            _settle(r["node"], r, state, done, dims, ties, whole)
    return done


def _settle(n: int, r: Row, state: dict[int, dict], done: dict[int, Cut], dims: list[str], ties: list[str], whole: dict) -> None:
    """Cuts node ``n`` beside the bin ``r`` if that halves it well enough, else says where to look next."""
    s = state[n]
    level, low, high, total = len(s["fixed"]), r["low"], r["high"], r["total"]
    under, over = total / 2 - (r["upto"] - r["w"]), r["upto"] - total / 2
    column = dims[s["dim"]] if level == 0 else ties[level - 1]
    may_miss = GROUP_TOLERANCE if low == high and column == "by_text" else TOLERANCE
    if min(under, over) <= may_miss * total or (low == high and level == len(ties)):
        done[n] = Cut(s["dim"], [*s["fixed"], low if under <= over else high + 1])
        del state[n]
        return
    s["before"], s["total"] = r["upto"] - r["w"], total
    if low == high:
        s["fixed"].append(low)
        s["range"] = (whole[f"lo_{ties[level]}"], whole[f"hi_{ties[level]}"])
    else:
        s["range"] = (low, high)


def kd_tree(rows: DataFrame, dims: list[str], ties: list[str], weight: str, leaves: int | None, most: int = 0) -> tuple[DataFrame, list[dict[int, Cut]]]:
    """``rows`` with the number of their leaf in ``node`` (root 1, children 2n and 2n + 1), and the cuts by level.

    Columns are long. Where ``leaves`` (a power of two) is None every node
    heavier than ``most`` is cut until only single rows are; the last of
    ``ties`` must then tell all rows apart. The driver holds a row for each
    node, that is for each shard.
    """
    placed, levels = rows.withColumn("node", F.lit(1).cast("long")), []
    whole = rows.agg(*[f(c).alias(f"{p}_{c}") for c in (*dims, *ties) for p, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n")).first().asDict()
    if not whole["n"]:
        return placed, levels
    for level in count() if leaves is None else range(int(math.log2(leaves))):
        cuts = _level_cuts(placed, dims, ties, weight, whole, leaves, most)
        if not cuts:
            break
        levels.append(cuts)
        placed = stash(_below(placed, cuts, dims, ties), f"kd-level-{level}")
    return placed, levels


def ranks(points: DataFrame, *names: str) -> dict[str, DataFrame]:
    """For each string column a table (value, rank): the place of every value that occurs among all in order; null and empty: 0.

    Values are sorted by ranges, so that any number of them may occur.
    """
    every = points.select(F.inline(F.array(*[F.struct(F.lit(k).alias("of"), F.coalesce(F.col(c), F.lit("")).alias("value")) for k, c in enumerate(names)])))
    listed = every.groupBy("of", "value").agg(F.count("*").alias("copies"))
    order = [F.col("of"), F.col("value")]
    placed = stash(listed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id()), "values").withColumn("part", F.shiftright("ord", 33))
    parts = placed.groupBy("of", "part").agg(F.min("ord").alias("first"), F.count("*").alias("n"))  # one row a task and column
    before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("of", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    ranked = placed.join(F.broadcast(starts), ["of", "part"]).select("of", "value", "copies", (F.col("ord") + F.col("shift") + 1).alias("rank"))
    ranked = stash(ranked, "ranks")
    return {c: ranked.where(F.col("of") == k).select("value", "copies", F.when(F.col("value") == "", 0).otherwise(F.col("rank")).cast("long").alias("rank")) for k, c in enumerate(names)}


def _ranked(points: DataFrame, name: str, table: DataFrame, rows: int) -> DataFrame:
    """``points`` with the rank of column ``name`` in its place."""
    keyed = table.select(F.col("value").alias(name), "copies", F.col("rank").alias(f"{name}_rank"))
    filled = points.withColumn(name, F.coalesce(F.col(name), F.lit("")))
    small = table.agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 16).alias("bytes")).first()
    joined = filled.join(F.broadcast(keyed), name) if (small["bytes"] or 0) <= BROADCAST_BYTES else meet(filled, keyed, F.col("copies") > hot_limit(rows), name)
    return joined.drop(name, "copies").withColumnRenamed(f"{name}_rank", name)


def shard(docs: DataFrame, leaves: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``leaves`` shards (a power of two), or, with ``leaves`` None, as many as
    keep a shard within ``target_bytes``, unless one row alone is heavier. The
    law is ``bytes``: shards hold nearly equal bytes. Dimensions: length,
    language, source and doc_id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    points = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.floor(F.log2(F.octet_length(text) + 1) * (1 << 20)).cast("long").alias("by_length"),
        F.col("lang").cast("string").alias("by_lang"),
        F.col("source").cast("string").alias("by_source"),
        F.xxhash64(text).alias("key"),
        F.shiftrightunsigned(F.xxhash64(text), 24).alias("by_text"),
        F.shiftrightunsigned(F.xxhash64("doc_id", text), 24).alias("by_row"),
    )
    if leaves is None:
        points = points.withColumn("by_copy", F.monotonically_increasing_id())  # tells repeated rows apart, which are alike in the result
    points = stash(points, "points")
    total = points.count()
    for name, table in ranks(points, "by_lang", "by_source").items():
        points = _ranked(points, name, table, total)
    least = [F.min(c).alias(f"least_{c}") for c in ("by_lang", "by_source")]
    groups = stash(points.groupBy("key").agg(F.count("*").alias("copies"), *least, F.min(F.coalesce("doc_id", F.lit(0))).alias("by_id")).where("copies > 1"), "equal-texts")
    alone = points.join(broadcast_if_small(groups.select("key")), "key", "left_anti").withColumn("by_id", F.coalesce("doc_id", F.lit(0)))
    shared = meet(points, groups, F.col("copies") > hot_limit(total), "key").drop("by_lang", "by_source", "copies").withColumnsRenamed({"least_by_lang": "by_lang", "least_by_source": "by_source"})
    rows = stash(alone.unionByName(shared).drop("key"), "placed-points")
    ties = ["by_text", "by_row"] if leaves is not None else ["by_text", "by_row", "by_copy"]
    placed, levels = kd_tree(rows, ["by_length", "by_lang", "by_source", "by_id"], ties, "size", leaves, target_bytes or 0)
    cut = {n for cuts in levels for n in cuts}
    found = [*({1} - cut), *(c for n in cut for c in (2 * n, 2 * n + 1) if c not in cut)]
    # Leaves are numbered from left to right: by their paths from the root.
    numbers = sorted(found, key=lambda n: bin(n)[3:] + "2")
    numbered = _with_row(placed, [(n, k) for k, n in enumerate(numbers)], ["shard"]).withColumn("shard", F.col("of.shard").cast("int"))
    return with_slots(numbered, "shard", max(1, math.ceil(total / (leaves or len(numbers)) / SLOT_ROWS))).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_slots(placed: DataFrame, shard_col: str, runs: int) -> DataFrame:
    """Adds ``slot``: a gapless number from 0 within each shard.

    A shard's rows are numbered in ``runs`` runs by hash, each starting where
    the counts of the runs before it end; no task numbers a whole shard.
    """
    rows = placed.withColumn("run", F.pmod(F.col("by_row"), F.lit(runs)).cast("int"))
    counts = rows.groupBy(shard_col, "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy(shard_col).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard_col).alias("of_shard"), F.col("run").alias("of_run"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(shard_col, "run").orderBy("by_row", "doc_id", "text_crc32"))
    starts = broadcast_if_small(stash(starts, "slot-starts"))
    return rows.withColumn("inside", inside).join(starts, (F.col(shard_col) == F.col("of_shard")) & (F.col("run") == F.col("of_run"))).withColumn("slot", (F.col("start") + F.col("inside") - 1).cast("long"))
