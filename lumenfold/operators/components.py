"""Connected components by alternating stars, with bounded work for any one node.

In a large-star round every node moves its larger neighbours to the smallest
node it knows of; in a small-star round it moves its smaller neighbours and
itself. Edges never grow in number, and end as stars whose centres are the
smallest nodes. A round is a minimum per node, which combines before the
shuffle, and one lookup of these minima; minima of nodes with very many edges
are broadcast (`meet`), so no task gathers a hub.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.sources.storage import written

#: A key with more rows than this, and than 1 / HOT_KEYS of all, is hot; so there are never more than HOT_KEYS hot keys.
HOT_ROWS, HOT_KEYS = 256, 400_000


def hot_limit(rows: int) -> int:
    """How many rows of one key, of ``rows`` in all, a task may join."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def meet(rows: DataFrame, keyed: DataFrame, hot: Column, key: str) -> DataFrame:
    """``rows`` joined with ``keyed`` (written, each key once); rows of keys for which ``hot`` holds meet a broadcast where they are."""
    known = F.broadcast(keyed.where(hot))
    cold = rows.join(F.broadcast(keyed.where(hot).select(key)), key, "left_anti").join(keyed.where(~hot), key)
    return rows.join(known, key).unionByName(cold)


def large_star(edges: DataFrame, limit: int) -> DataFrame:
    """Edges (u > v): each node's larger neighbours, with the smallest node that it or they know through it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "nearest")
    return meet(both.where("v > u"), near, F.col("n") > limit, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, limit: int) -> DataFrame:
    """Edges (u > v): each node and its smaller neighbours, with the smallest of them."""
    near = written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "nearest")
    moved = meet(edges, near, F.col("n") > limit, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of a link; component is its smallest reachable node.

    Links of a node to itself are fine; null ends are ignored, repeated links
    count once. An empty table gives an empty result. Rounds end when a pair
    of them changes nothing; there are some few for stars, and for a chain
    about twice as many as its length has binary digits.
    """
    clean = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    edges = written(clean.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    nodes = clean.select(F.col("a").alias("node")).unionByName(clean.select(F.col("b").alias("node"))).distinct()
    mark = _mark(edges)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        limit = hot_limit(mark[0])
        edges = written(small_star(written(large_star(edges, limit), "edges"), limit), "edges")
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    ends = edges.select(F.col("u").alias("at"), F.col("v").alias("component"))  # each node once
    return written(nodes.join(ends, nodes["node"] == ends["at"], "left").select("node", F.coalesce("component", "node").alias("component")), "components")


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and two sums of their hashes: equal marks, equal edges."""
    a, b = F.xxhash64("u", "v"), F.xxhash64("v", F.lit(1), "u")
    return tuple(edges.agg(F.count("*"), F.sum(a.cast("decimal(38,0)")), F.sum(b.cast("decimal(38,0)"))).head())
