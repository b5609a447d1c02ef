"""Clusters of rows that share keys, and their splits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.hashing import ID_DIGITS, cluster_bucket, cluster_split, json_array, json_string
from lumenfold.operators.components import connected_components, hot_limit, meet
from lumenfold.sources.storage import written


def shared_key_links(rows: DataFrame, node: str, *keys: str) -> DataFrame:
    """Links (a, b) from every row to the smallest row of its key: a star per key, never all pairs; rows of hot keys stay where they are."""
    out, total = None, rows.count()
    for key in keys:
        hubs = written(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(node).alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
        links = meet(rows.select(node, key), hubs, F.col("n") > hot_limit(total), key).select(F.col(node).alias("a"), F.col("hub").alias("b"))
        out = links if out is None else out.unionByName(links)
    return out.where("a != b").distinct()


def components(rows: DataFrame, node: str, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links lead to; single rows are their own."""
    found = connected_components(links).withColumnRenamed("node", "at")
    single = rows.select(node).distinct()
    return single.join(found, single[node] == found["at"], "left").select(node, F.coalesce("component", node).alias("component"))


def clusters(rows: DataFrame, node: str, *keys: str, seed: int = 42017, version: str = "v1") -> DataFrame:
    """(node, component, cluster_id, bucket, split): the id is a hash of the sorted members."""
    found = written(components(rows, node, shared_key_links(rows, node, *keys)), "members")
    hashed = member_hashes(found, node).join(found.groupBy("component").agg(F.count("*").alias("n")), "component")
    named = hashed.select("component", "n", F.concat(F.lit("CLUSTER-"), F.substring("digest", 1, ID_DIGITS["CLUSTER"])).alias("cluster_id"))
    placed = written(named.withColumn("bucket", cluster_bucket(F.col("cluster_id"), seed, version)).withColumn("split", cluster_split(F.col("cluster_id"), seed, version)), "clusters")
    return meet(found, placed, F.col("n") > hot_limit(found.count()), "component").select(node, "component", "cluster_id", "bucket", "split")


def member_hashes(found: DataFrame, node: str) -> DataFrame:
    """(component, digest): the stable hash of each component's list of members, as text and in order.

    Sorted members stream through a hash, so a component of any size needs
    one digest of memory and no list; sorting spills.
    """
    kind = T.StructType([found.select("component").schema[0], T.StructField("digest", T.StringType())])
    named = found.select("component", F.col(node).cast("string").alias("name"))
    ordered = named.repartition("component").sortWithinPartitions("component", "name").select("component", json_string(F.col("name")).alias("item"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for component, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or component != at:
                    if state is not None:
                        done.append(_closed(at, state))
                    at, state = component, hashlib.sha256(b"[[" + item.encode())
                else:
                    state.update(b"," + item.encode())
            yield _digest_rows(done, batch.schema.field(0).type)
            last = batch.schema.field(0).type
        if state is not None:
            yield _digest_rows([_closed(at, state)], last)

    return ordered.mapInArrow(hashed, kind)


def _closed(component, state) -> tuple:
    state.update(b"]]")
    return component, state.hexdigest()


def _digest_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], names=["component", "digest"])


def content_identity(*cols: str):
    """JSON array of string columns, for hashing a row's content."""
    return json_array(*[json_string(F.col(c)) for c in cols])
