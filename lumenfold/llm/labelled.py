"""A bounded sample of labelled documents for fitting small models.

The bound is the parameter ``limit``: the labelled rows with the smallest
seeded hashes of their ids are taken, the same at every run. At most ``limit``
ids exist on the driver or in a broadcast, whatever the size of the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled documents for which ``use`` holds.

    ``use`` is a condition on doc_id. Null ids and labels are left out; of
    several labels of one id the largest counts. A label is 0 or 1. Of several
    rows of one id the smallest text is taken, so no more than ``limit`` rows
    come back.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & use)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(20_240_611)), "doc_id")
        .limit(limit)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Texts of an id are reduced before the shuffle, so an id that many rows share is no single task's load.
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
