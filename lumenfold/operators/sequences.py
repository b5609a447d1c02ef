"""Token sequences: labels, blocks, padding, fixed-width features, overflow."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100


def blocks(length: Column, size: int) -> Column:
    """array of struct(start, end): consecutive blocks of at most ``size`` tokens.

    No last block of one token: the block before it gives one up. In closed
    form: where the remainder is 1, the last border moves back by one.
    """
    if size < 3:
        raise ValueError("blocks need at least 3 tokens")
    count = F.ceil(length / size)
    alone = (length % size == 1) & (length > size)

    def border(k: Column) -> Column:
        return F.when(k == count, length).otherwise(k * size - F.when(alone & (k == count - 1), 1).otherwise(0)).cast("long")

    return F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda k: F.struct(border(k).alias("start"), border(k + 1).alias("end")))


def token_blocks(records: DataFrame, size: int, id_col: str = "record_id", ids_col: str = "input_ids", labels_col: str = "labels") -> DataFrame:
    """One row per block of records of at least two tokens: id ``record#tok=start:end``, ids, labels, counts."""
    cut = records.select(id_col, ids_col, labels_col, F.explode(blocks(F.size(ids_col), size)).alias("b"))
    part = lambda c: F.slice(c, (F.col("b.start") + 1).cast("int"), (F.col("b.end") - F.col("b.start")).cast("int"))
    return cut.select(
        F.format_string("%s#tok=%d:%d", id_col, "b.start", "b.end").alias("record_id"), part(ids_col).alias("input_ids"), part(labels_col).alias("labels"), (F.col("b.end") - F.col("b.start")).alias("token_count"),
        F.size(F.filter(part(labels_col), lambda x: x != IGNORED)).alias("supervised_token_count"),
    )


def masked_labels(ids: Column, mask: Column) -> Column:
    """Labels that train on masked tokens only."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(F.lit(IGNORED)))


def supervised(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORED))


def padded_length(longest: Column, multiple: int = 8) -> Column:
    return (F.ceil(longest / multiple) * multiple).cast("int")


def pad_right(values: Column, length: Column, pad: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(pad), (length - F.size(values)).cast("int")))


def pad_left(values: Column, length: Column, pad: int) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), (length - F.size(values)).cast("int")), values)


def attention(values: Column, length: Column) -> Column:
    ones = F.array_repeat(F.lit(1), F.size(values))
    return pad_right(ones, length, 0)


def fixed_width(ids: Column, width: int = 24) -> Column:
    """Exactly ``width`` ids: cut, or filled with the padding id 0."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), width)), 1, width)


def unflatten(flat: Column, width: int = 24) -> Column:
    """A flat list of rows of ``width`` as a list of lists."""
    rows = F.floor(F.size(flat) / width).cast("int")
    return F.when(rows > 0, F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.slice(flat, i * width + 1, width))).otherwise(F.array().cast("array<array<int>>"))


def without_overflow(records: DataFrame, limit: int, ids_col: str = "input_ids") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): sequences beyond the limit are rejected, never cut; a null one is accepted."""
    long_ = F.coalesce(F.size(ids_col) > limit, F.lit(False))
    return records.where(~long_), records.where(long_)


def padding_problem(ids: Column, labels: Column, mask: Column, features: Column | None = None) -> Column:
    """Why a padded row is invalid, or null: lists of one length, and neutral values wherever the mask is 0.

    ``features``: lists of feature ids per token, whose padding is 0.
    """
    width = F.size(ids)
    uneven = (F.size(labels) != width) | (F.size(mask) != width)
    off = F.exists(F.arrays_zip(labels.alias("l"), mask.alias("m")), lambda t: (t["m"] == 0) & (t["l"] != IGNORED))
    problem = F.when(uneven, "lengths differ").when(F.exists(mask, lambda m: ~m.isin(0, 1)), "mask is not 0 or 1").when(off, "a padded label is trained")
    if features is None:
        return problem
    stray = F.exists(F.arrays_zip(features.alias("f"), mask.alias("m")), lambda t: (t["m"] == 0) & F.exists(t["f"], lambda i: i != 0))
    return F.coalesce(problem, F.when(F.size(features) != width, "lengths differ").when(stray, "a padded token has features"))


def padding_utilization(records: DataFrame, length: str, padded: str) -> DataFrame:
    return records.agg((F.sum(length) / (F.count("*") * F.max(padded))).alias("utilization"))


def pass_order(n: int, seed: int, pass_index: int) -> list[int]:
    """A seeded permutation of 0..n-1 for one pass, on the driver; for tables order by a hash instead."""
    order = list(range(n))
    random.Random((seed << 16) ^ pass_index).shuffle(order)
    return order


def token_conservation(blocks_: DataFrame, expected: int) -> None:
    """Raises unless the blocks hold exactly the expected number of tokens."""
    found = blocks_.agg(F.coalesce(F.sum("token_count"), F.lit(0))).first()[0]
    if found != expected:
        raise ValueError(f"blocks hold {found} tokens, not {expected}")
