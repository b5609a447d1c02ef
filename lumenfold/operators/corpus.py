"""Corpus operators: records, splits, summaries, exact duplicates, leakage, lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.hashing import json_string, record_split, stable_int
from lumenfold.functions.text import chunk_rows


def records_of(pages: DataFrame, limit: int = 6000, validation_percent: int = 10) -> DataFrame:
    """(record_id, text, split, source_id, chunk_id) from (source_id, page, text).

    Texts are normalised and cut into chunks, numbered from 1 per page; blank
    pages give none.
    """
    numbered = chunk_rows(pages.select("source_id", "page", "text"), limit)
    record_id = F.format_string("CPT-%s-P%04d-C%03d", "source_id", "page", "chunk")
    chunk_id = F.format_string("%s:page=%d:chunk=%d", "source_id", "page", "chunk")
    return ensure_validation(numbered.select(record_id.alias("record_id"), "text", record_split(record_id, validation_percent).alias("split"), "source_id", chunk_id.alias("chunk_id")), validation_percent)


def ensure_validation(records: DataFrame, validation_percent: int = 10) -> DataFrame:
    """Moves one record to ``validation`` if several records have none there: the one of the smallest hash.

    A look that ends at the first validation record comes before that choice,
    for which all records would have to be made once more.
    """
    if validation_percent <= 0 or records.where(F.col("split") == "validation").select("split").head(1):
        return records
    order = stable_int("cpt-validation-fallback-v1", json_string(F.col("record_id")))
    chosen = records.agg(F.count("*").alias("n"), F.count_if(F.col("split") == "validation").alias("held"), F.min_by("record_id", F.struct(order, "record_id")).alias("pick")).where("n > 1 AND held = 0").select("pick")
    joined = records.join(F.broadcast(chosen), records["record_id"] == F.col("pick"), "left")  # at most one row
    return joined.withColumn("split", F.when(F.col("pick").isNotNull(), "validation").otherwise(F.col("split"))).drop("pick")


def in_record_order(records: DataFrame) -> DataFrame:
    return records.orderBy(F.coalesce("source_id", F.lit("")), F.coalesce("chunk_id", F.lit("")), "record_id")


def source_summary(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Records and characters per source and split."""
    split = record_split(F.col(id_col).cast("string"))
    return docs.groupBy(F.col(source_col).alias("source"), split.alias("split")).agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("characters"))


def page_summary(pages: DataFrame, records: DataFrame) -> DataFrame:
    """(source_id, pages, records, characters, errors) per source: blank pages count as pages; ``pages`` as `pdf_pages` gives them."""
    per = pages.groupBy("source_id").agg(F.max("pages").alias("pages"), F.count("error").alias("errors"))
    own = records.groupBy("source_id").agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("characters"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return per.join(own, "source_id", "left").select("source_id", "pages", zero("records"), zero("characters"), "errors")


def corpus_totals(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    split = record_split(F.col(id_col).cast("string"))
    return docs.agg(F.count("*").alias("records"), F.count_if(split == "train").alias("train_records"), F.count_if(split == "validation").alias("validation_records"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))


def only_value(col: Column) -> Column:
    """The value of a column if all its non-null values agree, else null."""
    return F.when(F.min(col) == F.max(col), F.min(col))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(content_hash, kept id, copies): the first id of each text; map-side combined, no sorting."""
    return docs.groupBy(F.sha2(text_col, 256).alias("content_hash")).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"))


def leakage(rows: DataFrame, key: Column, split: Column) -> DataFrame:
    """Keys that occur in several splits, with those splits in order."""
    return rows.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def length_statistics(rows: DataFrame, length: str, *by: str) -> DataFrame:
    """Count, total, mean, median and nearest-rank percentiles; zeros for an empty table."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {length})")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.groupBy(*by).agg(
        F.count(length).alias("n"), zero(F.sum(length)).alias("total"), zero(F.avg(length)).alias("mean"), zero(F.median(length)).alias("median"),
        *[zero(rank(p)).cast("long").alias(name) for p, name in ((0.9, "p90"), (0.95, "p95"), (0.99, "p99"))], zero(F.max(length)).cast("long").alias("maximum"),
    )
