"""Queries that write records with a sink and read them back with its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import canonical, hashing, permutation
from lumenfold.operators import alignment, corpus, sequences
from lumenfold.plans.base import query, table
from lumenfold.plans.corpus_plans import _SPLIT, ordered_places
from lumenfold.plans.example_plans import _CACHE, cached_tokens
from lumenfold.sources import arrow_cache, readers, writers
from lumenfold.sources.storage import scratch_path


@query("""SELECT source, CASE WHEN min(lang) = max(lang) THEN min(lang) END AS lang, CASE WHEN min(length(source)) = max(length(source)) THEN min(length(source)) END::BIGINT AS width
  FROM documents GROUP BY source""")
def single_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column's value where all rows of a source agree, else null."""
    rows = table(spark, sf_dir, "documents").withColumn("width", F.length("source").cast("long"))
    return rows.groupBy("source").agg(corpus.only_value(F.col("lang")).alias("lang"), corpus.only_value(F.col("width")).alias("width"))


@query("SELECT sum(doc_id % 300 + 2)::BIGINT AS tokens, sum(ceil((doc_id % 300 + 2) / 64.0))::BIGINT AS blocks FROM documents")
def block_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks hold each token of their records once."""
    ids = F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 300 + 2)
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("record_id"), ids.alias("input_ids"), ids.alias("labels"))
    return sequences.token_blocks(records, 64).agg(F.sum("token_count").cast("long").alias("tokens"), F.count("*").alias("blocks"))


@query("SELECT doc_id::VARCHAR AS record_id, sha256(text) AS text_hash, CASE WHEN doc_id % 3 = 0 THEN 'validation' ELSE 'train' END AS split, source AS source_id FROM documents")
def json_line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines and back: the id stands in ``id``, every third split in the metadata only."""
    third = F.col("doc_id") % 3 == 0
    meta = F.when(third, F.create_map(F.lit("split"), F.lit("validation")))
    rows = table(spark, sf_dir, "documents").select(
        F.lit("").alias("record_id"), F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("source_id"), meta.alias("metadata")
    )
    path = scratch_path(spark, "records")
    writers.write_json_lines(rows, path)
    back = readers.corpus_records(readers.json_lines(spark, path, readers.CORPUS))
    return back.select("record_id", F.sha2("text", 256).alias("text_hash"), "split", "source_id")


@query(f"WITH {_CACHE} SELECT record_id, n AS token_count FROM t WHERE split = 'validation'")
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One split of a written cache; only its own folder is read."""
    path = scratch_path(spark, "cache")
    writers.write_cache(cached_tokens(spark, sf_dir), path)
    return readers.read_cache(spark, path, "validation").select("record_id", F.col("token_count").cast("long").alias("token_count"))


@query(f"WITH {_CACHE} SELECT split, count(*) AS records, sum(n)::BIGINT AS tokens, min(record_id) AS first_id, max(record_id) AS last_id, true AS hashed FROM t GROUP BY split")
def shard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a cache's files, summed by split."""
    path = scratch_path(spark, "shards")
    writers.write_cache(cached_tokens(spark, sf_dir), path, per_file=500)
    files = writers.shard_manifest(spark, path)
    return files.groupBy("split").agg(
        F.sum("records").alias("records"), F.sum("tokens").cast("long").alias("tokens"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"),
        F.every((F.length("sha256") == 64) & (F.col("bytes") > 0)).alias("hashed"),
    )


@query("""WITH t AS (SELECT conv_id, turn + CASE WHEN conv_id % 7 = 0 AND turn >= 2 THEN 1 ELSE 0 END AS token_index, turn % 5 = 4 AS control, conv_id % 2 = 0 AS held FROM conversations),
  p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY token_index) - 1 AS place FROM t)
  SELECT conv_id, token_index, place FROM p WHERE token_index <> place OR (control AND held)""")
def index_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as tokens: a gap in every seventh conversation, control tokens with a segment in every other."""
    gap = ((F.col("conv_id") % 7 == 0) & (F.col("turn") >= 2)).cast("int")
    tokens = table(spark, sf_dir, "conversations").select(
        "conv_id", (F.col("turn") + gap).alias("token_index"), (F.col("turn") % 5 == 4).alias("is_control"), F.when(F.col("conv_id") % 2 == 0, F.lit(1)).alias("segment_id")
    )
    return alignment.index_gaps(tokens, "conv_id").select("conv_id", "token_index", "place")


@query("""WITH r AS (SELECT doc_id::VARCHAR AS record_id, sha256('["cpt-validation-fallback-v1","' || doc_id || '"]') AS h FROM documents),
  f AS (SELECT record_id FROM r ORDER BY substr(h, 1, 16), record_id LIMIT 1)
  SELECT record_id, CASE WHEN record_id IN (SELECT record_id FROM f) THEN 'validation' ELSE 'train' END AS split FROM r""")
def validation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no record fell into validation, the one of the smallest hash is moved there."""
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.lit("train").alias("split"))
    return corpus.ensure_validation(records).select("record_id", "split")


@query(f"""WITH r AS (SELECT 'D' || printf('%012d', doc_id) AS record_id, {_SPLIT} AS split, (len(regexp_extract_all(text, '\\S+')))::INT AS token_count FROM documents),
n AS (SELECT *, row_number() OVER (ORDER BY split, record_id) - 1 AS row_index, count(*) OVER () AS total FROM r), w AS (SELECT (row_index * 7 + 3) % total AS row_index FROM n)
SELECT row_index, record_id, split, token_count, count(*) AS times FROM w JOIN n USING (row_index) GROUP BY ALL""")
def arrow_cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as Arrow shards, and as many rows fetched by their global number, in another order."""
    docs = table(spark, sf_dir, "documents")
    record, split = F.format_string("D%012d", "doc_id"), hashing.record_split(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    rows = docs.select(record.alias("record_id"), split.alias("split"), F.transform(words, lambda w: F.length(w)).alias("input_ids")).withColumn("token_count", F.size("input_ids"))
    path = scratch_path(spark, "arrow-cache")
    arrow_cache.write_shards(rows, path, batch_rows=256, shard_rows=4096)
    total = arrow_cache.length(spark, path)
    wanted = spark.range(total).select(((F.col("id") * 7 + 3) % total).alias("row_index"))
    found = arrow_cache.rows_at(spark, path, wanted, ["record_id", "split", "token_count"])
    return found.groupBy("row_index", "record_id", "split", "token_count").agg(F.count("*").alias("times"))


@query("""SELECT event_id, sha256('{"at":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 > 0 THEN '.' || printf('%06d', (microsecond(ts) % 1000000)::INT) ELSE '' END || '","event":{"amounts":{"a":' || value || ',"b":' || -value / 4096 || '},"kinds":["' || event_type || '","' || user_id || '"]},"id":' || event_id || ',"none":null}') AS content_hash FROM events""")
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nested records, hashed by their canonical JSON: keys in order at every depth."""
    amounts = F.create_map(F.lit("b"), -F.col("value") / 4096, F.lit("a"), F.col("value"))
    event = F.struct(F.array("event_type", F.col("user_id").cast("string")).alias("kinds"), amounts.alias("amounts"))
    rows = table(spark, sf_dir, "events").select(F.lit(None).cast("string").alias("none"), F.col("event_id").alias("id"), event.alias("event"), "ts").withColumnRenamed("ts", "at")
    return rows.select(F.col("id").alias("event_id"), F.sha2(canonical.canonical_row(rows.schema), 256).alias("content_hash"))


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_number, doc_id, count(*) OVER () AS total FROM documents)
SELECT doc_id, row_number, true AS back, count(*) OVER () AS places FROM n""")
def seeded_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a seeded order, by arithmetic; the way back finds the document again, and places are all different."""
    rows = numbered(table(spark, sf_dir, "documents").select("doc_id"))
    total = rows.count()
    placed = rows.withColumn("place", permutation.place_of(F.col("row_number"), total, 42))
    back = permutation.row_at(F.col("place"), total, 42) == F.col("row_number")
    places = placed.agg(F.count_distinct("place").alias("places"))
    return placed.select("doc_id", "row_number", back.alias("back")).crossJoin(F.broadcast(places))  # one row


def numbered(rows: DataFrame) -> DataFrame:
    """(doc_id, row_number): places by doc_id from 0, ranks inside range partitions."""
    return ordered_places(rows, "doc_id").select("doc_id", (F.col("place") - 1).alias("row_number"))
