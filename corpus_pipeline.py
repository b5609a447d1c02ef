"""The corpus pipeline: classify, deduplicate, decontaminate, mix, write tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return
the columns of ``documents``. Decisions go by row, so null and repeated ids
matter nothing, and stages read no other columns than they need, so extra
columns pass through. ``run`` leaves its intermediate tables in the shared
folder; ``lumenfold.llm.common.clear_scratch`` deletes them once the result is
written.

``ORACLE_SQL`` is None: the classifier's scores have no SQL form. Tests hold
each stage against a brute-force version of it instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import decontaminate, mixing, near_dedup, quality, token_store
from lumenfold.llm.common import read_table, stash


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five words, 0.8)."""
    return near_dedup.drop_near_duplicates(docs, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"), percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until sources have their target weights."""
    return mixing.take_mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids as ORC and returns their index, read back."""
    return token_store.tokenize_and_index(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_copies),
    ("decontaminate", drop_benchmark),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage-{k}-{name}")
    return docs
