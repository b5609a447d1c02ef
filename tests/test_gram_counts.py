"""Counts of tokens and n-grams within tasks against the built-in expressions."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text
from lumenfold.operators import token_features
from lumenfold.plans import corpus_plans

TEXTS = ["a b c. a b c d e\nf; $ 5 4.5% 1/2/2025 w-2 1099-B x_y/z don't", "", None, "one two " * 40 + "! one", "é Ünïcode –dash 2024 3,000.50 -$7 +4 a--b", ";;;. . .", "z"]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("held", [5, 16, 1 << 20])
def test_gram_counts(spark, monkeypatch, held):
    """Runs handed over early, also within an n-gram, and forgotten numbers change no count."""
    monkeypatch.setattr(text, "ITEMS_HELD", held)
    monkeypatch.setattr(text, "SURFACES_HELD", 30)
    docs = spark.createDataFrame([(t,) for t in TEXTS * 3], "text string").repartition(2)
    want = docs.select(F.explode(text.word_grams(F.col("text"))).alias("g")).groupBy("g.order", "g.key").count()
    assert sorted(map(tuple, text.gram_counts(docs).collect())) == sorted(map(tuple, want.collect()))
    assert text.gram_counts(docs.where("false")).collect() == []


def test_no_gram_is_a_row_of_its_own(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "Generate" not in _plan(corpus_plans.word_ngram_counts(spark, str(tmp_path)))


def test_surface_counts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(text, "ITEMS_HELD", 8)
    docs = spark.createDataFrame(list(enumerate(TEXTS * 3)), "doc_id long, text string")
    want = Counter(m for t in TEXTS * 3 for m in re.findall(text.TOKEN, t or "", re.ASCII))
    assert {r["raw"]: r["n"] for r in text.surface_counts(docs).collect()} == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert _plan(corpus_plans.char_ngram_counts(spark, str(tmp_path))).count("Generate") == 1  # of distinct surfaces


def test_keys(spark):
    found = sorted({m for t in TEXTS for m in re.findall(text.TOKEN, t or "", re.ASCII)} | {"1099", "109", "W2", "1/2/25", "A1", "10,5", "1999", "2150", "1040-EZ", "12-A", "5%"})
    rows = spark.createDataFrame([(s,) for s in found], "s string").select("s", text.atom_key(text.canonical_surface(F.col("s"))).alias("k"))
    assert {r["s"]: r["k"] for r in rows.collect()} == {s: text.key_of(s) for s in found}


def test_aliases_and_shapes(spark):
    found = sorted({text.key_of(m) for t in TEXTS for m in re.findall(text.TOKEN, t or "", re.ASCII)} | {"w-2", "1099-b", "a_b-c/d", "x/y/x", "a-b-c-d-e", "1-2x", "12-34", "<date>", "abcdefg", "a" * 65, "don't-x"})
    key = F.col("k")
    rows = spark.createDataFrame([(k,) for k in found], "k string").select("k", F.when(key.startswith("<"), F.array().cast("array<string>")).otherwise(text.atom_aliases(key)).alias("a"), text.char_gram_eligible(key, key).alias("c"))
    assert {r["k"]: (list(r["a"]), r["c"]) for r in rows.collect()} == {k: (text.aliases_of(k), text.gives_char_grams(k)) for k in found}


@pytest.mark.parametrize("items", [4, 7])
def test_features_of_parts(spark, monkeypatch, items):
    """A long text in parts, texts together and forgotten keys: as if each text were looked at whole; no key is an array of the plan."""
    docs = spark.createDataFrame(list(enumerate(TEXTS * 3)), "doc_id long, text string").repartition(2).cache()
    own = lambda: sorted((r["doc_id"], r["token_index"], list(r["feature_ids"]), r["candidate_count"], r["dropped"]) for r in token_features.token_features(docs, most=6).collect())
    want, stats = own(), sorted(map(tuple, token_features.bucket_statistics(docs).collect()))
    monkeypatch.setattr(token_features, "REMEMBERED", 3)
    parts = token_features._parts
    monkeypatch.setattr(token_features, "_parts", lambda texts, numbers, size=items: parts(texts, numbers, size))
    assert own() == want and sorted(map(tuple, token_features.bucket_statistics(docs).collect())) == stats
    assert "lambdafunction" not in _plan(token_features.token_features(docs))
