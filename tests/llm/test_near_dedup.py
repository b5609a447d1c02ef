from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import common
from lumenfold.llm import near_dedup as nd
from lumenfold.llm.components import connected_components

from .conftest import DOCS, prose


def check(df, rows, percent):
    got = {r["doc_id"]: r for r in nd.near_duplicates(df, percent).collect() if r["doc_id"] is not None}
    want = nd.brute_force([(r[0], r[1]) for r in rows if r[0] is not None], percent)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


@pytest.mark.parametrize("percent", [80, 85])
def test_odd_rows(odd, odd_rows, percent):
    check(odd, odd_rows, percent)
    none = [r for r in nd.near_duplicates(odd, percent).collect() if r["doc_id"] is None]
    assert len(none) == 2 and all(r["kept"] and r["component_id"] is None for r in none)


def test_a_large_group_at_the_threshold(spark, monkeypatch):
    """Hundreds of copies of one text, edited to similarities on both sides of the threshold, in several blocks."""
    monkeypatch.setattr(nd, "BLOCK_DOCS", 40)
    rng, base, rows = random.Random(5), prose(3, 150).split(), []
    for i in range(260):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(0, 7)):
            words[at] = f"edit{i}x{at}" if rng.random() < 0.7 else f"common{at}"
        rows.append((1000 - i, " ".join(words), "en", "s", 1))
    rows += [(5000 + i, prose(100 + i, 80), "en", "s", 1) for i in range(40)]
    check(spark.createDataFrame(rows, DOCS), rows, 85)


def test_few_strays_of_a_large_core(spark, monkeypatch):
    """Texts that link to some of a large group but not to its smallest member, which is the bucket's hub."""
    monkeypatch.setattr(nd, "BLOCK_DOCS", 25)
    rng, base, rows = random.Random(9), prose(3, 150).split(), []
    for i in range(200):
        words, edits = list(base), 0 if i == 0 else 1 if i < 190 else 4
        for at in rng.sample(range(10, 140), edits):
            words[at] = f"edit{i}x{at}"
        if i % 2:
            words = words + ["tail", "of", "half", "the", "group"]
        rows.append((i, " ".join(words), "en", "s", 1))
    check(spark.createDataFrame(rows, DOCS), rows, 85)
    check(spark.createDataFrame(rows, DOCS), rows, 80)


def test_core_blocks_never_meet(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_DOCS", 10)
    members = [(key, i, 5, 0 if i < 1000 else i) for key in (7, 8) for i in range(1020)] + [(9, i, 5, i % 3) for i in range(9)]
    pairs = nd._block_pairs(spark.createDataFrame(members, "key long, node long, n long, component long")).collect()
    assert {r["key"] for r in pairs} == {7, 9}  # one member list is compared once
    assert sum(r["key"] == 7 for r in pairs) == 1000 * 2 + 20 * (2 + 100)
    blocks = {}
    for r in pairs:
        blocks.setdefault((r["key"], r["i"], r["j"]), []).append(r["node"])
    met = {(a, b) for ids in blocks.values() for a in ids for b in ids}
    assert all((a, b) in met for a in range(1000, 1020) for b in range(1020))


def test_shared_passage_is_no_link(spark):
    rows = [(i, prose(7, 60) + " " + prose(50 + i, 60), "en", "s", 1) for i in range(60)]
    check(spark.createDataFrame(rows, DOCS), rows, 80)


def test_filter_keeps_columns(clashing, empty):
    kept = nd.drop_near_duplicates(clashing, 80)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 6, 8, 9, 10, 11, 12][: len([i for i in ids if i is not None])] or 5 not in ids
    assert nd.near_duplicates(empty).count() == 0 and nd.drop_near_duplicates(empty).count() == 0


def test_rows_of_one_id_go_by_their_own_text(spark):
    """Two texts under one id fuse nothing; copies of a row count once."""
    a, b = prose(1, 60), prose(2, 60)
    near_a, near_b = " ".join(a.split()[:59] + ["x"]), " ".join(b.split()[:59] + ["y"])
    rows = [(5, a), (5, b), (3, near_a), (9, near_b), (9, near_b), (9, near_b), (4, prose(3, 60)), (None, a), (6, None), (6, "")]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect() if r["doc_id"])
    assert got == [(3, 56, 3), (4, 56, 4), (5, 56, 3), (5, 56, 5), (6, 0, 6), (6, 0, 6), (9, 56, 5), (9, 56, 5), (9, 56, 5)]


def test_hot_keys_are_met_by_broadcast(spark, monkeypatch):
    """The same rows with every key hot as with none."""
    rng, base, rows = random.Random(6), prose(4, 120).split(), []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 5)):
            words[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(words), "en", "s", 1))
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(nd, "BLOCK_DOCS", 20)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    check(df, rows, 85)
    monkeypatch.setattr(common, "HOT_ROWS", 10**6)
    check(df, rows, 85)


def test_large_sets_share_no_band_by_chance(monkeypatch):
    """Unrelated sets that would crowd the small ring; related ones on both sides of the limit meet."""
    rng = np.random.default_rng(7)
    draw = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    keys = [set(nd.set_bands(draw(300_000)).tolist()) for _ in range(4)]
    assert all(keys[i].isdisjoint(keys[j]) for i in range(4) for j in range(i)) and all(len(k) == nd.BANDS for k in keys)
    common = draw(60_000)
    small, large = set(nd.set_bands(common).tolist()), set(nd.set_bands(np.unique(np.concatenate([common, draw(9_000)]))).tolist())
    assert small & large and len(small) == len(large) == 2 * nd.BANDS


@pytest.mark.parametrize(("percent", "least"), [(80, 0.999), (85, 0.9999)])
def test_recall_of_the_bands(percent, least):
    """Pairs at the very threshold: the share that meets in some band, for sets of many sizes."""
    rng = np.random.default_rng(percent)
    met = pairs = 0
    for _ in range(3000):
        n = int(rng.integers(20, 800))
        common = -(-n * percent // 100)
        sets = [rng.integers(0, 2**63, k).astype(np.uint64) for k in (common, (n - common) // 2, n - common - (n - common) // 2)]
        x, y = (set(nd.set_bands(np.concatenate([sets[0], own])).tolist()) for own in sets[1:])
        met += not x.isdisjoint(y)
        pairs += 1
    assert met >= least * pairs - 1


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    x, y = nd.signature(np.unique(np.concatenate([common, a]))), nd.signature(np.unique(np.concatenate([common, b])))
    assert abs((x == y).mean() - 0.8) < 0.12
    table = nd.ring_table()
    assert (table[5][1:] == table[6][:-1]).all()  # coordinates are one permutation, turned


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 900), (900, 501), (700, 700)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[900] == got[501] == 500 and got[700] == 700
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.range(1).select(F.lit(None).cast("long").alias("a"), F.col("id").alias("b"))).count() == 0


@pytest.mark.parametrize(("n", "pairs"), [(5_000, 40), (40_000, 12), (60_000, 8), (100_000, 6)])
def test_recall_of_large_sets(n, pairs):
    """Pairs of J = 0.80 and 0.85, up to sets that use both rings or the wide one alone."""
    rng = np.random.default_rng(n)
    for k in range(pairs):
        common = -(-n * (80 if k % 2 else 85) // 100)
        parts = [rng.integers(0, 2**63, m).astype(np.uint64) for m in (common, (n - common) // 2, (n - common) // 2)]
        x, y = (set(nd.set_bands(np.unique(np.concatenate([parts[0], own]))).tolist()) for own in parts[1:])
        assert not x.isdisjoint(y)


def test_copies_beyond_the_hot_limit_and_one_large_component(spark):
    """600 copies of one text, and 300 near copies that are one component of many classes."""
    rng, base = random.Random(8), prose(21, 100).split()
    rows = [(i, prose(20, 40), "en", "s", 1) for i in range(600)]
    for i in range(600, 900):
        words = list(base)
        words[rng.randrange(100)] = f"edit{i}"
        rows.append((i, " ".join(words), "en", "s", 1))
    got = {r["doc_id"]: r for r in nd.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5), 85).collect()}
    assert {r["component_id"] for i, r in got.items() if i < 600} == {0} and {r["component_id"] for i, r in got.items() if i >= 600} == {600}
    assert sum(r["kept"] for r in got.values()) == 2 and len(got) == 900


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    check(docs, rows, 85)
