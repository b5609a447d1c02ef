"""Whitening: exact integers against fractions, components against the exact covariance, odd vectors."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import whitening
from lumenfold.llm.whitening import Centre, one_sided_jacobi, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"
FOLDER = "/root/testdata/sf0.001"


def grid(v):
    return [math.floor(64 * float(c)) + 1_000_000 for c in v]


def covariance(vectors):
    n, dims = len(vectors), len(vectors[0])
    mean = [Fraction(sum(v[d] for v in vectors), n) for d in range(dims)]
    return np.array([[float(sum((v[a] - mean[a]) * (v[b] - mean[b]) for v in vectors) / n) for b in range(dims)] for a in range(dims)])


def check(found, rows, most=16):
    """``rows``: (vec_id, floats) of the rows that remain; every column against plain arithmetic."""
    got = found.collect()
    listed = sorted({tuple(grid(v)) for _, v in rows})
    n, sums = len(listed), [sum(c) for c in zip(*listed, strict=True)]
    e = np.sort(np.linalg.eigvalsh(covariance(listed)))[::-1]
    kept = min(most, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == kept * len(rows)
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    want = sorted((str(i), sum((n * a - b) ** 2 for a, b in zip(grid(v), sums, strict=True))) for i, v in rows)
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == want
    for r in got:
        assert math.isclose(r["explained"], e[r["component"] - 1] / e.sum(), rel_tol=1e-9)
    return got, listed, e


def test_against_exact_covariance(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=7) * [9, 4, 2, 1, 0.5, 0.3, 0.2]).astype(np.float32).tolist(), 0) for i in range(400)]
    rows += [(400 + i, rows[i % 5][1], 1) for i in range(200)]
    rows += [(400, rows[0][1], 2), (None, rows[1][1], 0)]
    got, listed, e = check(whiten(spark.createDataFrame(rows, SCHEMA).repartition(7)), [(r[0], r[1]) for r in rows])
    # the projections of the distinct vectors onto each component have variance 1, are uncorrelated, and give the eigenvector back
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], r["whitened"])
    first = {tuple(grid(v)): i for i, v, _ in reversed(rows) if i is not None}
    w = np.array([[by[first[x]][c] for c in range(1, 8)] for x in listed])
    x = np.array(listed, float) - np.mean(np.array(listed, float), axis=0)
    assert np.abs(w.T @ w / len(w) - np.eye(7)).max() < 1e-9
    vectors = (x.T @ w / len(w)) / np.sqrt(e[:7])  # covariance of x with a whitened column is its eigenvector times sqrt(e)
    assert np.abs(vectors.T @ vectors - np.eye(7)).max() < 1e-9
    assert np.abs(covariance(listed) @ vectors - vectors * e[:7]).max() < 1e-7 * e[0]


def test_odd_vectors_are_dropped_and_columns_clash(spark):
    rng = random.Random(5)
    good = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [0.0, float("inf"), 0.0]), (104, [0.0, 0.0, -float("inf")]), (105, [1.0, 2.0]), (106, [])]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").select("*", *[F.lit("own").alias(c) for c in ("x", "n", "component", "part", "at", "whitened")])
    check(whiten(df.repartition(3)), good)


def test_tables_without_any_spread(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(i, [0.5, 0.25], 0) for i in range(9)], SCHEMA)
    assert whiten(one).collect() == []
    assert whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA)).collect() == []
    flat = [(i, [i / 7.0, i / 3.5, 1.0], 0) for i in range(90)]  # the grid bends the line a little
    got = whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-9


def test_a_third_of_all_vectors_alike_and_many_groups_merge(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    rng = np.random.default_rng(11)
    rows = [(i, (rng.normal(size=20) if i % 3 else np.ones(20)).astype(np.float32).tolist(), 0) for i in range(600)]
    check(whiten(spark.createDataFrame(rows, SCHEMA).repartition(14)), [(r[0], r[1]) for r in rows])


def test_large_entries_stay_exact_or_null(spark):
    rows = [(i, [1000.0 * i, 3.0e5 * (i % 3), 50.0 * (i * i % 7)], 0) for i in range(30)]
    check(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), [(r[0], r[1]) for r in rows])
    beyond = [(i, [1e300 * (-1) ** i, float(i)], 0) for i in range(12)]
    got = whiten(spark.createDataFrame(beyond, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 24 and {r["deviation"] for r in got} == {None} and all(math.isfinite(r["whitened"]) for r in got)


@pytest.mark.parametrize("dims", [1, 2, 3, 8, 33])
def test_jacobi_against_numpy(dims):
    rng = np.random.default_rng(dims)
    a = np.linalg.qr(rng.normal(size=(dims + 5, dims)) * np.logspace(0, -5, dims), mode="r")
    s, v = one_sided_jacobi(a)
    assert np.allclose(s, np.linalg.svd(a, compute_uv=False), rtol=1e-10)
    assert np.abs(v.T @ v - np.eye(dims)).max() < 1e-13
    assert np.abs((a @ v).T @ (a @ v) - np.diag(s**2)).max() < 1e-13 * max(1, s[0] ** 2)


def test_jacobi_keeps_small_deviations():
    """Columns of very different size: relative accuracy that a covariance would lose."""
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    small = np.diag([1.0, 1e-3, 1e-6, 1e-9, 1e-12, 1e-14])
    s, _ = one_sided_jacobi(q @ small)
    assert np.allclose(s, np.diag(small), rtol=1e-12)


def test_scaled_is_exact_in_both_ways():
    rng = random.Random(1)
    x = [[rng.randrange(-(10**12), 10**12) for _ in range(3)] for _ in range(50)]
    for n in (1, 7, 50, 10**9, 10**18):
        sums = [rng.randrange(-n * 10**12, n * 10**12) for _ in range(3)]
        got = Centre(n, sums).scaled(np.array(x, np.int64)).tolist()
        assert got == [[n * v - s for v, s in zip(row, sums, strict=True)] for row in x]


def test_whole_table(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    check(whiten(df), [(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()])
