"""Shards stay within the target bytes."""

from __future__ import annotations

import pytest

from lumenfold.llm import sharding

from .conftest import DOCS, prose


def test_shards_stay_within_target_bytes(spark):
    rows = [(i, prose(i, 5 + i % 40), "en", "s", 1) for i in range(300)] + [(None, "the same text again", "en", "s", 1)] * 150 + [(999, prose(999, 2000), "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    total = sum(len(r[1].encode()) + 1 for r in rows)
    for target in (-(-total // 4), -(-total // 32)):
        got = sharding.shard(docs, leaves=None, target_bytes=target).toPandas()
        held = got.groupby("shard")["size"].agg(["sum", "size"])
        assert len(got) == len(rows) and ((held["sum"] <= target) | (held["size"] == 1)).all()
        assert sorted(got.shard.unique()) == list(range(len(held)))


@pytest.mark.parametrize("leaves", [1, 8])
def test_leaves_are_as_asked(spark, leaves):
    docs = spark.createDataFrame([(i, prose(i, 20), "en", "s", 1) for i in range(200)], DOCS)
    assert sharding.shard(docs, leaves=leaves).select("shard").distinct().count() == leaves


def test_cuts_against_sorting(spark):
    """Every node's cut leaves half of its bytes on either side, as sorting the node's rows says; leaves are boxes."""
    import random

    rng = random.Random(3)
    rows = [(i, rng.randrange(1000), rng.randrange(6), i, rng.randrange(1 << 30), rng.randrange(1 << 30), rng.randrange(1, 300)) for i in range(3000)]
    names = ["id", "a", "b", "c", "t", "u", "w"]
    table = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    placed, levels = sharding.kd_tree(table, ["a", "b", "c"], ["t", "u"], "w", 8)
    node_of = {r["id"]: r["node"] for r in placed.collect()}
    here = {1: [dict(zip(names, r, strict=True)) for r in rows]}
    spread = {d: max(r[d] for r in here[1]) - min(r[d] for r in here[1]) for d in "abc"}
    for cuts in levels:
        assert cuts.keys() == here.keys()
        below = {}
        for n, cut in cuts.items():
            own = here[n]
            widths = [(max(r[d] for r in own) - min(r[d] for r in own)) / spread[d] for d in "abc"]
            assert widths[cut.dim] == max(widths)
            key = lambda r, cut=cut: ("abc"[cut.dim] and r["abc"[cut.dim]], r["t"], r["u"])
            at = tuple(cut.values) + (-(1 << 63),) * (3 - len(cut.values))
            for r in own:
                below.setdefault(2 * n + (key(r) >= at), []).append(r)
            total, left = sum(r["w"] for r in own), sum(r["w"] for r in below[2 * n])
            near = min(abs(sum(r["w"] for r in sorted(own, key=key)[:k]) - total / 2) for k in range(len(own)))
            assert abs(left - total / 2) <= max(near, sharding.TOLERANCE * total) + 1e-9
        here = below
    assert {r["id"]: n for n, own in here.items() for r in own} == node_of
