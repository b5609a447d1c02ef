"""The conversation trie against a plain dictionary of prefixes, and its SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from lumenfold.llm import prefix_trie
from lumenfold.llm.prefix_trie import trie

from .conftest import duck, same

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def cut_mod(c, m):
    return c - int(c / m) * m


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        said = convs.get(c - cut_mod(c, 20), [])[:h] + own[h:]
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
        ends[tuple(said)].append(c)
    below = defaultdict(list)
    for p in members:
        if p:
            below[p[:-1]].append(p)

    def total(p):
        leaves, saved = (0 if below[p] else 1), (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        for q in below[p]:
            x, y = total(q)
            leaves, saved = leaves + x, saved + y
        return leaves, saved

    out = []
    for p, who in members.items():
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(below[p]), *total(p), hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(map(str, out))


def check(spark, rows, parts=5):
    got = trie(spark.createDataFrame(rows, SCHEMA).repartition(parts)).select(COLUMNS).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def talk(rng, n_convs, words=3, most=7):
    """Conversations whose turns often agree; some are far apart, negative or alike."""
    rows = []
    for c in range(n_convs):
        said = [rng.choice("ab") for _ in range(rng.randrange(1, most))]
        rows += [(c * 3 - 40, k, rng.choice(["user", "user", "assistant"]) if k > 2 else "user", " ".join([s] * rng.choice([1, 1, 1, words]))) for k, s in enumerate(said)]
    return rows


def test_random_tables(spark):
    for seed in (1,):
        check(spark, talk(random.Random(seed), 70))


def test_hot_keys_and_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "SEGMENT", 12)
    monkeypatch.setattr(prefix_trie, "hot_limit", lambda rows: 2)
    rows = talk(random.Random(9), 60)
    rows += [(5000, k, "user", "a" if k < 2 else f"long {k % 5}") for k in range(70)]
    rows += [(c, k, "user", "a") for c in range(6000, 6030) for k in range(2)]
    check(spark, rows, parts=9)


def test_chains_that_hang_on_chains(spark):
    """Conversation 100 + k says a, k times, then b: each chain hangs on the one before."""
    rows = [(1000 * k + 40 * (k % 3), t, "u", "a" if t < k else "b") for k in range(1, 24) for t in range(k + 1)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, "user", "second"), (1, 0, "assistant", "tie"), (1, 0, "assistant", "tie"), (2, 5, None, None), (2, 6, "", ""), (None, 0, "user", "nobody's"), (3, 0, "user", "a:b"), (3, 1, "x", ""),
        (4, 0, "user:a", "b"), (4, 1, "usera", ":b"), (21, 0, "user", "w " * 9_000), (22, 0, "user", "w " * 9_000), (20, 0, "日本", "テキスト \x00 é"), (23, 0, "日本", "テキスト \x00 é"), (-7, 0, "user", "first"), (-20, 3, "u", "x"), (-33, 3, "u", "x"), (9, None, None, None),
    ]
    check(spark, rows)
    assert trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)).collect() == []
    turnless = [(c, 0, "u", f"{c}") for c in range(1, 9)]  # some lose their only turn
    check(spark, turnless)
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("own").alias(n) for n in ("pos", "n", "depth", "part", "digest", "first", "words", "said")])
    assert sorted(str(tuple(r)) for r in trie(df).select(COLUMNS).collect()) == brute(rows)


def test_one_first_turn_of_a_third(spark):
    rng = random.Random(3)
    rows = [(c, k, "user", "hello there" if k == 0 and c % 3 else f"{rng.randrange(4)} and more") for c in range(300) for k in range(3)]
    check(spark, rows)


def test_sql(spark):
    rows = [r for r in talk(random.Random(5), 60)] + [(4, 0, None, None), (4, None, "user", "é x"), (500, 0, "user", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    same(trie(df).toPandas(), duck({"conversations": df.toPandas()}, prefix_trie.ORACLE_SQL))
