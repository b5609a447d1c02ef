"""The cuckoo index: exact groups, insertion, deletion, growth, and rows of every odd kind."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from lumenfold.llm import exact_dedup
from lumenfold.llm.exact_dedup import SLOTS, Filter, build_index, delete_rows, groups, insert_rows

from .conftest import DOCS, duck, same


def brute(rows):
    """(doc_id, keep_id, group_size, sha) of each row, and how often each group keeps a row."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    by: dict[str, list] = {}
    for r, t in zip(rows, norm, strict=True):
        by.setdefault(t, []).append(r[0])
    keep = {t: min(ids, key=lambda i: (i is None, i or 0)) for t, ids in by.items()}
    return sorted((str(r[0]), str(keep[t]), len(by[t]), hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, norm, strict=True)), len(by)


def check(found, rows):
    got = found.collect()
    want, kept = brute(rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == kept == len({r["text_sha256"] for r in got if r["kept"]})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_odd_rows_and_extra_columns(odd, clashing, odd_rows, empty):
    rows = [r[:2] for r in odd_rows]
    check(exact_dedup.exact_duplicates(odd), rows)
    check(exact_dedup.exact_duplicates(clashing.withColumn("digest", F.lit(1)).withColumn("row", F.lit(2))), rows)
    assert exact_dedup.exact_duplicates(empty).collect() == []
    assert exact_dedup.exact_duplicates(odd).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_equals_sql(spark):
    rng = random.Random(4)
    rows = [(i * 7 % 601, rng.choice(["a b", "a  b", "a\tb", " a b", "a b ", "", None, "\n", " ", "x\x0by", "x y", "x y", f"own {i}"]), "en", "s", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    same(exact_dedup.exact_duplicates(docs.repartition(5)).toPandas(), duck({"documents": docs.toPandas()}, exact_dedup.ORACLE_SQL))


def test_a_third_of_all_rows_alike(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same  text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    check(exact_dedup.exact_duplicates(docs.repartition(9)), [(i, "the same text" if i % 3 == 0 else f"text {i}") for i in range(3000)])


def test_short_fingerprints_never_join_texts(spark):
    rows = [(i, f"text {i // 2}") for i in range(2000)]
    check(groups(build_index(spark.createDataFrame(rows, "doc_id long, text string"), bits=3, shards=2)), rows)


def test_insertion_and_deletion_against_building_anew(spark):
    rng = random.Random(8)
    make = lambda a, n: [(i if i % 11 else None, f"{rng.choice('ab')} {rng.randrange(60)}") for i in range(a, a + n)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first, second, third = make(0, 150), make(150, 150), make(300, 50)
    index = insert_rows(build_index(frame(first), shards=3), frame(second))
    check(groups(index), first + second)
    gone = set(rng.sample(first + second, 120)) | {r for r in first + second if r[1] == first[0][1]}
    left = [r for r in first + second if r not in gone]
    shorter = delete_rows(index, frame([*gone, (5, "never there"), (10_000, "a 1")]))
    check(groups(shorter), left)
    assert shorter.entries.where(F.col("live") <= 0).isEmpty()
    assert shorter.entries.count() == len({t for _, t in left})
    check(groups(insert_rows(shorter, frame(third + list(gone)))), left + third + list(gone))
    assert groups(delete_rows(index, frame(first + second))).collect() == []


def test_filter_grows_and_keeps_every_digest():
    shard, digests = Filter(log2_buckets=1), [hashlib.sha256(b"%d" % i).digest() for i in range(3000)]
    for d in digests:
        assert shard.find(d, 1) is None
        shard.insert([d, 1, None, 1])
    assert shard.grown >= 8 and shard.size == 3000
    assert all(shard.find(d, 1) is not None and shard.find(d, 2) is None for d in digests)
    for d in digests[::2]:
        shard.delete(shard.find(d, 1))
    assert [shard.find(d, 1) is not None for d in digests] == [i % 2 == 1 for i in range(3000)]
    for d in digests[::2]:
        shard.insert([d, 1, None, 1])
    assert sum(map(bool, shard.prints)) == shard.size == 3000
    for at, e in enumerate(shard.stored):  # every digest lies in one of its two buckets
        if e:
            first, fp = shard._first(e[0]), shard._print_of(e[0])
            assert at // SLOTS in (first, shard._other(first, fp)) and shard.prints[at] == fp
