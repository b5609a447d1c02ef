"""Stages decide by row: null ids, repeated rows, ids with two texts."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from lumenfold.llm import decontaminate, mixing, near_dedup

from .conftest import DOCS, prose


def test_contaminated_rows_go_by_their_text(spark):
    item = prose(70, 30)
    rows = [(None, "a " + item, "en", "s", 1), (None, prose(1, 40), "en", "s", 1), (1, item + " b", "en", "s", 1), (1, prose(2, 40), "en", "s", 1), (2, None, "en", "s", 1)]
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(spark.createDataFrame(rows, DOCS), items).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(str(r) for r in (rows[1], rows[3], rows[4]))


def test_one_row_of_each_group_of_copies(spark):
    a, b, c, d = (prose(i, 60) for i in range(4))
    near = " ".join(c.split()[:59] + ["x"])
    rows = [
        (1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a, "en", "s", 1), (None, a, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1), (None, near, "en", "s", 1),
        (7, d, "en", "s", 1), (7, d, "de", "t", 2), (8, None, "en", "s", 1), (8, None, "en", "s", 1), (None, "", "en", "s", 1), (None, "", "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    kept = near_dedup.drop_near_duplicates(docs.repartition(5).withColumn("gone_row", F.lit("own")), 80)
    assert kept.columns == [*docs.columns, "gone_row"]
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got.pop((None, c), 0) + got.pop((None, near), 0) == 1
    assert got == {(1, a): 1, (1, b): 1, (7, d): 1, (8, None): 2, (None, ""): 2}
    assert sorted(map(str, near_dedup.drop_near_duplicates(docs.repartition(1), 80).collect())) == sorted(map(str, near_dedup.drop_near_duplicates(docs.repartition(7), 80).collect()))


def test_a_table_loaded_twice(spark):
    rows = [(i, prose(i % 40, 60), "en", "s", 1) for i in range(60)]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows + rows, DOCS), 80).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(40))


def test_mix_takes_rows_as_often_as_decided(spark):
    rows = [(None if i % 2 else i % 40, prose(i, 5 + i % 9), "abc"[i % 3 if i % 7 else 0]) for i in range(300)] + [(None, "same text here", "b")] * 9 + [(77, "w " * 7, "c")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = ["doc_id", "source", "size"]
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[tuple(r[k] for k in key)] += r["times"]
    got = Counter(tuple(r) for r in mixing.take_mix(docs).select("doc_id", "source", mixing.n_words("text").alias("size")).collect())
    assert got == +want
