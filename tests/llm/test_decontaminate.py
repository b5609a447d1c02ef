from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import decontaminate as dc

from .conftest import DOCS, duck, prose, same


@pytest.fixture(scope="module")
def planted(spark):
    item, other = prose(70, 30), prose(71, 20)
    words = item.split()
    rows = [
        (0, prose(1, 5000) + " " + item.upper() + "\n" + prose(2, 3000), "en", "s", 1), (1, " ".join(words[:24]) + " " + prose(3, 50), "en", "s", 1), (2, " ".join(words[:29]), "en", "s", 1), (3, prose(4, 100), "en", "s", 1),
        (4, None, None, None, None), (5, "", "en", "s", 0), (6, "Two words", "en", "s", 9), (7, "two words more", "en", "s", 1), (8, item + " " + other + " " + item, "en", "s", 1), (9, " ".join(words[:26] + ["z"] + words[27:]), "en", "s", 1),
    ]
    items = [(50, item), (51, other), (52, "two WORDS"), (53, None), (54, ""), (55, item)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")


def test_equals_sql(planted):
    docs, items = planted
    got = dc.contaminated(docs, items).toPandas()
    same(got, duck({"documents": docs.toPandas(), "benchmark": items.toPandas()}, dc.ORACLE_SQL))
    assert set(got.doc_id) == {0, 2, 6, 8} | set(got[got.doc_id == 9].doc_id)


def test_blocks_change_nothing(planted, monkeypatch):
    docs, items = planted
    want = dc.contaminated(docs, items).toPandas()
    monkeypatch.setattr(dc, "BLOCK_SHINGLES", 25)
    same(dc.contaminated(docs, items).toPandas(), want)


def test_sketch_finds_every_item_at_the_bound():
    """Whatever shingles a document lacks, if it has the wanted share, the sketch meets it."""
    for n in range(1, 60):
        p = dc.sketch_length(n, 80)
        missing = next(k for k in range(n + 1) if (n - k) * 100 < n * 80)
        assert p == missing


def test_partitions_change_nothing():
    """Items of all size classes in documents around the fewest words that can match, against every pair compared."""
    items = [(k, prose(200 + k, size).encode()) for k, size in enumerate((5, 6, 9, 12, 17, 36, 70, 140))]
    index = dc.ItemIndex(items, 80)
    assert [p.need for p in index.partitions] == sorted(p.need for p in index.partitions) and len(index.partitions) > 4

    def shingles(text):
        words = dc.words_of(text)
        return {b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    for _, text in items:
        words = text.split()
        for cut in {1, len(words) // 2, *range(max(1, int(len(words) * 0.75)), len(words) + 1)}:
            doc = b" ".join(words[:cut])
            want = {(i, len(shingles(t)), len(shingles(t) & shingles(doc))) for i, t in items if len(shingles(t) & shingles(doc)) * 100 >= 80 * len(shingles(t))}
            assert set(index.matches(doc)) == want
            assert set(index.matches(b"x " * 400 + doc + b" y" * 400)) >= {m for m in want if m[1] > 1}


def test_filter_and_odd_tables(planted, clashing, empty):
    docs, items = planted
    kept = dc.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {3, 4, 5, 7} <= {r["doc_id"] for r in kept.collect()} and not {0, 2, 6, 8} & {r["doc_id"] for r in kept.collect()}
    assert dc.contaminated(empty, items).count() == 0
    assert dc.contaminated(docs, items.where(F.lit(False))).count() == 0
    assert dc.drop_contaminated(clashing, items).columns == clashing.columns
    assert dc.drop_contaminated(clashing, items).count() == clashing.count()
