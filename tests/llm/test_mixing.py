from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import mixing

from .conftest import duck, same


def table(docs):
    return docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})


@pytest.mark.parametrize("kind", ["odd", "clashing", "empty"])
def test_equals_sql(request, kind):
    docs = request.getfixturevalue(kind)
    same(mixing.mix(docs).toPandas(), duck({"documents": table(docs)}, mixing.ORACLE_SQL))


def test_targets_and_caps(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "abc"[0 if i < 300 else 1 + i % 2]) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, g in got.groupby("source"):
        target, size = g.target.iloc[0], g.source_size.iloc[0]
        assert target <= 3 * size + 1e-9
        assert abs(g.taken.sum() - target) <= 5
    assert (got.taken <= 3 * got["size"]).all()
    assert abs(got.groupby("source").target.first().sum() - got["size"].sum()) < 1e-6


def test_water_fill_matches_resharing(spark):
    sources = [("a", 10, 5), ("b", 100, 1), ("c", 1, 9), ("d", 40, 2), ("e", 0, 3)]
    got = {r["source"]: r["target"] for r in mixing.water_fill(spark.createDataFrame(sources, "source string, size long, weight long")).collect()}
    size, weight, total = {s: n for s, n, _ in sources}, {s: w for s, _, w in sources}, 151
    clamped: set[str] = set()
    while True:
        free = total - sum(3 * size[s] for s in clamped)
        left = [s for s in size if s not in clamped]
        want = {s: free * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if want[s] > 3 * size[s]}
        if not over:
            break
        clamped |= over
    for s in size:
        assert got[s] == pytest.approx(3 * size[s] if s in clamped else want[s])


def test_given_weights_and_repeats(spark, odd):
    weights = spark.createDataFrame([("a", 1)], "source string, weight long")
    got = mixing.mix(odd, weights).toPandas()
    assert (got[got.source != "a"].taken == 0).all()
    times = mixing.mix(odd).groupBy("doc_id").max("times").collect()
    want = {r[0]: r[1] for r in times}
    taken = mixing.take_mix(odd).groupBy("doc_id").count().collect()
    held = {r[0]: r[1] for r in odd.groupBy("doc_id").count().collect()}
    assert {r[0]: r[1] for r in taken} == {k: v * held[k] for k, v in want.items() if v}
    assert mixing.take_mix(odd).columns == odd.columns


def test_rows_of_one_id_are_documents_of_their_own(spark):
    """Long and short texts under one id, null ids, and a row that is there many times: the mix stays near its targets."""
    rows = [(100, "w " * 3, "a"), (100, "x " * 4000, "a")] + [(i % 7 if i % 3 else None, f"v{i} " * (1 + i % 50), "abc"[i % 3]) for i in range(300)] + [(5, "same words here", "b")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    same(got, duck({"documents": table(docs)}, mixing.ORACLE_SQL))
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2
    taken = mixing.take_mix(docs.withColumn("mix_of", F.lit("own"))).withColumn("size", mixing.n_words("text"))
    assert taken.columns == ["doc_id", "text", "source", "mix_of", "size"]
    words = {r["source"]: r["n"] for r in taken.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    assert words == got.groupby("source").taken.sum().to_dict()


def test_reruns_and_partitions_agree(odd):
    key = ["doc_id", "size", "times"]
    a = mixing.mix(odd.repartition(1)).toPandas().sort_values(key).reset_index(drop=True)
    b = mixing.mix(odd.repartition(7)).toPandas().sort_values(key).reset_index(drop=True)
    assert a.equals(b)
