from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .conftest import DOCS, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, prose(i % 70, 30 + i % 50) + (" " + prose(999, 25) if i % 50 == 7 else ""), "en", f"src{i % 3}", 1) for i in range(210)]
    rows += [(1000 + i, " ".join(["LOUD!!"] * 60 + [f"N{i}!!"]), "en", "src0", 1) for i in range(40)] + [(5000, None, None, None, None), (5001, "", "en", "src1", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int(r[0] < 1000), 0) for r in rows if r[0] < 2000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(999, 25))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit("own"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [*COLUMNS, "score"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({r["doc_id"] for r in docs.collect()})
    good, single, clean, mixed = seen
    assert not any(1000 <= i < 1040 for i in good) and set(range(210)) <= good
    assert single < good and single >= set(range(40))
    assert {i for i in single if i % 50 == 7 and i < 210}.isdisjoint(clean) and mixed <= clean


def _shingles(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_stages_against_brute_force(spark, folder):
    """What each stage keeps of its own input, by plain loops: scores added up, all pairs, all items, words per source, whole encodings."""
    import math
    import zlib
    from bisect import bisect_right
    from collections import Counter

    import public_tokenizers
    from tokenizers import Tokenizer

    from lumenfold.llm import near_dedup, quality

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]

    def after(name, given):
        return sorted((tuple(r) for r in stages[name](spark, spark.createDataFrame(given, DOCS), folder).collect()), key=str)

    def score(model, text):
        x = [float(v) for v in quality.text_features(None if text is None else text.encode())]
        z = model.base + sum(t.tolist()[bisect_right(e.tolist(), v)] for t, e, v in zip(model.tables, model.edges, x, strict=True))
        z += sum(t[bisect_right(model.coarse[i].tolist(), x[i])][bisect_right(model.coarse[j].tolist(), x[j])] for i, j, t in model.pairs)
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train(docs, labels, quality.fold_is("doc_id", 5, 0) == False)  # noqa: E712
    good = after("quality", rows)
    assert good == sorted((r for r in rows if score(model, r[1]) >= quality.THRESHOLD), key=str)

    component = near_dedup.brute_force([(r[0], r[1]) for r in good], 80)
    single = after("near_dedup", good)
    assert single == sorted((r for r in good if component[r[0]][1] == r[0]), key=str)

    items = [_shingles(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = after("decontaminate", single)
    assert clean == sorted((r for r in single if not any(i and 100 * len(i & _shingles(r[1])) >= 80 * len(i) for i in items)), key=str) and len(clean) < len(single)

    mixed = after("mix", clean)
    size = lambda r: len((r[1] or "").split())
    own, taken = Counter(), Counter()
    for r in clean:
        own[r[3]] += size(r)
    for r in mixed:
        taken[r[3]] += size(r)
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(own.values()))
    while free:  # the excess of sources at three times their size is shared again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * own[s]}
        target |= {s: 3.0 * own[s] for s in full} if full else share
        left -= sum(3.0 * own[s] for s in full)
        free = free - full if full else set()
    assert set(mixed) <= set(clean) and max(Counter(mixed).values()) <= 3
    assert all(abs(taken[s] - target[s]) <= max((size(r) for r in clean if r[3] == s), default=0) for s in order)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for r in sorted(mixed, key=lambda r: (r[0] is None, r[0])):
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    got = stages["tokens"](spark, spark.createDataFrame(mixed, DOCS), folder).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == want


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert len(got) and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(got.columns)
    ordered = got.sort_values("start")
    assert (ordered.start.iloc[1:].to_numpy() == (ordered.start + ordered.n_tokens).iloc[:-1].to_numpy()).all()
    assert ordered.doc_id.is_monotonic_increasing or ordered.doc_id.isna().any()


def test_empty_tables(spark, folder):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
