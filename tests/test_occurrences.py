"""Occurrences, alignment, shard manifests, audits, revalidation and staged releases on small rows."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenfold.functions import hashing, text, tokenizer
from lumenfold.operators import integrity, occurrences, scenarios
from lumenfold.sources import writers
from lumenfold.sources.storage import canonical_json

TEXTS = [(1, "Form W-2 shows $1,200.50. See well-known rules/limits"), (1, "another text of the same id"), (None, "no id at all here"), (2, None), (3, ""), (4, "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def test_occurrences_by_brute_force(docs):
    """Word n-grams of each text from its spans, one by one."""
    found = occurrences.occurrences(docs).collect()
    assert len({r["row"] for r in found}) == 4
    keys = {r["key"]: r["n"] for r in docs.select(F.explode(text.word_grams(F.col("text"))).alias("g")).groupBy("g.key").agg(F.count("*").alias("n")).collect()}
    words = [r for r in found if r["kind"] == "word" and not r["alias"]]
    assert {k: sum(r["key"] == k for r in words) for k in keys} == keys and len(words) == sum(keys.values())
    said = TEXTS[0][1]
    for r in found:
        if r["row"] == min(x["row"] for x in found if x["doc_id"] == 1 and x["key"] == "form") and not r["alias"] and "<" not in r["key"]:
            assert r["key"].split() == said[r["start_char"] : r["end_char"]].lower().split() or r["order"] > 1
    chars = [r for r in found if r["kind"] == "char"]
    assert chars and all(r["key"] == said[r["start_char"] : r["end_char"]].lower() for r in chars if r["row"] == chars[0]["row"])


def test_aliases_have_their_words_offsets(docs):
    rows = occurrences.lexical(docs).where("alias").collect()
    said = TEXTS[0][1].lower()
    assert {r["key"] for r in rows} >= {"w2", "well", "known", "rules", "limits"}
    assert all(r["key"] in said[r["start_char"] : r["end_char"]].replace("-", "") or r["key"] in said[r["start_char"] : r["end_char"]] for r in rows)


def test_places_and_statistics(docs):
    rows = occurrences.ordered(occurrences.occurrences(docs)).collect()
    for row in {r["row"] for r in rows}:
        own = sorted((r for r in rows if r["row"] == row), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own)))
        keys = [tuple(r[c] for c in occurrences.ORDER) for r in own]
        assert keys == sorted(keys)
    stats = occurrences.extraction_statistics(occurrences.occurrences(docs)).collect()
    assert len(stats) == 4 and sum(r["word_occurrences"] + r["char_occurrences"] for r in stats) == len(rows)


def test_hashes_and_key_retention(docs):
    found = occurrences.occurrences(docs)
    kept = occurrences.hashed(found, keep_key=True).collect()
    assert len(kept) == found.count()
    for r in kept:
        assert r["namespace"] == f"{r['kind']}_{r['order']}"
        assert (r["feature_id"], r["bucket"]) == hashing.feature_id(r["namespace"], r["key"], b"ngram-v1")
    assert "key" not in occurrences.hashed(found).columns


def test_alignment_of_messages(spark):
    rows = spark.createDataFrame([(1, [("user", "Hi  there"), ("assistant", " yes!")]), (2, [])], "id long, messages array<struct<role:string,content:string>>")
    got = {r["id"]: r["alignment"].asDict() for r in tokenizer.align_messages(rows).collect()}
    # "Hi", blanks, "there"; of " yes!" the blank joins the line end before it.
    assert got[1]["content_tokens"] == 5 and got[1]["crossing_tokens"] == 1
    assert got[1]["total_tokens"] == got[1]["content_tokens"] + got[1]["control_tokens"] and got[1]["special_tokens"] == 0
    assert got[2] == dict.fromkeys(got[2], 0)
    bar = tokenizer.word_tokenizer()("|")[0][0]
    assert tokenizer.align_messages(rows, special=(bar,)).where("id = 1").first()["alignment"]["special_tokens"] == 8
    other = lambda: tokenizer.word_tokenizer(97)
    with pytest.raises(PySparkException, match="stream"):
        tokenizer.align_messages(rows, direct=other).collect()


def test_shard_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i:02d}", "train" if i % 3 else "validation", i) for i in range(20)], "record_id string, split string, token_count int")
    writers.write_cache(rows, str(tmp_path / "cache"), per_file=4)
    shards = writers.shard_manifest(spark, str(tmp_path / "cache")).collect()
    assert sum(r["records"] for r in shards) == 20 and sum(r["tokens"] for r in shards) == 190 and max(r["records"] for r in shards) <= 4
    for r in shards:
        raw = open(tmp_path / "cache" / r["path"], "rb").read()
        assert r["bytes"] == len(raw) and r["sha256"] == hashlib.sha256(raw).hexdigest() and r["first_id"] <= r["last_id"] and r["path"].startswith(f"split={r['split']}/")


def test_release_is_staged(spark, tmp_path):
    rows, place = spark.range(5), str(tmp_path / "release")
    os.makedirs(tmp_path / ".staging" / "release" / "data")  # left by a crash
    integrity.freeze(rows, place, "R1")
    assert integrity.verify_release(spark, place) == [] and not os.listdir(tmp_path / ".staging")
    with pytest.raises(integrity.ReleaseError, match="already"):
        integrity.freeze(rows, place, "R1")
    broken = rows.select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(PySparkException):
        integrity.freeze(broken, str(tmp_path / "second"), "R2")
    assert not os.path.exists(tmp_path / "second")


def test_stale_hashes(spark):
    names = "id string, content string, semantic string, structural string"
    stored = spark.createDataFrame([("a", "1", "2", "3"), ("b", "1", "2", "3"), ("c", "1", None, "3")], names)
    again = spark.createDataFrame([("a", "1", "2", "3"), ("b", "9", "2", "8"), ("d", "1", "2", "3")], names)
    got = {tuple(r) for r in integrity.stale(stored, again, "id").collect()}
    assert got == {("b", "content", "different"), ("b", "structural", "different"), ("c", "row", "missing recomputed"), ("d", "row", "missing stored")}


def test_content_fingerprint_and_audit(spark):
    world, analysis = {"b": 1, "a": "x"}, {"status": "ok"}
    row = spark.createDataFrame([(canonical_json(world), canonical_json(analysis))], "w string, a string")
    assert row.select(scenarios.content_fingerprint(F.col("w"), F.col("a"))).first()[0] == hashlib.sha256(canonical_json([world, analysis]).encode()).hexdigest()
    registry = spark.createDataFrame([("s1", "f1", "AB"), ("s2", "f2", "ab"), ("s3", "f3", None), ("s4", "f4", "ab"), ("s5", "f1", "REPLACE_ME")], "source_id string, raw_path string, sha256 string")
    actual = spark.createDataFrame([("f1", "ab"), ("f2", "cd"), ("f3", "ef")], "path string, sha256 string")
    assert {tuple(r) for r in integrity.audit_sources(registry, actual).collect()} == {("s2", "SRC-HASH-MISMATCH", "FATAL"), ("s4", "SRC-MISSING-RAW", "ERROR")}


def test_spans_leave_in_bounded_parts(docs, monkeypatch):
    """Tokens of many texts are not gathered, and a text's tokens may leave in several parts."""
    import pyarrow as pa

    said = ["one two three. four five", None, "", "a b", "one two three. four five" * 3]
    want = [[(i, *s) for s in text.spans_of(t or "")] for i, t in enumerate(said)]
    monkeypatch.setattr(text, "TOKENS_HELD", 4)
    parts = list(text._token_runs(pa.array(said)))
    assert max(len(at) for at, _ in parts) <= 4
    assert [(i, *s.values()) for at, spans in parts for i, s in zip(at, spans.to_pylist(), strict=True)] == sum(want, [])
    whole = list(text._text_runs(pa.array(said)))
    assert [b for b, _ in whole] == [0, 1]
    assert [[tuple(s.values()) for s in row] for _, rows in whole for row in rows.to_pylist()] == [[s[1:] for s in w] for w in want]


def test_places_need_no_shuffle(docs):
    """Places counted within the row are those of the sorted table."""
    want = occurrences.ordered(occurrences.occurrences(docs)).drop("row").collect()
    got = occurrences.placed_occurrences(docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = lambda found: sorted(tuple(map(str, r.asDict().values())) for r in found)
    assert rows(got.drop("row").collect()) == rows(want)


def test_pairs_are_aligned_within_rows(docs):
    """As the join of all spans and tokens gives them, rows of one id together, and no token is shuffled."""
    from pyspark.sql import Window

    from lumenfold.operators import alignment
    from lumenfold.plans.corpus_plans import pair_alignment

    spans = text.token_spans(docs, row="row")
    run = Window.partitionBy("row", "run").orderBy("ord")
    keyed = spans.withColumn("key", text.atom_key(text.canonical_surface(F.col("surface"))))
    pairs = keyed.select("row", "doc_id", "start_char", F.lead("end_char").over(run).alias("end_char"), F.concat("key", F.lit(" "), F.lead("key").over(run)).alias("key")).where("end_char IS NOT NULL")
    features = pairs.withColumn("feature_id", F.conv(F.substring(F.sha2("key", 256), 1, 6), 16, 10).cast("int")).drop("key")
    tokens = spans.select("row", F.col("ord").alias("token_index"), F.col("start_char").alias("token_start"), F.col("end_char").alias("token_end"))
    joined = alignment.align_right_edge(features, tokens, "row")
    want = joined.groupBy("doc_id").agg(F.count_distinct("token_index", "feature_id").alias("aligned"), F.sum("token_index").alias("index_sum"), F.sum("feature_id").alias("feature_sum")).collect()
    got = pair_alignment(docs)
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) == 2


ODD = ["a b c. a b c d e\nf; $ 5 4.5% 1/2/2025 w-2 1099-B x_y/z don't ab1 a1 q-r", "", None, "one two " * 30 + "! wonderful-long_words", "é Ünïcode –dash 2024 3,000.50 -$7 +4 a--b 𝒳 x", ";;;. . .", "z", "x" * 64 + " " + "y" * 65, "a-b-c-d-e-a f/g/f $\n5.\n6"]


def _digests(rows) -> dict:
    """By row, from single occurrences with their places."""
    found: dict = {}
    for r in rows:
        last, place, key = found.get(r["row"], (0, 0, 0))
        number = int(hashlib.sha256(r["key"].encode()).hexdigest()[:4], 16)
        found[r["row"]] = (max(last, r["place"]), place + (r["place"] * r["end_char"] + r["order"]) % 1000003, key + (r["place"] + 1) * number % 1000003)
    return found


def test_place_digests(spark):
    """As single occurrences give them, texts of one id apart; no occurrence is a row, and nothing is shuffled."""
    docs = spark.createDataFrame([*TEXTS, *enumerate(ODD)], "doc_id long, text string").repartition(2).cache()
    singles = occurrences.placed_occurrences(docs).collect()
    want, ids = _digests(singles), {r["row"]: r["doc_id"] for r in singles}
    got = occurrences.place_digests(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "lambdafunction" not in plan
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((ids[r], *d)) for r, d in want.items())


@pytest.mark.parametrize("most", [4, 5, 7, 1 << 17])
def test_digests_of_parts(monkeypatch, most):
    """Texts in parts, occurrences a few at a time and forgotten keys give the same occurrences."""
    import pyarrow as pa

    def all_of(keys, **sizes):
        return sorted(x for at, place, end, order, number in occurrences._placed(pa.array(ODD * 2), keys, **sizes) for x in zip(at, place, end, [order] * len(at) if isinstance(order, int) else order, number, strict=True))

    want = all_of(occurrences._Keys(occurrences._own))
    assert [p for at, p, *_ in want if at == 0] == list(range(sum(x[0] == 0 for x in want)))
    monkeypatch.setattr(occurrences, "REMEMBERED", 3)
    assert all_of(occurrences._Keys(occurrences._own), most=most, placed=3) == want


def test_ordered_occurrences_query(spark, tmp_path):
    """The registered query makes no occurrence a row."""
    from lumenfold.plans import corpus_plans

    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_plans.ordered_occurrences(spark, str(tmp_path))
    assert got.columns == ["doc_id", "last_place", "place_digest", "key_digest"] and got.count() == 6  # texts with tokens
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def test_text_statistics(spark):
    """As single occurrences give them, texts of one id apart."""
    docs = spark.createDataFrame([*TEXTS, *enumerate(ODD)], "doc_id long, text string").repartition(2).cache()
    want = occurrences.extraction_statistics(occurrences.occurrences(docs))
    got = occurrences.text_statistics(docs)
    assert got.columns == want.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


@pytest.mark.parametrize("most", [4, 5, 7])
def test_statistics_of_parts(monkeypatch, most):
    """Texts in parts, long items and forgotten keys change no count."""
    import pyarrow as pa

    want = occurrences._statistics(pa.array(ODD * 2), occurrences._Keys(occurrences._shapes)).tolist()
    monkeypatch.setattr(occurrences, "REMEMBERED", 3)
    assert occurrences._statistics(pa.array(ODD * 2), occurrences._Keys(occurrences._shapes), most).tolist() == want
    monkeypatch.setattr(occurrences, "CHARACTERS", most)
    assert occurrences._statistics(pa.array(ODD * 2), occurrences._Keys(occurrences._shapes)).tolist() == want


def test_extraction_statistics_query(spark, tmp_path):
    """The registered query makes no occurrence a row and shuffles nothing."""
    from lumenfold.plans import corpus_plans

    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_plans.extraction_statistics(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 6 and "Generate" not in plan and "Exchange" not in plan
