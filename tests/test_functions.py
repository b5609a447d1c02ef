from __future__ import annotations

import hashlib
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import hashing, text
from lumenfold.sources import storage


def one(spark, col, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(col.alias("x")).first()["x"]


def test_split_goldens(spark):
    # Known buckets of identifiers.
    clusters = {"CLUSTER-4a045f199aef057aa767": (7854, "train"), "CLUSTER-c8f6bff4bf5d4f4aba7d": (6177, "train"), "CLUSTER-cf9cb0784e1a2af9fd81": (8440, "validation"), "CLUSTER-32034fab4f6f9be8061e": (9273, "test_id")}
    got = spark.createDataFrame([(c,) for c in clusters], "c string").select("c", hashing.cluster_bucket(F.col("c")), hashing.cluster_split(F.col("c"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == clusters
    records = {"CPT-SOURCE-2025-1099B-P0002-C001": "validation", "CPT-SOURCE-2025-W2-P0004-C001": "validation", "CPT-SOURCE-2025-1040-P0001-C001": "train", "CPT-SOURCE-2025-W2-P0011-C001": "train"}
    got = spark.createDataFrame([(c,) for c in records], "c string").select("c", hashing.record_split(F.col("c"))).collect()
    assert {r[0]: r[1] for r in got} == records


@pytest.mark.parametrize("value", ['plain', 'quo"te', "back\\slash", "line\nend\ttab", "é日", ""])
def test_stable_hash_is_the_json_array(spark, value):
    want = storage.content_hash(value, 7, None, True)
    assert one(spark, hashing.stable_hash(hashing.json_string(F.col("v")), 7, None, True), v=value) == want
    assert one(spark, hashing.stable_int(hashing.json_string(F.col("v")), bits=32), v=value) == storage.content_int(value, bits=32)


def test_feature_ids(spark):
    assert hashing.feature_id("word_1", "basis", b"k") != hashing.feature_id("char_5", "basis", b"k")
    f = hashing.feature_hash(b"k")
    got = spark.createDataFrame([("word_2", "cost basis")], "n string, k string").select(f("n", "k").alias("h")).first()["h"]
    assert (got["feature_id"], got["bucket"]) == hashing.feature_id("word_2", "cost basis", b"k") and 1 <= got["feature_id"] < 147_457
    raw = int.from_bytes(hashlib.blake2b(b"word_2\0cost basis", digest_size=8, key=b"k").digest(), "little")
    assert got["bucket"] == raw % 32_768 and got["feature_id"] == 1 + 16_384 + got["bucket"]
    with pytest.raises(ValueError):
        hashing.feature_id("word_1", "", b"k")


def normal_form(value: str) -> str:
    """Brute force: line by line."""
    out: list[str] = []
    for raw in unicodedata.normalize("NFKC", value).replace("\0", "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = " ".join(p for p in raw.replace("\t", " ").replace("\f", " ").replace("\v", " ").split(" ") if p).strip()
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip("\n")


def test_normalise(spark):
    samples = [" Form  1040\r\n\r\n  Tax\tYear 2025  \n", "", "\n\n", "a\r\rb\n\n\n\nc", "ﬁne Ⅷ", "x \0y\f\vz", "  \n a \n \t \n\n b"]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string").orderBy("i").select(text.normalize_document(F.col("s"))).collect()]
    assert got == [normal_form(s) for s in samples] and got[0] == "Form 1040\n\nTax Year 2025"


def test_chunks():
    rng = random.Random(1)
    for _ in range(60):
        value = "\n\n".join(" ".join("x" * rng.randrange(1, 90) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 9))).strip()
        parts = text.chunk_text(value, 600)
        assert all(0 < len(p) <= 600 and p == p.strip() for p in parts)
        assert "".join("".join(parts).split()) == "".join(value.split())
    assert text.chunk_text("", 512) == [] and text.chunk_text("a", 512) == ["a"]
    assert text.chunk_text("y" * 1300, 600) == ["y" * 600, "y" * 600, "y" * 100]
    assert text.chunk_text("y" * 400 + " " + "y" * 400, 600) == ["y" * 400, "y" * 400]
    with pytest.raises(ValueError):
        text.chunk_text("a", 100)


def test_atoms(spark):
    rows = {"Cost": ("word", "cost", []), "$5,000": ("money", "<money>", []), "37": ("number", "<number>", []), "2025": ("tax_year", "2025", []), "1099-B": ("form_like", "1099-b", ["1099b"]), "4.5%": ("percent", "<percent>", []),
            "1/2/2025": ("date", "<date>", []), "w-2": ("form_like", "w-2", ["w2"]), "a_b_a_c": ("word", "a_b_a_c", ["a", "b", "c"]), "x/y-z": ("word", "x/y-z", ["x", "y-z"]), "well-known": ("word", "well-known", ["well", "known"])}
    s = text.canonical_surface(F.col("s"))
    got = spark.createDataFrame([(k,) for k in rows], "s string").select("s", text.atom_class(s), text.atom_key(s), text.atom_aliases(s)).collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in got} == rows


def test_tokens_spans_and_grams(spark):
    import re

    value = "The cost basis is $5,000.50; unknown.\nNew 1099-B rate 4.5% on 1/2/2025, it's é fine-tuned_x!"
    docs = spark.createDataFrame([(1, value)], "doc_id long, text string")
    want = [(m.group(), m.start(), m.end()) for m in re.finditer(text.TOKEN, value)]
    got = text.token_spans(docs).orderBy("ord").collect()
    assert [(r["surface"], r["start_char"], r["end_char"]) for r in got] == want
    grams = {(g["order"], g["key"]) for g in docs.select(text.word_grams(F.col("text")).alias("g")).first()["g"]}
    assert (2, "cost basis") in grams and (4, "cost basis is <money>") in grams and not any("unknown new" in k for _, k in grams) and not any("<money> unknown" in k for _, k in grams)
    chars = spark.range(1).select(text.char_grams(F.lit("abcd")).alias("g")).first()["g"]
    assert [(g["order"], g["pos"], g["key"]) for g in chars] == [(3, 0, "abc"), (3, 1, "bcd"), (4, 0, "abcd")]


def test_files(tmp_path):
    assert json.loads(storage.write_json(tmp_path / "a/b.json", {"b": 1, "a": "é"}).read_text()) == {"a": "é", "b": 1}
    _, md = storage.write_summary(tmp_path, {"records": 3})
    assert "| records | 3 |" in md.read_text()
    assert storage.canonical_json({"b": [1, None], "a": "é"}) == '{"a":"é","b":[1,null]}'
