"""Canonical JSON, seeded permutations, hashes of files in pieces, leaves of documents."""

from __future__ import annotations

import datetime
import decimal
import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions import canonical, hashing, permutation
from lumenfold.operators import integrity
from lumenfold.sources import readers, writers
from lumenfold.sources.storage import canonical_json


def test_floats_as_python_writes_them(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 1.0, 100.0, 0.1, 1e15, 1e16, 123456789012345680.0, 1e22, 1e-4, 9.9e-5, 1e-5, 1.7976931348623157e308, float("nan"), float("inf"), float("-inf"), 12345.678, -2.5e-7, 1e100, None]
    values += [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-20, 25) for _ in range(800)] + [float(rng.randrange(10**18)) for _ in range(200)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(canonical.canonical(F.col("v"), T.DoubleType()).alias("j")).collect()
    for r, v in zip(got, values, strict=True):
        same = r["j"] == json.dumps(v)
        # Java before 19 may choose another text of the same value, a digit longer at most, where 15 digits or more are needed
        assert same or (json.loads(r["j"]) == v and len(r["j"]) <= len(json.dumps(v)) + 1 and len(json.dumps(v)) >= 16), (r["j"], v)


def test_short_floats_are_exactly_pythons(spark):
    rng = random.Random(4)
    values = [rng.choice([-1, 1]) * rng.randrange(10 ** rng.randrange(1, 15)) / 10 ** rng.randrange(0, 20) for _ in range(800)] + [rng.randrange(1, 10**6) * 10.0 ** rng.randrange(0, 30) for _ in range(100)]
    got = spark.createDataFrame([(float(v),) for v in values], "v double").select(canonical.canonical(F.col("v"), T.DoubleType()).alias("j")).collect()
    assert [r["j"] for r in got] == [json.dumps(float(v)) for v in values]


def test_nested_columns(spark):
    kind = "z array<struct<b:int,a:string>>, m map<string,map<string,double>>, s struct<y:boolean,x:struct<q:decimal(9,2),p:date>>, t timestamp, e array<array<string>>, n void, `ü k` string, l long"
    rows = [
        ([(1, 'q"\\/\b\f\n\r\t\x01\x1f\x0b\x7f é 日  '), None, (None, None)], {"b": {"z": 1.0, "a": 2.5e-9}, "a": None, "é": {}}, (True, (decimal.Decimal("1.50"), datetime.date(2025, 2, 3))), datetime.datetime(2025, 1, 2, 3, 4, 5, 60), [[], [None, "x"]], None, "v", -5),
        (None, None, None, None, None, None, None, None), ([], {}, (None, None), datetime.datetime(2025, 1, 2), [], None, "\\u001F \x1f \\\x1e", 2**62),
    ]
    df = spark.createDataFrame(rows, kind)
    got = [r["j"] for r in df.select(canonical.canonical_row(df.schema).alias("j")).collect()]

    def plain(v, k):
        if v is None:
            return None
        if isinstance(k, T.StructType):
            return {f.name: plain(x, f.dataType) for f, x in zip(k, v, strict=True)}
        if isinstance(k, T.ArrayType):
            return [plain(x, k.elementType) for x in v]
        return {a: plain(b, k.valueType) for a, b in v.items()} if isinstance(k, T.MapType) else v

    assert got == [canonical_json(plain(r, df.schema)) for r in rows]


def test_variants_and_refusals(spark):
    df = spark.sql("""SELECT parse_json('{"b": {"d": 1, "c": [true, null]}, "a": "x"}') AS v""")
    assert df.select(canonical.canonical(F.col("v"), T.VariantType()).alias("j")).head()[0] == '{"a":"x","b":{"c":[true,null],"d":1}}'
    for bad in (T.BinaryType(), T.MapType(T.IntegerType(), T.StringType())):
        with pytest.raises(TypeError):
            canonical.canonical(F.lit(None), bad)


def test_hash_of_any_columns(spark):
    df = spark.createDataFrame([("a\x1b", [1, 2], {"k": None})], "a string, b array<int>, c map<string,string>")
    got = df.select(canonical.canonical_hash(*[(F.col(f.name), f.dataType) for f in df.schema]).alias("h"), hashing.stable_hash(hashing.json_string(F.col("a"))).alias("s")).head()
    assert got["h"] == hashlib.sha256(canonical_json(["a\x1b", [1, 2], {"k": None}]).encode()).hexdigest()
    assert got["s"] == hashlib.sha256(canonical_json(["a\x1b"]).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 10, 100, 1009, 4096, 20_001])
def test_permutation_is_one_and_turns_back(spark, n):
    rows = spark.range(-1, n + 1).select("id", permutation.place_of(F.col("id"), n, 5).alias("p"))
    got = {r["id"]: (r["p"], r["b"]) for r in rows.withColumn("b", permutation.row_at(F.col("p"), n, 5)).collect()}
    assert got.pop(-1) == (None, None) and got.pop(n) == (None, None)
    assert sorted(p for p, _ in got.values()) == list(range(n)) and all(b == i for i, (_, b) in got.items())
    if n > 1000:
        assert sum(abs(got[i][0] - got[i + 1][0]) == 1 for i in range(n - 1)) < 20
        other = spark.range(n).select(permutation.place_of(F.col("id"), n, 6).alias("p")).collect()
        assert sum(r["p"] == got[i][0] for i, r in enumerate(other)) < 20


def test_permutation_equals_sql(spark):
    n, seed = 500, 9
    c = duckdb.connect()
    c.sql(f"CREATE TABLE t AS SELECT range AS k FROM range({n})")
    want = dict(c.sql(permutation.place_sql("t", "k", n, seed)).fetchall())
    assert {r["id"]: r["p"] for r in spark.range(n).select("id", permutation.place_of(F.col("id"), n, seed).alias("p")).collect()} == want


def test_files_of_any_size_are_hashed(spark, tmp_path):
    """A file of 2.5 GB (with holes) is no row; odd names and empty files too."""
    (tmp_path / "a b é").mkdir()
    (tmp_path / "a b é" / "x%20y.bin").write_bytes(b"abc" * 1000)
    (tmp_path / "empty").write_bytes(b"")
    with (tmp_path / "large").open("wb") as f:
        f.truncate(5 << 29)
        f.seek(1 << 30)
        f.write(b"middle")
    whole = hashlib.sha256()
    with (tmp_path / "large").open("rb") as f:
        while piece := f.read(1 << 22):
            whole.update(piece)
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        got = {r["path"]: (r["bytes"], r["sha256"]) for r in integrity.file_records(spark, folder).collect()}
        assert got == {"a b é/x%20y.bin": (3000, hashlib.sha256(b"abc" * 1000).hexdigest()), "empty": (0, hashlib.sha256(b"").hexdigest()), "large": (5 << 29, whole.hexdigest())}


def test_json_lines_say_what_was_written(spark, tmp_path):
    df = spark.createDataFrame([(2, {"b": "x", "a": None}), (1, {})], "id int, m map<string,string>")
    made = writers.write_json_lines(df.coalesce(1), str(tmp_path / "out"), "id").collect()
    raw = {p.name: p.read_bytes() for p in (tmp_path / "out").glob("part-*")}
    assert b"".join(raw[k] for k in sorted(raw)) == b'{"id":1,"m":{}}\n{"id":2,"m":{"a":null,"b":"x"}}\n'
    assert {(r["path"], r["bytes"], r["sha256"]) for r in made} == {(k, len(v), hashlib.sha256(v).hexdigest()) for k, v in raw.items()} and sum(r["records"] for r in made) == 2
    assert readers.json_lines(spark, str(tmp_path / "out"), "id int").count() == 2


def test_leaves_of_documents(spark):
    docs = [{"a": {"b": {"c": 1, "d": {}}}, "e": [1, {"f": 2}], "g": None}, {}, {"x": "y"}, 5, [1], None]
    rows = [(i, None if d is None else json.dumps(d)) for i, d in enumerate(docs)] + [(9, "no json {")]
    got = integrity.leaves(spark.createDataFrame(rows, "k int, j string"), "k", "j").collect()
    want = {(i, p, v) for i, d in enumerate(docs) if d is not None for p, v in integrity.flatten(d).items()}
    assert {(r["k"], r["path"], r["value"]) for r in got} == want


def test_float_steps_are_computed_once(spark):
    """Each step of a double's spelling stands once in the plan, also where the map's values are written by a lambda."""
    rows = spark.createDataFrame([({"a": 0.1},)], "m map<string,double>")
    plan = rows.select(canonical.canonical_row(rows.schema).alias("j"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") < 10 and plan.count("format_string(") <= 4


def test_leaves_deeper_than_a_round(spark):
    """Objects of more levels than one round opens, beside shallow ones; texts that only look like objects; names with dots, or empty."""
    deep = {"end": [1, {"z": {}}]}
    for k in range(3 * integrity.LEVELS, 0, -1):
        deep = {f"l{k}": deep, "own": {"b": None, "e": {}}}
    docs = [deep, {"a": {"b": {"c": {"d": "{not open"}}}}, {"a.b": {"": 1}, "": {"x": "{}"}}, {"a": {"b": {"c": {"d": {}}}}}, "{", {}, [deep]]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(9, "{"), (10, None), (0, json.dumps({"again": True}))]
    got = [(r["k"], r["path"], r["value"]) for r in integrity.leaves(spark.createDataFrame(rows, "k int, j string"), "k", "j").collect()]
    plain = [(i, p, v) for i, d in [*enumerate(docs), (0, {"again": True})] for p, v in integrity.flatten(d).items()]
    assert sorted(got) == sorted(plain)


def test_documents_are_parsed_once(spark, tmp_path):
    """One round for three levels, which parses each document once; its leaves are read back."""
    folder = str(tmp_path / "events")
    spark.createDataFrame([(i, json.dumps({"a": {"b": {"c": i}}})) for i in range(8)], "k int, j string").write.parquet(folder)
    rows = integrity._opened(spark.read.parquet(folder).select("k", F.lit("").alias("path"), F.col("j").alias("value")), "k")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and "schemaOfVariant" not in plan
    found = integrity.leaves(spark.read.parquet(folder), "k", "j")
    assert folder not in " ".join(found.inputFiles()) and sorted(r["value"] for r in found.collect()) == [str(i) for i in range(8)]


def test_config_diff_of_repeated_and_missing_ids(spark, tmp_path):
    """Ids that repeat, lack a neighbour or are null, and configurations that are null, against the SQL."""
    from lumenfold.plans.registry import ORACLE_SQL, QUERIES

    rows = [(1, "a", 1, '{"k": 1}'), (2, "a", 1, '{"k": 2}'), (2, "b", 1, '{"k": 1, "m": {"n": {}}}'), (3, "b", 2, None), (3, "c", 1, '{"k": 2}'), (4, "c", 1, '{"m": {"n": {"o": [1]}}}'), (6, "c", 1, '{"k": 2}'), (None, "c", 1, '{"k": 2}'), (8, "a", 1, "{}"), (9, "a", None, "{}")]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = c.sql(ORACLE_SQL["config_diff"])
    got = QUERIES["config_diff"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) > 12
