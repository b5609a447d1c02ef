from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import alignment, clusters, corpus, export, integrity, metrics, rules, scenarios, sequences
from lumenfold.plans import rule_plans
from lumenfold.sources import readers, writers
from lumenfold.streaming import metrics_stream


@pytest.mark.parametrize(("n", "want"), [(10, [4, 4, 2]), (9, [4, 3, 2]), (3, [3]), (2, [2]), (5, [3, 2]), (4, [4]), (8, [4, 4])])
def test_blocks(spark, n, want):
    found = spark.range(1).select(sequences.blocks(F.lit(n), 4).alias("b")).first()["b"]
    assert [b["end"] - b["start"] for b in found] == want and found[0]["start"] == 0 and found[-1]["end"] == n
    with pytest.raises(ValueError):
        sequences.blocks(F.lit(1), 2)


def test_block_rows_and_padding(spark):
    rows = spark.createDataFrame([("r", list(range(9)), [-100] * 3 + list(range(6)))], "record_id string, input_ids array<int>, labels array<int>")
    got = sequences.token_blocks(rows, 4).orderBy("record_id").collect()
    assert [r["record_id"] for r in got] == ["r#tok=0:4", "r#tok=4:7", "r#tok=7:9"] and [r["supervised_token_count"] for r in got] == [1, 3, 2]
    assert sum((r["input_ids"] for r in got), []) == list(range(9))
    ids = F.array(F.lit(10), F.lit(11))
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(sequences.pad_left(ids, sequences.padded_length(F.lit(2), 4), 99)) == [99, 99, 10, 11]
    assert one(sequences.pad_right(ids, F.lit(8), -100)) == [10, 11] + [-100] * 6 and one(sequences.attention(ids, F.lit(4))) == [1, 1, 0, 0]
    assert one(sequences.fixed_width(ids, 4)) == [10, 11, 0, 0] and one(sequences.unflatten(F.array(*map(F.lit, range(6))), 3)) == [[0, 1, 2], [3, 4, 5]]
    assert one(sequences.masked_labels(ids, F.array(F.lit(0), F.lit(1)))) == [-100, 11]


def test_right_edge_alignment(spark):
    tokens = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 4, 10), (1, 2, 10, 200)], "doc_id long, token_index int, token_start int, token_end int")
    spans = spark.createDataFrame([(1, 0, 10, 123), (1, 0, 4, 5), (1, 150, 199, 6), (1, 195, 201, 7)], "doc_id long, start_char int, end_char int, feature_id int")
    assert {r["feature_id"]: r["token_index"] for r in alignment.align_right_edge(spans, tokens).collect()} == {123: 1, 5: 0, 6: 2}
    assert [r["feature_id"] for r in alignment.unaligned(spans, tokens).collect()] == [7]


def test_top_features_against_sorting(spark):
    rng = random.Random(3)
    rows = [(1, rng.randrange(3), *rng.choice([("word", 1), ("word", 2), ("word", 3), ("word", 4), ("char", 3), ("char", 4), ("char", 5)]), rng.random() < 0.3, rng.randrange(40)) for _ in range(400)]
    got = alignment.top_features(spark.createDataFrame(rows, "doc_id long, token_index int, kind string, ord int, alias boolean, feature_id int"), most=10).collect()
    place = {("word", 4): 0, ("word", 3): 1, ("word", 2): 2, ("word", 1): 3, ("char", 5): 4, ("char", 4): 5, ("char", 3): 6}
    for r in got:
        best: dict = {}
        for _, t, k, o, a, f in rows:
            if t == r["token_index"]:
                best[f] = min(best.get(f, (9,)), (place[k, o], int(a), f))
        want = [f for _, _, f in sorted(best.values())]
        assert r["feature_ids"] == want[:10] and r["candidate_count"] == len(want) and r["dropped"] == max(0, len(want) - 10)


def test_segments_and_offsets(spark):
    segments = spark.createDataFrame([("r", "m0", 5, 10), ("r", "m1", 12, 20)], "record_id string, segment_id string, seg_start int, seg_end int")
    tokens = spark.createDataFrame([("r", 0, 0, 5), ("r", 1, 5, 8), ("r", 2, 8, 11), ("r", 3, 9, 13), ("r", 4, 12, 20)], "record_id string, token_index int, start int, end int")
    got = {r["token_index"]: (r["segment_id"], r["local_start"], r["problem"] is not None) for r in alignment.map_to_segments(tokens, segments).collect()}
    assert got == {0: (None, None, False), 1: ("m0", 0, False), 2: (None, None, True), 3: (None, None, True), 4: ("m1", 0, False)}
    offsets = spark.createDataFrame([("r", 0, 0, 4, 9), ("r", 1, 3, 5, 9), ("r", 2, 5, 5, 9), ("r", 3, 8, 7, 9), ("r", 4, 5, 11, 9)], "record_id string, token_index int, start int, end int, text_length int")
    assert [(r["token_index"], r["problem"]) for r in alignment.offset_problems(offsets).orderBy("token_index").collect()] == [(1, "runs backwards"), (3, "out of range"), (4, "out of range")]
    said = spark.createDataFrame([(["a", "bb", "a"],)], "m array<string>").select(alignment.message_segments(F.col("m"), F.lit("<a><bb><a>")).alias("s"), alignment.with_sentinels(F.col("m")).alias("w")).first()
    assert [(s["start"], s["end"]) for s in said["s"]] == [(1, 2), (4, 6), (8, 9)]
    assert spark.createDataFrame([("".join(said["w"]),)], "t string").select(alignment.without_sentinels(F.col("t"))).first()[0] == "abba"


def test_components_of_chains_and_stars(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(120)] + [(900, 500), (500, 700)], "a long, b long")
    rows = spark.createDataFrame([(i,) for i in [*range(121), 500, 700, 900, 42_000]], "n long")
    got = {r["n"]: r["component"] for r in clusters.components(rows, "n", links).collect()}
    assert all(got[i] == 0 for i in range(121)) and {got[500], got[700], got[900]} == {500} and got[42_000] == 42_000


def test_cluster_ids_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([("s1", "f1", "x"), ("s2", "f1", "y"), ("s3", "f2", "y"), ("s4", "f3", "z")], "id string, family string, shape string")
    a, b = ({r["id"]: r["cluster_id"] for r in clusters.clusters(rows.repartition(n), "id", "family", "shape").collect()} for n in (1, 5))
    assert a == b and a["s1"] == a["s2"] == a["s3"] != a["s4"]


def test_records_and_fallback(spark):
    pages = spark.createDataFrame([("S", 1, "one\n\n" + "x " * 400), ("S", 2, "  \n "), ("S", 3, "three")], "source_id string, page int, text string")
    got = corpus.in_record_order(corpus.records_of(pages, 512)).collect()
    assert [r["record_id"] for r in got] == ["CPT-S-P0001-C001", "CPT-S-P0001-C002", "CPT-S-P0001-C003", "CPT-S-P0003-C001"]
    assert got[0]["text"] == "one" and any(r["split"] == "validation" for r in got)
    stats = corpus.length_statistics(spark.createDataFrame([(i,) for i in range(1, 11)], "n int"), "n").first()
    assert (stats["total"], stats["median"], stats["p90"], stats["p99"]) == (55, 5.5, 9, 10)
    zero = corpus.length_statistics(spark.createDataFrame([], "n int"), "n").first()
    assert (zero["n"], zero["mean"], zero["maximum"]) == (0, 0, 0)


def test_metrics(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    arr = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    assert tuple(one(metrics.set_scores(arr(), arr()))) == (1, 1, 1, 1) and one(metrics.set_scores(arr("a"), arr()))["precision"] == 0
    for t, want in {'{"status":"OK"}': (1, 1), "[1]": (1, 0), '{"a":1}': (1, 0), "{": (0, 0), '{"status":1}}': (0, 0), "1],[2": (0, 0), "": (0, 0)}.items():
        assert tuple(one(metrics.json_scores(F.lit(t), ["status"]))) == want, t
    top = one(metrics.top_k_experts(F.array(*[F.lit(float(x)) for x in (1, 4, 2, 3)]), 2))
    assert top["experts"] == [1, 3] and top["weights"] == pytest.approx([math.e / (1 + math.e), 1 / (1 + math.e)])
    rows = spark.createDataFrame([([0.25] * 4, e) for e in ([0, 1], [2, 3], [0, 2], [1, 3])], "probabilities array<double>, experts array<int>")
    assert metrics.balance_loss(metrics.expert_balance(rows, 4, 2), 4).first()["loss"] == pytest.approx(1)
    loss = lambda v, n: metrics.token_weighted_loss(spark.createDataFrame([(v, n)], "loss_sum double, tokens int")).first()["perplexity"]
    assert loss(2.0, 2) == pytest.approx(math.e) and loss(500.0, 2) == math.inf and math.isnan(loss(0.0, 0))
    paired = metrics.paired_counts(spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "b boolean, a boolean"), F.col("b"), F.col("a")).first()
    assert tuple(paired) == (1, 1, 1, 1)
    bench = spark.createDataFrame([("bf16", 512, m, "pass", True) for m in (1, 2, 4)] + [("bf16", 1024, 1, "oom", True)], "precision string, sequence_length int, microbatch_size int, status string, gradient_checkpointing boolean")
    assert {r["sequence_length"]: (r["max_microbatch"], r["recommended"]) for r in metrics.safe_envelope(bench, "bf16").collect()} == {512: (4, 2), 1024: (None, None)}
    summary = metrics.seed_summary(spark.createDataFrame([(2.0,)], "v double"), "v").first()
    assert (summary["n"], summary["std"]) == (1, 0)


def test_rules_and_values(spark):
    facts = spark.createDataFrame([("s", 0, "c", "unknown", None), ("s", 1, "c", "present", "10"), ("s", 2, "c", "present", "5"), ("s", 3, "d", "conflicting", None)], "scenario_id string, ord int, concept_id string, state string, value string")
    conditions = {"EXISTS": (None, True), "missing": (None, False), "EQ": ("10.0", True), "NE": ("10", False), "GT": ("9", True), "GTE": ("10", True), "LT": ("9", False), "LTE": ("10", True)}
    table = [(op, "verified", [], [("c", op, v, None)], []) for op, (v, _) in conditions.items()] + [("REF", "verified", [], [("c", "GT", None, "nowhere")], []), ("NEABSENT", "verified", [], [("x", "NE", "1", None)], [])]
    got = {r["rule_id"] for r in rules.activated(spark.createDataFrame([("s",)], "scenario_id string"), spark.createDataFrame(table, rule_plans.RULE_SCHEMA), facts, spark.createDataFrame([], "value_id string, value long")).collect()}
    assert got == {op for op, (_, ok) in conditions.items() if ok}
    bad = spark.createDataFrame([("B", "verified", [], [("c", "ABOUT", "1", None)], [])], rule_plans.RULE_SCHEMA)
    with pytest.raises(Exception, match="unknown operator"):
        rules.activated(spark.createDataFrame([("s",)], "scenario_id string"), bad, facts).collect()
    with pytest.raises(Exception, match="ambiguous lookup"):
        rules.unique_lookup(spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int"), ["k"], "v").collect()


def test_scenarios(spark):
    base = scenarios.generate(spark, rule_plans.TEMPLATES, {"T-SALE": 12}, 2025, 42)
    again = scenarios.generate(spark, rule_plans.TEMPLATES, {"T-SALE": 12}, 2025, 42)
    rows = {r["scenario_id"]: r for r in base.collect()}
    assert len(rows) == 12 and rows == {r["scenario_id"]: r for r in again.repartition(5).collect()}
    for r in rows.values():
        v = {f["concept_id"]: f["value"] for f in r["facts"]}
        assert v["asset.acquired"] < v["asset.sold"] and int(v["asset.proceeds"]) >= 1000 and v["asset.sold"].startswith("2025")
        assert r["facts"][0]["event_id"] and r["facts"][3]["event_id"] is None
    child = scenarios.mark_unknown(base, "asset.kind").first()
    assert child["scenario_id"] not in rows and child["parent_id"] in rows and child["facts"][3]["state"] == "unknown" and child["facts"][3]["value"] is None
    clash = scenarios.create_conflict(base, "asset.kind", "other").first()["facts"][3]
    assert clash["state"] == "conflicting" and [tuple(a) for a in clash["assertions"]][1] == (f"A-{clash['fact_id']}-2", "other", "user_statement") and clash["assertions"][0]["source_type"] == "tax_document"
    assert scenarios.forced_assumption(base, "asset.kind", "fund").first()["context"][0]["suggested_value"] == "fund"
    with pytest.raises(Exception, match="no fact with concept"):
        scenarios.mark_unknown(base, "nothing").collect()
    made = {}
    for spec in ({"type": "constant", "value": 3}, {"type": "choice", "values": [1]}, {"type": "integer_range", "min": 2, "max": 2}, {"type": "boolean_probability", "value": 1}, {"type": "value_ref", "value_ref": "cap"}, {"type": "value_ref_boundary", "value_ref": "cap", "boundary_position": "below"}):
        made[spec["type"]] = scenarios.draw(spec, random.Random(1), 2025, {}, {"cap": 9})
    assert made == {"constant": 3, "choice": 1, "integer_range": 2, "boolean_probability": True, "value_ref": 9, "value_ref_boundary": 8}
    with pytest.raises(ValueError):
        scenarios.draw({"type": "x"}, random.Random(1), 2025, {}, {})


def test_examples(spark):
    row = [("S", 2025, "train", [("c", "1", "present"), ("d", None, "unknown")], "NEEDS_INFORMATION", [], ["d"], [], [], ["F"], [], [], [])]
    schema = "scenario_id string, tax_year int, split string, facts array<struct<concept_id:string,value:string,state:string>>, status string, " + ", ".join(f"{c} array<string>" for c in export.OUTCOMES[1:])
    got = {r["renderer"]: r for r in export.build_examples(spark.createDataFrame(row, schema), ["t"]).collect()}
    assert got["concise"]["input"] == "Tax year 2025. Facts: c=1; d=unknown. Task: t." and got["concise"]["target"] == "NEEDS_INFORMATION | Missing: d | Candidate forms: F"
    assert '"missing_information": ["d"], "protocol_version": "0.1"' in got["structured"]["target"] and [m["role"] for m in got["concise"]["messages"]] == ["system", "user", "assistant"]
    twice = export.build_examples(spark.createDataFrame(row * 2, schema), ["t"])
    assert export.distinct_examples(twice).count() == 2 and export.conflicting_targets(twice).count() == 0
    assert export.CALCULATIONS.run("capital_gain", 5, 3) == 2
    with pytest.raises(ValueError):
        export.CALCULATIONS.register("capital_gain", abs)
    with pytest.raises(KeyError):
        export.CALCULATIONS.run("nothing")


def test_readers(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"example_id":"e","dataset_family":"f","task_id":"t","messages":[{"role":"system","content":"s"},{"role":"user","content":"u"},{"role":"assistant","content":"a"}]}\n\n{"record_id":"","messages":[]}\n')
    rows = readers.dialogue_records(readers.json_lines(spark, str(tmp_path / "d.jsonl"), readers.DIALOGUE)).collect()
    good = next(r for r in rows if r["record_id"] == "e")
    assert good["metadata"] == {"dataset_family": "f", "task_id": "t"} and good["problem"] is None and good["split"] == "train"
    assert next(r for r in rows if r["record_id"] is None)["problem"] == "no id"
    assert [r["line"] for r in readers.numbered_lines(spark, str(tmp_path / "d.jsonl")).collect()] == [1, 3]
    (tmp_path / "r.yaml").write_text("rules:\n- {id: a, v: 1}\n- {id: b, v: 2}\n- {id: a, v: 3}\n")
    assert {r["id"]: r["v"] for r in readers.registry(spark, [tmp_path / "r.yaml"], "rules", "id", "id string, v int").collect()} == {"a": 3, "b": 2}
    (tmp_path / "p.pdf").write_bytes(b"one|  |three")
    pages = readers.pages_of(spark, str(tmp_path), lambda b: b.decode().split("|"))
    assert [(r["source_id"], r["page"], r["text"]) for r in pages.orderBy("page").collect()] == [("p", 1, "one"), ("p", 3, "three")]
    with pytest.raises(ValueError):
        readers.strict({"a": 1, "b": 2}, ["a"])


def test_cache_release_and_json(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i}", "train" if i % 4 else "validation", [i], [i], 1) for i in range(40)], "record_id string, split string, input_ids array<int>, labels array<int>, token_count int")
    stats = {r["split"]: (r["records"], r["first_id"], r["last_id"]) for r in writers.write_cache(rows, str(tmp_path / "cache")).collect()}
    assert stats == {"train": (30, "r1", "r9"), "validation": (10, "r0", "r8")} and readers.read_cache(spark, str(tmp_path / "cache"), "validation").count() == 10
    with pytest.raises(ValueError):
        readers.read_cache(spark, str(tmp_path / "cache"), "test_id")
    with pytest.raises(ValueError):
        writers.write_cache(rows.where("false"), str(tmp_path / "none"))
    release = str(tmp_path / "release")
    manifest = integrity.freeze(rows, release, "R1", {"tests": True})
    assert manifest["records"] == 40 and integrity.verify_release(spark, release) == []
    with pytest.raises(Exception, match="(?i)exists"):
        integrity.freeze(rows, release, "R1")
    with pytest.raises(integrity.ReleaseError):
        integrity.freeze(rows, str(tmp_path / "other"), "R2", {"tests": False})
    victim = next((tmp_path / "release/data").glob("*.parquet"))
    victim.write_bytes(victim.read_bytes() + b"x")
    victim.with_name(f".{victim.name}.crc").unlink(missing_ok=True)
    assert integrity.verify_release(spark, release) == [f"{victim.name}: size"]
    writers.write_json_lines(spark.createDataFrame([(2, None), (1, "é")], "b int, a string"), str(tmp_path / "j"), "b")
    assert "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part-*"))) == '{"a":"é","b":1}\n{"a":null,"b":2}\n'
    sealed = integrity.sealed({"x": 1})
    assert integrity.seal_holds(sealed) and not integrity.seal_holds(sealed | {"x": 2}) and integrity.same_build({"a": 1}, {"a": 2}, ("a", "b")) == ["a"]


def test_config_diff(spark):
    frame = lambda c: spark.createDataFrame(list(integrity.flatten(c).items()), "path string, value string")
    diff = integrity.differing_paths(frame({"a": 1, "b": {"x": 2}}), frame({"a": 3, "b": {"x": 4}}))
    assert {r["path"] for r in diff.collect()} == {"a", "b.x"} and [r["path"] for r in integrity.one_variable_changed(diff, "a").collect()] == ["b.x"]


def test_stream(spark, tmp_path):
    steps = spark.createDataFrame([("r", i, f"2025-01-01 00:0{i}:00", float(i), 10) for i in range(4)], "run_id string, step long, ts string, loss double, tokens long").withColumn("ts", F.to_timestamp("ts"))
    writers.append_metrics(steps, str(tmp_path / "in"))
    q = metrics_stream.progress(metrics_stream.read_steps(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("progress").start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("progress").first()) == ("r", 4, 40, 3)
    w = metrics_stream.start(metrics_stream.windowed_loss(metrics_stream.read_steps(spark, str(tmp_path / "in")), late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))
    w.processAllAvailable()
    w.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 3


def test_chat_tokens(spark):
    from lumenfold.functions import tokenizer

    rows = spark.createDataFrame([(1, [("user", "hi there"), ("assistant", "a 1é!"), ("user", "")])], "id int, messages array<struct<role:string,content:string>>")
    r = tokenizer.tokenize_chat(rows).first()
    assert "".join(r["rendered"][s["start"] : s["end"]] for s in r["spans"]) == r["rendered"]
    assert "".join(r["rendered"][s["start"] : s["end"]] for s, m in zip(r["spans"], r["assistant_mask"], strict=True) if m) == "a 1é!"
    assert [r["rendered"][g["start"] : g["end"]] for g in r["segments"]] == ["hi there", "a 1é!", ""]
    assert all(tokenizer.capabilities().values())


def test_build(spark, tmp_path):
    import json

    from lumenfold.plans.build import Build, BuildError

    rule_rows = [("R", "verified", [], [("asset.proceeds", "EXISTS", None, None)], [("ADD_TOPIC", "sale")]), ("Q", "verified", [], [], [("REQUIRE_INFORMATION", "asset.proceeds")])]
    config = {"rules": rule_rows, "rule_schema": rule_plans.RULE_SCHEMA, "templates": rule_plans.TEMPLATES, "counts": {"T-SALE": 6}, "tax_year": 2025, "seed": 1, "mark_unknown": ["asset.proceeds"], "tasks": ["t1", "t2"]}
    build = Build(spark, tmp_path, config)
    summary = build.run()
    record = json.loads((build.folder / "build.json").read_text())
    assert record["state"] == "COMPLETED" and [h[0] for h in record["history"]][:2] == ["PREPARING", "GENERATING"]
    assert summary["base"] == 6 and summary["mutated"] == 6 and summary["examples"] == 48 and summary["clusters"] == 1
    bad = Build(spark, tmp_path, config | {"seed": 2})
    bad.validate = lambda *a: ["SPLIT-LEAKAGE: 1 values of family_id"]
    with pytest.raises(BuildError):
        bad.run()
    assert json.loads((bad.folder / "build.json").read_text())["state"] == "FAILED" and not (bad.folder / "exports").exists()


def test_orders_and_conservation(spark):
    from lumenfold.functions.hashing import hash_manifest

    assert sorted(sequences.pass_order(9, 3, 1)) == list(range(9)) and sequences.pass_order(9, 3, 1) == sequences.pass_order(9, 3, 1) != sequences.pass_order(9, 3, 2)
    rows = spark.createDataFrame([(4,), (5,)], "token_count int")
    sequences.token_conservation(rows, 9)
    with pytest.raises(ValueError):
        sequences.token_conservation(rows, 8)
    assert hash_manifest()["rows"] == 147_457 and hash_manifest(b"other")["digest"] != hash_manifest()["digest"]


def test_segments_within_rows_are_those_of_the_join(spark):
    """Empty segments, gaps and borders; and no token becomes a row of a join."""
    cuts = {"a": [(0, 9), (19, 19), (29, 60)], "b": [(3, 5)], "c": [(7, 14), (14, 28)]}
    segments = spark.createDataFrame([(r, i, a, z) for r, own in cuts.items() for i, (a, z) in enumerate(own)], "record_id string, segment_id int, seg_start int, seg_end int")
    tokens = spark.createDataFrame([(r, i, 7 * i, 7 * i + 7) for r in cuts for i in range(10)], "record_id string, token_index int, start int, end int")
    joined = alignment.map_to_segments(tokens, segments).collect()
    want = {(r["record_id"], r["token_index"]): -1 if r["problem"] else r["segment_id"] for r in joined}
    said = segments.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("segment_id", "seg_start", "seg_end"))).alias("s")).withColumn("starts", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i * 7))
    found = said.select("record_id", alignment.segments_within(F.col("starts"), F.transform("starts", lambda a: a + 7), F.col("s.seg_start"), F.col("s.seg_end")).alias("at"))
    assert {(r["record_id"], i): x for r in found.collect() for i, x in enumerate(r["at"])} == want


def test_padding_widths_are_broadcast(spark, tmp_path):
    """A split is not one task's rows."""
    from lumenfold.plans.registry import QUERIES

    spark.createDataFrame([(c, t, "user", "ab" * (c % 9)) for c in range(40) for t in range(3)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plan = QUERIES["padded_batches"](spark, str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()
        assert plan.count() == 120
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tokens_are_held_in_parts(monkeypatch):
    """Few tokens are objects at a time; texts come back whole and in order, spans and ids of their own lengths."""
    import pyarrow as pa

    from lumenfold.functions import tokenizer

    monkeypatch.setattr(tokenizer, "TOKENS_HELD", 3)
    said, cut = ["one two three four", None, "", "x", "a b c d e"], tokenizer.word_tokenizer()
    want = [{"ids": cut(t or "")[0], "spans": [{"start": a, "end": z} for a, z in cut(t or "")[1]]} for t in said]
    assert tokenizer._tokens_of(cut, pa.array(said)).to_pylist() == want
    assert tokenizer._tokens_of(lambda t: ([1] * len(t), []), pa.array(["ab", "c"])).to_pylist() == [{"ids": [1, 1], "spans": []}, {"ids": [1], "spans": []}]
    assert tokenizer._tokens_of(cut, pa.array([], pa.string())).to_pylist() == []


def test_rules_need_no_python_workers(spark):
    """Rules and values at hand are part of the plan."""
    from lumenfold.plans import rule_plans
    from lumenfold.sources.storage import literal_rows

    rules_ = rule_plans.rule_table(spark)
    want = spark.createDataFrame(rule_plans.RULES, rule_plans.RULE_SCHEMA)
    assert sorted(map(str, rules_.collect())) == sorted(map(str, want.collect())) and rules_.dtypes == want.dtypes
    assert "ExistingRDD" not in rules_._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in literal_rows(spark, [("a", None), (None, 2)], "x string, y long").collect()] == [("a", None), (None, 2)]
