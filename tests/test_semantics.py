"""Semantics that tables of plain prose never exercise."""

from __future__ import annotations

import random
import time
import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text
from lumenfold.operators import alignment, corpus, rules, sequences


#: Raw text and the document it becomes.
DOCUMENTS = [
    (None, ""), ("", ""), (" ", ""), ("\n\n\n", ""), ("\0", ""), ("a", "a"), ("a\0b", "ab"), ("  a\t\tb  ", "a b"), ("a   b", "a b"), ("a\vb\fc", "a b c"),
    ("a\r\nb\rc\nd", "a\nb\nc\nd"), ("a\r\n\r\n\r\nb", "a\n\nb"), ("a\n\n\n\n\nb", "a\n\nb"), ("a\n \t \nb", "a\n\nb"), ("\n\n a \n\n", "a"), ("a\n\nb\n", "a\n\nb"),
    (" Form  1040\r\n\r\n  Tax\tYear 2025  \n", "Form 1040\n\nTax Year 2025"), ("\u2003a\u2003", "a"), ("a\u2003b", "a b"), ("a\u00a0\u00a0b", "a b"), ("\u3000a\u3000b", "a b"),
    ("x\u2028y", "x\u2028y"), ("\u2028x\u2028", "x"), ("x\x1cy", "x\x1cy"), ("\x1cx\x1f", "x"), ("x\x85\ny", "x\ny"), ("x\x85y", "x\x85y"), ("\u1680x", "x"),
    ("\ufb01ne", "fine"), ("\uff21\uff22", "AB"), ("\u2460", "1"), ("e\u0301", "\u00e9"), ("\u00bd", "1\u20442"), ("\u2126", "\u03a9"), ("a\u200bb", "a\u200bb"), ("a \n\n\x1c\n\nb", "a\n\nb"),
]


def test_documents_by_hand(spark):
    got = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(DOCUMENTS)], "i int, t string").select("i", text.normalize_document(F.col("t")).alias("out")).collect()
    assert {r["i"]: r["out"] for r in got} == {i: out for i, (_, out) in enumerate(DOCUMENTS)}


def test_documents_hold_what_is_promised(spark):
    """Whatever goes in: normalising twice changes nothing, and no line has blanks at its ends."""
    rng = random.Random(11)
    pieces = ["a", "b c", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\r", "\v", "\f", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "\0", "\ufb01", "\uff21", "\u2460"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 14))) for _ in range(600)]
    once = text.normalize_document(F.col("t"))
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", once.alias("out"), text.normalize_document(once).alias("again")).collect():
        assert r["again"] == r["out"], repr(r["t"])
        lines = r["out"].split("\n")
        assert all(x == x.strip() for x in lines) and "\0" not in r["out"] and "\r" not in r["out"] and "\n\n\n" not in r["out"]
        assert (lines[0] and lines[-1]) or not r["out"]
        assert [c for c in r["out"] if c.isalnum()] == [c for c in unicodedata.normalize("NFKC", r["t"]) if c.isalnum()]


def test_document_text_against_built_in_rules(spark):
    rng = random.Random(11)
    pieces = ["a", "b1", "é", "ﬁ", "  ", " ", "\t", "\f\v", "\n", "\n\n", "\r", "\r\n", "\0", "\x1c", "\x85", "\xa0", "\u1680", "\u200b", "\u2003", "\u2028", "\u3000"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(0, 16))) for _ in range(1500)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.normalize_lines(text.nfkc(F.col("t"))).alias("want"), text.normalize_document(F.col("t")).alias("got")).collect()
    assert [r for r in rows if r["got"] != r["want"] or text.document_text(r["t"] or "") != r["want"]] == []


def test_chunks_leave_in_bounded_parts(spark, monkeypatch):
    """Rows with several chunks, none, nulls and equal ids, with a flush after nearly each text."""
    monkeypatch.setattr(text, "CHUNKS_HELD", 700)
    texts = ["one", None, " \n ", "x " * 900, "two\r\n\r\n\r\n  deux", "", "y" * 1300, "one", " "]
    pages = spark.createDataFrame([("S" if i % 2 else None, i // 2, t) for i, t in enumerate(texts)], "source_id string, page int, text string").coalesce(1)
    want = [("S" if i % 2 else None, i // 2, k, part) for i, t in enumerate(texts) for k, part in enumerate(text.chunk_text(text.document_text(t or ""), 512), 1)]
    assert [tuple(r) for r in text.chunk_rows(pages, 512).collect()] == want and len(want) > 8


def test_records_are_made_once(spark):
    """Where a validation record is found first, no second branch of the plan makes all records for the choice of one."""
    pages = spark.createDataFrame([("S", i, f"text {i}") for i in range(200)], "source_id string, page int, text string")
    records = corpus.records_of(pages)
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1 and "Join" not in plan
    assert {r["split"] for r in records.collect()} == {"train", "validation"}


def test_cutting_a_long_line_is_linear():
    began = time.time()
    pieces = text.chunk_text("seven77 " * 6_000_000, 512)
    assert time.time() - began < 30 and max(map(len, pieces)) <= 512 and sum(p.count("seven77") for p in pieces) == 6_000_000


def test_hard_cuts_against_rules():
    """Pieces joined give the paragraph but for blanks; all fit; none could have taken its next word."""
    rng = random.Random(3)
    for _ in range(300):
        words = ["x" * rng.choice([1, 2, 5, 9, 700]) for _ in range(rng.randrange(1, 400))]
        paragraph = " ".join(words)
        pieces = text.chunk_text(paragraph, 512)
        assert "".join(pieces).replace(" ", "") == "".join(words) and all(p and len(p) <= 512 and p == p.strip() for p in pieces)
        for p, q in zip(pieces, pieces[1:]):
            assert len(p) == 512 or len(p) + 1 + len(q.split(" ")[0]) > 511


def test_spans_lie_within_their_row(spark):
    rows = [(1, "ab xy. cd"), (1, "zw"), (None, "ab é $5,000 x"), (None, "cd! - ?! e"), (2, None), (3, "")]
    got = text.token_spans(spark.createDataFrame(rows, "doc_id long, text string"), row="row").collect()
    by_row = {}
    for r in got:
        by_row.setdefault((r["row"], r["doc_id"]), []).append((r["ord"], r["surface"], r["start_char"], r["end_char"], r["run"]))
    want = [(1, [(0, "ab", 0, 2, 0), (1, "xy", 3, 5, 0), (2, "cd", 7, 9, 1)]), (1, [(0, "zw", 0, 2, 0)])]
    assert sorted((d, sorted(v)) for (_, d), v in by_row.items() if d is not None) == sorted(want)
    nulls = sorted(sorted(v) for (_, d), v in by_row.items() if d is None)
    assert [[s[1] for s in v] for v in nulls] == [["ab", "$5,000", "x"], ["cd", "e"]] and nulls[1][1] == (1, "e", 9, 10, 2)


@pytest.mark.parametrize(
    ("op", "left", "right", "want"),
    [
        ("EQ", "1.0000001", "1", False), ("GT", "1.0000001", "1", True), ("EQ", "1.50", "1.5", True), ("EQ", "007", "7", True), ("LT", "-2", "-1.5", True), ("LT", "-0.5", "0", True), ("EQ", "-0", "0", True), ("GT", ".5", "0.25", True),
        ("EQ", "12345678901234567890123456789", "12345678901234567890123456789.0", True), ("GT", "12345678901234567890123456789.1", "12345678901234567890123456789", True), ("EQ", "1e3", "1000", True), ("LT", "10", "9a", True), ("GT", "b", "a", True), ("EQ", "5.", "5", True),
    ],
)
def test_numbers_compare_exactly(spark, op, left, right, want):
    row = spark.createDataFrame([(op, left, right)], "op string, a string, b string").select(rules.compare(F.col("op"), F.col("a"), F.col("b")).alias("x")).first()
    assert row["x"] is want


def test_numbers_against_decimals(spark):
    """Any exponent and any number of digits, against exact decimals."""
    rng = random.Random(5)

    def number():
        digits = lambda n: "".join(rng.choices("0123456789", k=n))
        body = rng.choice([digits(rng.randrange(1, 45)), f"{digits(rng.randrange(1, 5))}.{digits(rng.randrange(0, 45))}", f".{digits(rng.randrange(1, 42))}", "0" * rng.randrange(1, 4), "0.000"])
        exponent = rng.choice(["", "", f"e{rng.randrange(-60, 60)}", f"E+{rng.randrange(400)}", f"e-{rng.randrange(400)}"])
        return rng.choice(["", "-", "+"]) + body + exponent

    def same(x):
        """Another spelling of the number."""
        d = Decimal(x)
        return rng.choice([x, f"{d:f}", f"{d:e}", f" {x} "])

    pairs = [(x, rng.choice([number(), number(), same(x)])) for x in (number() for _ in range(1500))]
    pairs += [("1e39", "2"), ("1e-400", "0"), ("-1e-400", "0"), ("1e400", "1e399"), ("0e500", "0"), ("-0", "0e-9"), ("1" + "0" * 60, "1e60"), ("0." + "0" * 50 + "1", "1e-51")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = frame.select("a", "b", *[rules.compare(F.lit(o), F.col("a"), F.col("b")).alias(o) for o in ("EQ", "LT", "GTE")]).collect()
    for r in got:
        a, b = Decimal(r["a"].strip()), Decimal(r["b"].strip())
        assert (r["EQ"], r["LT"], r["GTE"]) == (a == b, a < b, a >= b), (r["a"], r["b"])


def test_activation_against_brute_force(spark):
    """Rules with and without conditions, MISSING, EXISTS and comparisons, over every state of three concepts."""
    import itertools

    kinds = [("c1", "EQ", "1"), ("c1", "MISSING", None), ("c2", "EXISTS", None), ("c2", "GT", "5"), ("c3", "MISSING", None), ("c3", "NE", "x")]
    rule_rows = [(f"R{n}", "verified", [], [{"concept_id": c, "operator": o, "value": v, "value_ref": None} for c, o, v in chosen], []) for n, chosen in enumerate([(), *[(k,) for k in kinds], *itertools.combinations(kinds, 2), *itertools.combinations(kinds, 3)])]
    schema = "rule_id string, status string, tax_years array<int>, conditions array<struct<concept_id:string,operator:string,value:string,value_ref:string>>, effects array<struct<effect_type:string,target:string>>"
    states = list(itertools.product([None, "1", "2"], [None, "3", "9"], [None, "x", "y"]))
    facts = [(f"S{n}", c, "present", v, k) for n, s in enumerate(states) for k, (c, v) in enumerate(zip(("c1", "c2", "c3"), s, strict=True)) if v is not None]
    scenarios = spark.createDataFrame([(f"S{n}",) for n in range(len(states))], "scenario_id string")
    got = {tuple(r) for r in rules.activated(scenarios, spark.createDataFrame(rule_rows, schema), spark.createDataFrame(facts, "scenario_id string, concept_id string, state string, value string, ord int")).select("scenario_id", "rule_id").collect()}

    def holds(state, c):
        value = state[int(c["concept_id"][1]) - 1]
        if c["operator"] in ("MISSING", "EXISTS"):
            return (value is None) == (c["operator"] == "MISSING")
        return value is not None and {"EQ": value == c["value"], "NE": value != c["value"], "GT": value > (c["value"] or "")}[c["operator"]]

    assert got == {(f"S{n}", r[0]) for n, s in enumerate(states) for r in rule_rows if all(holds(s, c) for c in r[3])}


def test_null_sequences_are_accepted(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3]), (2, [1]), (3, None)], "i int, input_ids array<int>")
    accepted, rejected = sequences.without_overflow(rows, 2)
    assert sorted(r["i"] for r in accepted.collect()) == [2, 3] and [r["i"] for r in rejected.collect()] == [1]


def test_repeated_spans_stay(spark):
    spans = spark.createDataFrame([(1, 0, 4, 7), (1, 0, 4, 7)], "doc_id long, start_char int, end_char int, feature_id int")
    tokens = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 4)], "doc_id long, token_index int, token_start int, token_end int")
    assert [r["token_index"] for r in alignment.align_right_edge(spans, tokens).collect()] == [1, 1]
