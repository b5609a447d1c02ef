from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import language, quality, toxicity
from lumenfold.llm.common import fold_is

from .conftest import DOCS, prose

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows, labels = random.Random(4), [], []
    for i in range(600):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(20, 90))]
        if bad:
            words = [w.upper() + "!!" for w in words[:10]] * 5
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "zorblish", "zorblunk", "zorblam", "moron"]))
        text = " ".join(words) + "."
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize(("score", "label"), [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_held_out_accuracy(corpus, score, label):
    docs, labels = corpus
    got = score(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 80 and (held.predicted == held[label]).mean() > 0.97
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_odd_rows_and_labels(spark, clashing, corpus, empty, score):
    docs, labels = corpus
    odd_labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 0, 0), (3, 1, 1), (99999, 1, 0)], LABELS))
    got = score(clashing, odd_labels).collect()
    assert len(got) == clashing.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] is not None for r in got)
    assert score(empty, labels).count() == 0
    none = score(docs, labels.where(F.lit(False))).agg(F.count_distinct("score").alias("n"), F.min("score").alias("low")).first()
    assert none["n"] >= 1 and none["low"] is not None


def test_labels_of_held_out_rows_do_not_matter(corpus):
    docs, labels = corpus
    turned = labels.withColumn("quality", F.when(fold_is("doc_id", 5, 0), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(fold_is("doc_id", 4, 2), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for score in (quality.score_quality, toxicity.score_toxicity):
        a, b = ({r["doc_id"]: r["score"] for r in score(docs, l).collect()} for l in (labels, turned))
        assert a == b


def test_keep_good_keeps_columns(corpus, clashing):
    docs, labels = corpus
    assert quality.keep_good(clashing, labels).columns == clashing.columns
    kept = quality.keep_good(docs, labels).join(labels, "doc_id").groupBy("quality").count().collect()
    assert {r[0]: r[1] for r in kept}.get(0, 0) <= 2


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_gam(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    assert {(i, j) for i, j, _ in model.pairs} >= {(0, 1)}
    assert quality.fit_gam(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (quality.fit_gam(x, np.ones(4000)).score(x) > 0.99).all()


def test_features_of_odd_texts():
    for t in (None, b"", b" ", b"a", b"\xff\xfe", "é|!".encode() * 9):
        assert len(quality.text_features(t)) == len(quality.FEATURES) and np.isfinite(quality.text_features(t)).all()


def test_grammar_contexts():
    model = toxicity.Model()
    keys = model.automaton()
    context = lambda t: [c[1] for c in model.clauses(t, keys)]
    assert context("what an idiot. fine day") == ["plain"]
    assert context("you are an idiot") == ["targeted"]
    assert context("idiot you are") == ["targeted"]
    assert context("he is not stupid") == ["negated"]
    assert context("she said he was a moron") == ["reported"]
    for reported in ("he said: you are an idiot", '"You are an idiot", he said.', '"You are an idiot!" he said', "“You are an idiot”, she says.", "You are an idiot, she says"):
        assert context(reported) == ["reported"], reported
    for threat in ("they killed him", "I am killing you", "i will hurt you. no harm", "you will be shot"):
        assert context(threat) == ["threat"], threat
    assert context("you idiot. he said hello") == ["targeted"] and context("the killing of time") == []
    assert context('he said "fine", and left. you moron') == ["targeted"]
    odd = "İİİ. You IDIOT! rest"
    assert [c[0] for c in model.clauses(odd, keys)] == ["You IDIOT"]
    assert context("kill the process") == [] and context("idiotic? worthlessness") == []
    scores = {t: float(model.score(np.array([model.features(t, keys)]))[0]) for t in ("you idiot", "not an idiot", "they said idiot", "good day")}
    assert scores["you idiot"] > 0.6 > scores["not an idiot"] > scores["good day"] and scores["they said idiot"] < 0.6


def test_composed_tables_equal_the_chain_of_transducers():
    """The compiled passes against running the five transducers one after another, over all short and many long readings."""
    import itertools

    chain = [(toxicity.target_after(), True), (toxicity.report_after(), True), (toxicity.negation(), False), (toxicity.report_before(), False), (toxicity.target_before(), False)]
    rng = random.Random(8)
    readings = [list(r) for n in range(4) for r in itertools.product(range(11), repeat=n)] + [[rng.randrange(11) for _ in range(rng.randrange(4, 30))] for _ in range(500)]
    for symbols in readings:
        want, weights = list(symbols), [0.0] * len(symbols)
        for machine, backwards in chain:
            state = machine.start
            for i in range(len(want) - 1, -1, -1) if backwards else range(len(want)):
                state, want[i], w = machine.step(state, want[i])
                weights[i] += w
        assert toxicity._GRAMMAR.read(symbols) == list(zip(want, weights, strict=True)), symbols


def test_scores_of_very_long_texts_take_linear_time():
    import time

    model = toxicity.Model()
    keys = model.automaton()
    seconds = []
    for n in (20_000, 160_000):
        began = time.process_time()
        for text in ("you idiot and more words " * n, "word idiot. " * n):
            model.features(text, keys)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 20 * seconds[0]


def test_brute_force_scores(corpus):
    """Scores of the query against scores made from matched clauses alone, by plain arithmetic."""
    import math

    docs, labels = corpus
    model = toxicity.train(docs, labels, ~fold_is("doc_id", 4, 2))
    keys = model.automaton()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score_toxicity(docs, labels).collect():
        strong, weak, dense = dict.fromkeys(toxicity.CONTEXTS, 0.0), 0.0, 0
        for _, context, weight, hits in model.clauses(texts[r["doc_id"]], keys):
            if weight >= toxicity.STRONG:
                strong[context] += weight
            else:
                weak, dense = weak + weight, dense + hits
        x = [*(min(strong[c], 3.0) for c in toxicity.CONTEXTS), min(weak, 4.0), min(dense * 100 / (len(texts[r["doc_id"]].split()) + 5), 8.0)]
        z = model.base + sum(a * b for a, b in zip(model.weights, x, strict=True))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9 and r["predicted"] == (r["score"] >= 0.3)


def test_sample_bound_holds_for_repeated_ids(spark):
    from lumenfold.llm import labelled

    docs = spark.createDataFrame([(i % 10, f"t{i}") for i in range(500)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 20, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = labelled.sample(docs, labels, "toxic", F.lit(True), 8).collect()
    assert len(got) <= 8 and len({r["doc_id"] for r in got}) == len(got)


def test_stems_are_learned_and_chance_words_are_not(corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels, ~fold_is("doc_id", 4, 2))
    assert any(s.startswith("zorbl") for s in model.stems) and not any(w.startswith("w") and w[1:].isdigit() for w in (*model.stems, *model.words))
    clauses = toxicity.matched_clauses(docs, model).select("doc_id").distinct().join(labels, "doc_id").groupBy("toxic").count().collect()
    assert {r[0] for r in clauses} == {1}


def test_language(spark, clashing, empty):
    alphabets = {"aa": "abcdei", "bb": "mnopxe", "cc": "éüöaei"}
    rng, rows = random.Random(2), []
    for i in range(300):
        lang = rng.choice(list(alphabets))
        rows.append((i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(40)), lang, "s", 1))
    docs = spark.createDataFrame(rows, DOCS)
    got = language.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).all() and got.score.between(0, 1).all()
    odd = {r["doc_id"]: r for r in language.identify_languages(clashing).collect()}
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[2]["lang_pred"] == "und"
    assert odd[3]["lang_pred"] != "und"
    assert language.identify_languages(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_gram_counts_equal_counting():
    from collections import Counter

    for text in ("Ab, ba ab!", prose(3, 300), "日本 é ß", "x" * 50):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        want: Counter = Counter()
        line = " " + " ".join(words) + " "
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                g = line[i : i + n]
                if g.strip() and not (n == 3 and g[1] == " "):
                    want[g] += 1
        grams, counts = language.gram_counts(text)
        unpack = lambda g: "".join(" " if p == 1 else chr(p) for p in (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF) if p)
        assert {unpack(g): c for g, c in zip(grams.tolist(), counts.tolist(), strict=True)} == dict(want)


def test_language_equals_plain_distances(spark):
    """Predictions against rank lists and out-of-place distances in plain Python."""
    from collections import Counter

    rng, rows = random.Random(5), []
    for i in range(120):
        letters = ("abcdeixyz", "abmnopxez", "éüöabceix")[i % 3]
        rows.append((i, " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 60))), f"l{i % 3}", "s", 1))
    rows += [(200, "q" * 3000, "l1", "s", 1), (201, "", "l1", "s", 1), (202, "12 3!", "l2", "s", 1), (203, "abc", None, "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)

    def profile(counts):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: language.PROFILE]]

    def counts(text):
        return Counter(dict(zip(*(x.tolist() for x in language.gram_counts(text)), strict=True)))

    total: dict = {}
    for i, text, lang, *_ in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            total.setdefault(lang, Counter()).update(counts(text))
    ranks = {lang: {g: k for k, g in enumerate(profile(c))} for lang, c in total.items()}
    texts = {r[0]: r[1] for r in rows}
    for r in language.identify_languages(docs).collect():
        own = profile(counts(texts[r["doc_id"]]))
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        far = {lang: sum(abs(known[g] - k) if g in known else language.PROFILE for k, g in enumerate(own)) for lang, known in ranks.items()}
        best = min(sorted(far), key=far.get)
        assert r["lang_pred"] == best and abs(r["score"] - (1 - far[best] / (language.PROFILE * len(own)))) < 1e-12


def test_every_language_is_learned(spark):
    """Hundreds of values, one document each; beyond the stated number they are an error, none is left out."""
    rows = [(i, f"word{i} abc", f"x{i:03d}" if i % 2 else "en", "s", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    got = language.train(docs, F.lit(True))
    assert got.langs == sorted({r[2] for r in rows})
    with pytest.raises(ValueError, match="more than 300 languages"):
        language.train(docs, F.lit(True), most=300)
    assert len(language.train(docs, F.lit(True), most=301).langs) == 301


def test_rare_languages_are_found(spark):
    alphabets = ["abcdefgh", "ijklmnop", "qrstuvwx", "αβγδεζηθ", "бвгджзий"]
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choices(alphabets[i % 5], k=5)) for _ in range(30)), f"l{i % 5}", "s", 1) for i in range(300)]
    got = language.identify_languages(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id'] % 5}" for r in got)


def _plain_context(symbols, i):
    """The context of the hit at ``i``, by looking at its neighbours; for clauses without commas and quotation marks."""
    words = [k for k, x in enumerate(symbols) if x in toxicity.WORDS]
    at = words.index(i)
    near = lambda n, x: any(symbols[k] == x for k in words[max(0, at - n) : at])
    ahead = [symbols[k] for k in words[at + 1 : at + 1 + toxicity.REACH] if symbols[k] in (toxicity.TARGET, toxicity.OWNER)]
    before = any(x in (toxicity.TARGET, toxicity.OWNER) for x in symbols[:i])
    if toxicity.REPORT in symbols[:i]:
        return "reported"
    if near(toxicity.SCOPE, toxicity.NEGATION):
        return "negated"
    if symbols[i] == toxicity.THREAT:
        return "threat" if ahead[:1] == [toxicity.TARGET] or (before and near(2, toxicity.PASSIVE)) else None
    return "targeted" if ahead or before else "plain"


def test_contexts_against_looking_at_neighbours():
    rng = random.Random(12)
    letters = [toxicity.OTHER, toxicity.OTHER, toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.OWNER, toxicity.PASSIVE, toxicity.COLON]
    for _ in range(4000):
        symbols = [rng.choice(letters) for _ in range(rng.randrange(1, 14))]
        got = toxicity._GRAMMAR.contexts(symbols)
        for i, x in enumerate(symbols):
            assert got[i] == (_plain_context(symbols, i) if x in (toxicity.INSULT, toxicity.THREAT) else None), (symbols, i)


@pytest.mark.parametrize(
    ("text", "context"),
    [
        ("don\u2019t call him an idiot", "negated"), ("don't call him an idiot", "negated"), ("you\u2019re an idiot", "targeted"), ("you're an idiot", "targeted"), ("they'll see what an idiot", "targeted"), ("Idiots!", "plain"), ("what losers", "plain"),
        ("the people shoot a film", None), ("I will kill your bacteria", None), ("I will kill you", "threat"), ("people will be shot", "threat"), ("he got beaten", "threat"), ("she shot him", "threat"), ("your stupid face", "targeted"), ("you shoot a film", None),
        ("shoot them all", "threat"), ("the film was shot in his town", None), ("I couldn't kill you", "negated"),
    ],
)
def test_sentences(text, context):
    model = toxicity.Model()
    assert [c[1] for c in model.clauses(text, model.automaton())] == ([context] if context else [])


def test_no_pattern_is_left_out_for_want_of_room(spark):
    """Thousands of marks, each on a few toxic documents of its own: all are learned."""
    rows, labels = [], []
    for k in range(300):
        for j in range(13):
            i = k * 13 + j
            rows.append((i, f"w{j} zq{k:03d}xv is here", "en", "s", 1))
            labels.append((i, 0, 1))
    for i in range(4000, 9000):
        rows.append((i, f"w{i} is here and fine", "en", "s", 1))
        labels.append((i, 0, 0))
    model = toxicity.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    learned = (*model.stems, *model.words)
    assert all(any(f"zq{k:03d}xv".startswith(p) for p in learned) for k in range(300))


def test_quality_scores_by_plain_addition(corpus, odd):
    """The query's scores against a loop over lookup tables with bisection, one text at a time."""
    import math
    from bisect import bisect_right

    docs, labels = corpus
    model = quality.train(docs, labels, ~fold_is("doc_id", 5, 0))
    edges, tables, coarse = [e.tolist() for e in model.edges], [t.tolist() for t in model.tables], [e.tolist() for e in model.coarse]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.score_quality(docs, labels).collect():
        x = [float(v) for v in quality.text_features(None if texts[r["doc_id"]] is None else texts[r["doc_id"]].encode())]
        z = model.base
        for j, v in enumerate(x):
            z += tables[j][bisect_right(edges[j], v)]
        for i, j, table in model.pairs:
            z += table[bisect_right(coarse[i], x[i])][bisect_right(coarse[j], x[j])]
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9 and r["predicted"] == (r["score"] >= quality.THRESHOLD)
    assert quality.score_quality(docs.where("false"), labels).collect() == []
