"""N-gram features with aliases against a brute-force version."""

from __future__ import annotations

import re

from lumenfold.functions import hashing, text
from lumenfold.operators import token_features
from lumenfold.plans import corpus_plans

TEXTS = {
    1: "A well-known fine-tuned form 1099-B; the w-2 and a/b or a_b_a_c_d_e. Well known b $5 4.5% 1/2/2025",
    2: "plain words only, nothing joined",
    3: "pre-trained_model-v2/x pre-trained pre trained 1099b 1099-B supercalifragilistic-expialidocious_documentation-sets",
    4: "",
    5: None,
}


#: What each token of TEXTS stands for, by hand: its key and its aliases. Others are their lower-case selves and have none.
ATOMS = {
    "well-known": ("well-known", ["well", "known"]),
    "fine-tuned": ("fine-tuned", ["fine", "tuned"]),
    "1099-B": ("1099-b", ["1099b"]),
    "w-2": ("w-2", ["w2"]),
    "a/b": ("a/b", ["a", "b"]),
    "a_b_a_c_d_e": ("a_b_a_c_d_e", ["a", "b", "c", "d"]),
    "$5": ("<money>", []),
    "4.5%": ("<percent>", []),
    "1/2/2025": ("<date>", []),
    "pre-trained_model-v2/x": ("pre-trained_model-v2/x", ["pre-trained", "model-v2/x"]),
    "pre-trained": ("pre-trained", ["pre", "trained"]),
    "supercalifragilistic-expialidocious_documentation-sets": ("supercalifragilistic-expialidocious_documentation-sets", ["supercalifragilistic-expialidocious", "documentation-sets"]),
}


def _occurrences(value: str):
    """(token index, namespace, key, alias) of every occurrence."""
    found = list(re.finditer(text.TOKEN, value))
    atoms = [ATOMS.get(m.group(), (m.group().lower(), [])) for m in found]
    broken = [bool(re.search(text.BREAK, value[a.end() : b.start()])) for a, b in zip(found, found[1:])]
    for i, (m, (key, aliases)) in enumerate(zip(found, atoms, strict=True)):
        yield i, "word_1", key, False
        yield from ((i, "word_1", a, True) for a in aliases)
        for n in (2, 3, 4):
            if i + n <= len(atoms) and not any(broken[i : i + n - 1]):
                yield i + n - 1, f"word_{n}", " ".join(k for k, _ in atoms[i : i + n]), False
        shaped = len(key) >= 7 or re.search(r"[0-9]", key) or "-" in key or "/" in key
        if shaped and len(key) <= 64 and not key.startswith("<") and len(m.group()) == len(key):
            yield from ((i, f"char_{n}", key[p : p + n], False) for n in (3, 4, 5) for p in range(len(key) - n + 1))


def _documents(spark, tmp_path) -> str:
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_token_features_hold_aliases(spark, tmp_path):
    want = {}
    for doc_id, value in TEXTS.items():
        best: dict[int, set[int]] = {}
        for token, space, key, _ in _occurrences(value or ""):
            best.setdefault(token, set()).add(hashing.feature_id(space, key, b"ngram-v1")[0])
        sizes = [len(x) for x in best.values()]
        if sizes:
            want[doc_id] = (len(sizes), sum(min(n, 24) for n in sizes), sum(max(n - 24, 0) for n in sizes), sum(n > 24 for n in sizes))
    got = {r["doc_id"]: (r["tokens"], r["selected"], r["dropped"], r["hitting_cap"]) for r in corpus_plans.token_features(spark, _documents(spark, tmp_path)).collect()}
    assert got == want and any(hit for *_, hit in want.values())


def test_ngram_buckets_hold_aliases(spark, tmp_path):
    keys: dict[str, set[str]] = {}
    for value in TEXTS.values():
        for _, space, key, _ in _occurrences(value or ""):
            keys.setdefault(space, set()).add(key)
    want = {}
    for space, found in keys.items():
        buckets = [hashing.feature_id(space, k, b"ngram-v1")[1] for k in found]
        want[space] = (len(found), len(set(buckets)), max(map(buckets.count, buckets)))
    got = {r["namespace"]: (r["unique_keys"], r["occupied_buckets"], r["max_bucket_depth"]) for r in corpus_plans.ngram_buckets(spark, _documents(spark, tmp_path)).collect()}
    assert got == want


def test_features_are_ranked(spark):
    """Longer words first, then aliases, then longer character n-grams; smaller ids first among these."""
    number = lambda space, key: hashing.feature_id(space, key, b"ngram-v1")[0]
    docs = spark.createDataFrame([(7, "one two w-2. three"), (7, "w-2"), (None, "x"), (8, None), (9, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["row"], r["token_index"]), list(r["feature_ids"]), r["candidate_count"], r["dropped"]) for r in token_features.token_features(docs, most=5).collect())
    own = [number("word_1", "w-2"), number("word_1", "w2"), number("char_3", "w-2")]
    assert [g[1] for g in got] == [
        [number("word_1", "x")], [number("word_1", "one")], [number("word_2", "one two"), number("word_1", "two")], [number("word_3", "one two w-2"), number("word_2", "two w-2"), *own], [number("word_1", "three")], own,
    ]
    assert [g[2:] for g in got] == [(1, 0), (1, 0), (2, 0), (5, 0), (1, 0), (3, 0)]
    long = spark.createDataFrame([(1, "abcdefghijklmnop")], "doc_id long, text string")
    ids = token_features.token_features(long, most=8).first()
    key = "abcdefghijklmnop"
    grams = [x for n in (5, 4, 3) for x in sorted({number(f"char_{n}", key[i : i + n]) for i in range(len(key) - n + 1)})]
    assert list(ids["feature_ids"]) == [number("word_1", key), *grams][:8] and ids["candidate_count"] == len(set(grams)) + 1 and ids["dropped"] == len(set(grams)) - 7
    assert token_features.token_features(docs.where("false")).collect() == []


def test_bucket_statistics_over_many_runs(spark, monkeypatch):
    """Runs handed over early, repeated keys in many tasks and texts: as if all keys were in one set."""
    monkeypatch.setattr(token_features, "RUN_KEYS", 40)
    texts = [f"alpha beta {i % 7} gamma-{i % 5} delta; epsilon {i % 11}" for i in range(200)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    got = {r["namespace"]: r for r in token_features.bucket_statistics(docs).collect()}
    pairs = {" ".join(p) for t in texts if t for run in ([*t.split(";")[0].replace(t.split()[2], "<number>", 1).split()], [*t.split(";")[1].replace(t.split()[-1], "<number>").split()]) for p in zip(run, run[1:])}
    assert got["word_2"]["unique_keys"] == len(pairs)
    buckets = [hashing.feature_id("word_2", k, b"ngram-v1")[1] for k in pairs]
    assert got["word_2"]["occupied_buckets"] == len(set(buckets)) and got["word_2"]["max_bucket_depth"] == max(map(buckets.count, buckets))
    assert token_features.bucket_statistics(docs.where("false")).collect() == []
