from __future__ import annotations

import numpy as np

from lumenfold.llm import common

from .conftest import prose


def test_shingles_follow_the_words():
    value = ("A b\tC\nd  E f\x0bG " + prose(1, 400) + " É ß").encode()
    words = common.words_of(value)
    assert words[:7] == [b"a", b"b", b"c", b"d", b"e", b"f", b"g"] and words[-2:] == ["É".encode(), "ß".encode()]
    hashes = common.shingle_hashes(common.word_hashes(words))
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    assert len(set(grams)) == len(common.shingle_set(value)) and len(hashes) == len(grams)
    by_gram = dict(zip(grams, hashes.tolist(), strict=True))
    assert len(set(by_gram.values())) == len(by_gram)
    assert len(common.shingle_set(b"x y")) == 1 and len(common.shingle_set(b"")) == len(common.shingle_set(None)) == len(common.shingle_set(b" \n")) == 0
    assert common.shingle_set(b"x y").tolist() != common.shingle_set(b"x y z").tolist()


def test_mix64_is_a_bijection_on_samples():
    x = np.random.default_rng(1).integers(0, 2**63, 50_000).astype(np.uint64)
    assert len(np.unique(common.mix64(x))) == len(np.unique(x))


def test_stash_and_clear(spark):
    held = common.stash(spark.range(5), "probe")
    assert held.count() == 5 and common.broadcast_if_small(held, 3).count() == 5
    assert common.fresh(held, "ID") == "ID_" and common.fresh(held, "x") == "x"
