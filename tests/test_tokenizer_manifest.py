"""Capabilities of tokenizers, what uses require of them, and their sealed manifest."""

from __future__ import annotations

import itertools

import pytest

from lumenfold.functions import tokenizer
from lumenfold.functions.tokenizer import CapabilityError, Requirements, capabilities, tokenizer_manifest
from lumenfold.operators import integrity


def coarse():
    """One token per line: the answer's token holds the end mark too."""
    return lambda text: ([len(x) for x in text.splitlines(True)], [(e - len(x), e) for x, e in zip(text.splitlines(True), itertools.accumulate(map(len, text.splitlines(True))), strict=True)])


def blind():
    return lambda text: (list(text.encode()), [])


def moody():
    turns = itertools.count()
    return lambda text: ([next(turns)], [(0, len(text))])


def broken():
    raise OSError("no such file")


def test_the_probe_says_where_the_answer_is():
    a, b = tokenizer._ANSWER
    assert tokenizer._CHAT[a:b] == "Hi é"


def test_capabilities():
    assert all(capabilities().values())
    assert capabilities(coarse) == {"offsets": True, "lossless": True, "deterministic": True, "assistant_mask": False}
    assert capabilities(blind) == {"offsets": False, "lossless": False, "deterministic": True, "assistant_mask": False}
    assert not capabilities(moody)["deterministic"] and not any(capabilities(broken).values())


def test_requirements():
    Requirements().check(capabilities())
    with pytest.raises(CapabilityError, match="assistant_mask$"):
        Requirements().check(capabilities(coarse))
    Requirements().for_plain_text().check(capabilities(coarse))
    with pytest.raises(CapabilityError, match="offsets"):
        Requirements().for_plain_text().check(capabilities(blind))
    assert Requirements(offsets=False).for_plain_text() == Requirements(False, False, True)


def test_manifest():
    made = tokenizer_manifest("words", "r1", vocabulary=1 << 16, special={"<|end|>": 2}, template="<|{role}|>")
    assert integrity.seal_holds(made) and made["template_sha256"] and made == tokenizer_manifest("words", "r1", vocabulary=1 << 16, special={"<|end|>": 2}, template="<|{role}|>")
    assert made["content_hash"] != tokenizer_manifest("words", "r2", vocabulary=1 << 16)["content_hash"] and tokenizer_manifest("words", "r1")["template_sha256"] is None
    assert made["probe_ids"] != tokenizer_manifest("words", "r1", lambda: tokenizer.word_tokenizer(97))["probe_ids"]
    with pytest.raises(ValueError, match="pinned"):
        tokenizer_manifest("words", "")
    with pytest.raises(CapabilityError):
        tokenizer_manifest("lines", "r1", coarse)
    assert tokenizer_manifest("lines", "r1", coarse, required=Requirements().for_plain_text())["capabilities"]["offsets"]
