"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent letter n-grams (one to three
letters, word edges marked), most frequent first. A document's own list is
compared to every language's: each of its n-grams adds the distance between
its two ranks, or ``PROFILE`` if the language lacks it (the out-of-place
measure). The nearest language wins.

Language profiles are counted over a sample of labelled documents: at most
about ``TRAIN_DOCS`` per language (a parameter), drawn by a hash of the id
against the language's own count, so rare languages keep all of theirs. Every
language that occurs is learned; more than ``MOST_LANGS`` values of the column
are an error, as then it doesn't hold languages. Profiles are kept as the list
of languages and ranks of each n-gram, which grows with the languages alone.
Every whole text is then compared in one pass.

Defined results: ``und`` with score 0 for a null text, a text without letters,
or when nothing was learned. Ties go to the first language by code point. Rows
that repeat get a prediction each; an empty table gives an empty result; extra
columns are left out. lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import fold_is

PROFILE = 300
TRAIN_DOCS = 1500
#: Languages that may occur; bounds what the driver collects and broadcasts (2.4 kB each).
MOST_LANGS = 100_000
_EDGE, _STEP = 1, 21


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(grams, counts) of a whole text, grams ascending; a gram packs its code points, 21 bits each."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    marks = np.concatenate([[_EDGE], np.where(letter, points, _EDGE), [_EDGE]]).astype(np.int64)
    marks = marks[np.concatenate([[True], (marks[1:] != _EDGE) | (marks[:-1] != _EDGE)])]
    present = np.flatnonzero(np.bincount(marks, minlength=2))
    k = len(present)
    dense = np.searchsorted(present, marks)
    found = []
    one, two, three = dense, dense[:-1] * k + dense[1:], (dense[:-2] * k + dense[1:-1]) * k + dense[2:]
    for order, codes in ((1, one), (2, two), (3, three)):
        if order == 3:
            codes = codes[dense[1:-1] > 0]  # a word edge is never the middle
        if k**order <= max(4096, 16 * len(codes)):
            counts = np.bincount(codes, minlength=1)
            codes = np.flatnonzero(counts)
            counts = counts[codes]
        else:
            codes, counts = np.unique(codes, return_counts=True)
        parts = [codes // k**i % k for i in range(order)]
        packed = sum(present[p] << (_STEP * i) for i, p in enumerate(parts))
        keep = packed != _EDGE if order == 1 else np.ones(len(codes), bool)
        found.append((packed[keep], counts[keep]))
    return np.concatenate([g for g, _ in found]), np.concatenate([c for _, c in found])


def ranked(grams: np.ndarray, counts: np.ndarray, top: int = PROFILE) -> np.ndarray:
    """The most frequent grams, ties by gram."""
    return grams[np.lexsort((grams, -counts))[:top]]


@dataclass
class Profiles:
    """langs in code point order; grams sorted; of each gram the languages that have it and its rank there, from ``starts`` on."""

    langs: list[str]
    grams: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, lists: dict[str, np.ndarray]) -> Profiles:
        langs = sorted(lists)
        every = np.concatenate([*(lists[x] for x in langs), np.empty(0, np.int64)])
        owners = np.repeat(np.arange(len(langs)), [len(lists[x]) for x in langs])
        ranks = np.concatenate([*(np.arange(len(lists[x])) for x in langs), np.empty(0, np.int64)])
        order = np.argsort(every, kind="stable")
        grams, starts = np.unique(every[order], return_index=True)
        return cls(langs, grams, np.append(starts, len(every)), owners[order].astype(np.int32), ranks[order].astype(np.int32))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ranked(*gram_counts(text)) if text else np.empty(0, np.int64)
        if not len(grams) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        own = np.flatnonzero(self.grams[at] == grams)
        first, many = self.starts[at[own]], self.starts[at[own] + 1] - self.starts[at[own]]
        # The entries of all known grams, one after the other; what a language lacks counts PROFILE, what it has that much less.
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        nearer = PROFILE - np.abs(self.ranks[entry] - np.repeat(own, many))
        distance = PROFILE * len(grams) - np.bincount(self.owners[entry], nearer, len(self.langs))
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (PROFILE * len(grams))


def _count_batch(batches):
    """Gram counts per language of a partition: rows (lang, gram, n)."""
    totals: dict[str, dict[int, int]] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = totals.setdefault(lang, {})
            for g, n in zip(*(x.tolist() for x in gram_counts(text or "")), strict=True):
                own[g] = own.get(g, 0) + n
    rows = [(lang, g, n) for lang, own in totals.items() for g, n in own.items()]
    for at in range(0, len(rows), 50_000):
        lang, gram, n = zip(*rows[at : at + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def train(docs: DataFrame, use: Column, limit: int = TRAIN_DOCS, most: int = MOST_LANGS) -> Profiles:
    """Profiles of all languages of the documents for which ``use`` holds; more than ``most`` raise an error."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & use).select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    if sizes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} languages: lang holds something else")
    shares = sizes.select("lang", F.least(F.lit(1.0), limit / F.col("n")).alias("share"))
    drawn = known.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    counts = drawn.select("lang", F.col("text").cast("string")).mapInArrow(_count_batch, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    lists: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "gram", "rank").collect():  # PROFILE rows for each of at most ``most`` languages
        lists.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return Profiles.of({lang: np.array([g for _, g in sorted(v)], np.int64) for lang, v in lists.items()})


def predictor(docs: DataFrame, profiles: Profiles):
    """A column function: text column -> struct(lang_pred, score)."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        found = [held.value.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["lang_pred", "score"])

    return lambda text: predict(F.col(text).cast("string"))


def identify_languages(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    profiles = train(docs, ~fold_is("doc_id", 4, 2))
    out = docs.select("doc_id", fold_is("doc_id", 4, 2).alias("held_out"), predictor(docs, profiles)("text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


