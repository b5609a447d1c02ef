"""Quality classification by a generalised additive model with pairwise terms.

Features are statistics of the whole text (counts of byte classes, word and
line repetition, entropy). Each feature is cut into quantile bins. Cyclic
boosting visits the features in turn, round after round; each visit fits one
shallow tree (two levels of splits) to the current gradients over the
feature's bins and adds it to the feature's lookup table. Then the pairs that
reduce the loss most get lookup tables over two coarse features, boosted in
the same way. A score is the sum of looked-up values through the logistic
function: vectorised additions, no trees at scoring time.

The model is fitted on the driver from a bounded sample of labelled rows
(``TRAIN_ROWS``, a parameter); every document is then scored in one pass.

Defined results: null and empty texts have all-zero features and get a score
like any other text. Without labelled rows every score is 0.5; with labels of
one kind only, every score is that kind's smoothed share. Labels, lang, source
and doc_id are never inputs of a score. Rows that repeat are scored each; an
empty table gives an empty result. Other columns pass through unread.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lumenfold.llm import labelled
from lumenfold.llm.common import fold_is, shingle_hashes, text_bytes, trim, word_hashes

TRAIN_ROWS = 12_000
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "shout_share", "bar_share", "mark_share", "comma_share", "stop_share",
    "line_share", "distinct_words", "top_word_share", "same_word_next", "shingle_repeats", "line_repeats", "other_bytes", "byte_entropy", "upper_words", "marked_words",
)

_UPPER, _LOWER, _DIGIT = (np.arange(a, b + 1) for a, b in ((65, 90), (97, 122), (48, 57)))
_SYMBOL = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8)
_MARK = np.frombuffer(b"#$%&*", np.uint8)


def text_features(text: bytes | None) -> list[float]:
    """The values of FEATURES for a whole text."""
    words = (text or b"").split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, n_words = len(text), len(words)
    letters = counts[_UPPER].sum() + counts[_LOWER].sum() + 1
    visible = n - int(counts[32] + counts[9:14].sum())
    share = counts[counts > 0] / n
    hashes = word_hashes(words)
    kinds, kind_counts = np.unique(hashes, return_counts=True)
    shingles = shingle_hashes(hashes)
    lines = [x for x in text.split(b"\n") if x]
    upper = sum(map(bytes.isupper, words))
    ends = sum(w[-1] in b"!#$%&*|" for w in words)
    return [
        float(np.log1p(n_words)), visible / n_words, counts[_UPPER].sum() / letters, counts[_DIGIT].sum() / n, counts[_SYMBOL].sum() / n, counts[33] / n_words, counts[124] / n_words, counts[_MARK].sum() / n_words,
        counts[44] / n_words, counts[46] / n_words, counts[10] / n_words, len(kinds) / n_words, kind_counts.max() / n_words, float((hashes[1:] == hashes[:-1]).mean()) if n_words > 1 else 0.0,
        1 - len(np.unique(shingles)) / len(shingles), 1 - len(set(lines)) / max(1, len(lines)), counts[128:].sum() / n, float(-(share * np.log2(share)).sum()), upper / n_words, ends / n_words,
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def features_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: text_features(None if t is None else t.encode()))


def _depth_two(g: np.ndarray, h: np.ndarray, leaf: float) -> np.ndarray:
    """Values per bin of a tree with at most four leaves, from gradient and curvature sums per bin."""

    def split(lo: int, hi: int) -> int:
        if hi - lo < 2:
            return lo
        gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        gr, hr = g[lo:hi].sum() - gl, h[lo:hi].sum() - hl
        gain = gl**2 / (hl + leaf) + gr**2 / (hr + leaf)
        best = int(gain.argmax())
        return lo + best + 1 if gain[best] > (gl[-1] + g[hi - 1]) ** 2 / (h[lo:hi].sum() + leaf) + 1e-9 else lo

    out, mid = np.zeros(len(g)), split(0, len(g))
    for lo, hi in ((0, mid), (mid, len(g))):
        cut = split(lo, hi) if hi > lo else lo
        for a, b in ((lo, cut), (cut, hi)):
            if b > a:
                out[a:b] = -g[a:b].sum() / (h[a:b].sum() + leaf)
    return out


def _best_gain(g: np.ndarray, h: np.ndarray, leaf: float) -> float:
    """What the best single split of these bins gains over nothing."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    return float((gl**2 / (hl + leaf) + (g.sum() - gl) ** 2 / (h.sum() - hl + leaf)).max())


@dataclass
class Gam:
    """Bin edges and lookup tables; ``score`` adds them up."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            logit += table[np.searchsorted(edges, x[:, j], "right")]
        for i, j, table in self.pairs:
            logit += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 50, pair_rounds: int = 20, n_pairs: int = 6, rate: float = 0.2, leaf: float = 2.0) -> Gam:
    """Cyclic boosting of main effects, then of the strongest pairs."""
    if len(y) == 0:
        return Gam(0.0)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    cut = lambda v, k: np.unique(np.quantile(v, np.arange(1, k) / k))
    d = x.shape[1]
    model.edges, model.coarse = [cut(x[:, j], bins) for j in range(d)], [cut(x[:, j], coarse_bins) for j in range(d)]
    at = [np.searchsorted(model.edges[j], x[:, j], "right") for j in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    logit = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            step = rate * _depth_two(np.bincount(at[j], g, len(model.tables[j])), np.bincount(at[j], h, len(model.tables[j])), leaf)
            model.tables[j] += step
            logit += step[at[j]]
    rough = [np.searchsorted(model.coarse[j], x[:, j], "right") for j in range(d)]
    wide = [len(c) + 1 for c in model.coarse]
    g, h = slopes()

    def cell_sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(rough[i] * wide[j] + rough[j], v, wide[i] * wide[j]).reshape(wide[i], wide[j])

    gains = sorted(((cell_sums(i, j, g) ** 2 / (cell_sums(i, j, h) + leaf)).sum(), i, j) for i in range(d) for j in range(i + 1, d) if wide[i] > 1 and wide[j] > 1)
    model.pairs = [(i, j, np.zeros((wide[i], wide[j]))) for _, i, j in gains[-n_pairs:]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = slopes()
            gs, hs = cell_sums(i, j, g), cell_sums(i, j, h)
            # A split of the first feature and, on each side, of the second: chosen together,
            # since an interaction shows in neither feature alone.
            step = np.zeros_like(table)
            if wide[i] > 1:
                mid = max(range(1, wide[i]), key=lambda m: _best_gain(gs[:m].sum(0), hs[:m].sum(0), leaf) + _best_gain(gs[m:].sum(0), hs[m:].sum(0), leaf))
                for rows in (slice(0, mid), slice(mid, None)):
                    step[rows] = rate * _depth_two(gs[rows].sum(0), hs[rows].sum(0), leaf)
            table += step
            logit += step[rough[i], rough[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality", limit: int = TRAIN_ROWS) -> Gam:
    """Fit the model on at most ``limit`` labelled documents for which ``use`` holds."""
    rows = labelled.sample(docs, labels, label, use, limit).select("label", features_of("text").alias("x")).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    order = np.lexsort([*x.T, rows["label"].to_numpy()])  # rows arrive in any order; sums of floats depend on it
    return fit_gam(x[order], rows["label"].to_numpy(float)[order])


def scorer(docs: DataFrame, model: Gam):
    """A column function: text column -> score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        found = [text_features(t) for t in text_bytes(texts)]
        trim()
        return pa.array(held.value.score(np.array(found, float).reshape(len(found), len(FEATURES))), pa.float64())

    return lambda text: score(F.col(text).cast("string"))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, ~fold_is("doc_id", 5, 0))
    scored = docs.select("doc_id", fold_is("doc_id", 5, 0).alias("held_out"), scorer(docs, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the classifier accepts; columns unchanged."""
    model = train(docs, labels, ~fold_is("doc_id", 5, 0))
    return docs.where(scorer(docs, model)("text") >= THRESHOLD)
