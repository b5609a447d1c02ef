"""Toxicity by a weighted finite-state pattern grammar over clauses.

Transducers, composed left to right:

1. *Lexicon*: an Aho-Corasick automaton over the lower-cased text finds insults
   and threats. Insult patterns are word stems learned from labelled rows,
   beside a short fixed list; a stem matches at the start of a word. Threats
   are fixed verbs with their inflections.
2. *Clauses*: a text is cut at ``.!?;`` (unless a quotation mark follows) and
   line ends; clauses without insult or threat are passed over without further
   work. Words become the symbols insult, threat, target, owner ("your"),
   passive ("be"), negation, report and other; colons, commas and quotation marks are symbols as well.
3. *Grammar*: five transducers, each of which reads symbols and marks some of
   them. ``compose`` feeds one's output to the next and compiles the result
   into one table. From right to left: a target up to ``REACH`` words after an
   insult or threat binds to it (target), and a report after a quotation, or
   after a comma, covers what stands before (reported). From left to right: a
   negation holds for the next ``SCOPE`` words (negated), a report or a colon
   after it holds to the clause's end (reported), and a target binds to what
   follows it (target). Weights add along a path; an insult or threat is
   accepted under one context: plain, targeted, negated, reported or threat.

A document's score is a logistic model over the number of matched clauses per
context, each clause counting with its strongest pattern's weight; stems that
clean texts sometimes have by chance count apart, with their density. The
weights start from fixed values (negated and reported clauses count least) and
are fitted to the labels.

Lexicon and weights are learned from at most ``TRAIN_ROWS`` labelled documents
(a parameter); what that sample has is all learned from, without a cap on
patterns. Every whole text is scored. Labels, lang, source and doc_id are
never inputs of a score. Defined results: null or empty texts match nothing
and get the score of a text without matches. Without toxic labelled rows only
the fixed list and the fixed weights hold. Of rows that repeat an id the sample
takes one; rows that repeat are scored each. Time is linear in a text's length,
and clauses are cut from the text as it stands; apostrophes of all kinds are
one. An empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lumenfold.llm import labelled
from lumenfold.llm.common import broadcast_if_small, fold_is, stash

TRAIN_ROWS = 12_000
THRESHOLD = 0.3
SCOPE = 4
REACH = 3

# Small closed word lists of the grammar's classes.
INSULTS = "idiot moron stupid loser pathetic worthless disgusting scum trash clown".split()
THREATS = "kill hurt destroy beat shoot stab burn shot beaten".split()
TARGETS = "you yourself he she they them him her people everyone du dich ihr euch tu toi vous eres usted ustedes".split()
OWNERS = "your his their dein deine euer eure ton ta tes votre vos tu su sus".split()
PASSIVES = "be been being get gets got".split()
CONTRACTED = "re s ll ve d m".split()
NEGATIONS = "not never no isn't aren't wasn't don't nobody nicht kein keine ne pas jamais nunca".split()
REPORTS = "said says say told tells wrote called claimed quoted sagte schrieb nannte dit écrit dijo escribió".split()

CONTEXTS = ("plain", "targeted", "negated", "reported", "threat")
#: Features of a document: matched clauses per context, then the clauses and the density (per 100 words) of patterns weaker than STRONG.
START_WEIGHTS = (4.0, 4.5, 1.5, 1.5, 4.0, 0.2, 0.5)
START_BASE = -3.0
STRONG = 0.95
STEMS = range(4, 9)
#: A learned pattern must explain so many toxic documents that no stronger one does. The share of toxic documents among
#: those that have it must be at least MIN_SHARE with 97.5 % confidence (Wilson bound): 12 of 12 are enough, 11 of 11 are not.
MIN_DOCS, MIN_SHARE = 6, 0.75

_TOKEN = re.compile("[^\\W_](?:['\\w-]*[^\\W_])?|[:,\"“”„«»]")
_END = re.compile("[.!?;]+(?![\"“”„«»])|[\n\r]+")


def inflected(verb: str) -> list[str]:
    """A verb with its regular endings, with and without a doubled consonant."""
    stem = verb.removesuffix("e")
    return [verb, *(verb + e for e in ("s", "es")), *(x + e for x in (stem, verb + verb[-1]) for e in ("ed", "ing"))]


_APOSTROPHES = "\u2019\u2018\u02bc\u00b4"

# Symbols: a class and the marks that transducers have put on it.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, COLON, COMMA, QUOTE, OWNER, PASSIVE = range(11)
TARGETED, NEGATED, REPORTED = 16, 32, 64
WORDS = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, OWNER, PASSIVE)
SYMBOLS = [c | m for c in range(11) for m in range(0, 128, 16) if not m or c in (INSULT, THREAT)]


@dataclass(frozen=True)
class Transducer:
    """start: a state; step: (state, symbol) -> (state, symbol, weight)."""

    start: object
    step: Callable[[object, int], tuple[object, int, float]]


_HITS = (INSULT, THREAT)


def _hit(symbol: int) -> bool:
    return symbol & 15 in _HITS


def negation() -> Transducer:
    """State: words left under a negation."""

    def step(left: int, x: int):
        if x == NEGATION:
            return SCOPE, x, 0.0
        return max(0, left - (x & 15 in WORDS)), x | NEGATED if left and _hit(x) else x, -1.0 if left and _hit(x) else 0.0

    return Transducer(0, step)


def report_before() -> Transducer:
    """State: whether a report stands before. It holds to the clause's end, through colons and quotation marks."""

    def step(said: bool, x: int):
        if x == REPORT:
            return True, x, 0.0
        return said, x | REPORTED if said and _hit(x) else x, -1.0 if said and _hit(x) else 0.0

    return Transducer(False, step)


def target_before() -> Transducer:
    """State: whether a target stands before, and words left after a passive's "be".

    An insult binds to any target before it, a threat only where the target
    suffers it: "you will be shot", not "the people shoot a film".
    """

    def step(state: tuple[bool, int], x: int):
        seen, passive = state
        bound = seen and (x & 15 == INSULT or (x & 15 == THREAT and passive > 0))
        after = 2 if x == PASSIVE else max(0, passive - (x & 15 in WORDS))
        return (seen or x in (TARGET, OWNER), after), x | TARGETED if bound else x, 0.5 if bound else 0.0

    return Transducer((False, 0), step)


def target_after() -> Transducer:
    """Read from the right. State: words left in which a target binds, and in which one binds that is no mere owner.

    A threat's object is a target itself, not what a target owns ("kill your
    bacteria"); an insult binds to either ("your stupid face").
    """

    def step(state: tuple[int, int], x: int):
        left, whole = state
        if x in (TARGET, OWNER):
            return (REACH, REACH if x == TARGET else 0), x, 0.0
        bound = (left if x & 15 == INSULT else whole) > 0 and _hit(x)
        less = x & 15 in WORDS
        return (max(0, left - less), max(0, whole - less)), x | TARGETED if bound else x, 0.5 if bound else 0.0

    return Transducer((0, 0), step)


def report_after() -> Transducer:
    """Read from the right. State: 0 nothing; 1 to REACH: words left in which a report looks for the end of
    what it reports; -1: inside a quotation that it reports; -2: before a comma, to the clause's start."""

    def step(at: int, x: int):
        if x == REPORT:
            return REACH if at >= 0 else at, x, 0.0
        if x == QUOTE:
            return -1 if at > 0 else 0 if at == -1 else at, x, 0.0
        if x == COMMA and at > 0:
            return -2, x, 0.0
        inside = at < 0 and _hit(x)
        return at - 1 if at > 0 and x & 15 in WORDS else at, x | REPORTED if inside else x, -1.0 if inside else 0.0

    # A comma right before the closing mark ("...", he said) stands between it and the report.
    def skipping(state: tuple[int, bool], x: int):
        at, comma = state
        if comma and x != QUOTE:
            at = -2
        if x == COMMA and at > 0:
            return (at, True), x, 0.0
        to, y, w = step(at, x)
        return (to, False), y, w

    return Transducer((0, False), skipping)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What ``second`` makes of ``first``'s output; weights add."""

    def step(state, x: int):
        a, y, v = first.step(state[0], x)
        b, z, w = second.step(state[1], y)
        return (a, b), z, v + w

    return Transducer((first.start, second.start), step)


def compiled(machine: Transducer) -> tuple[list[list[int]], list[list[int]], list[list[float]]]:
    """Tables next, out and weight by numbered state (0 is the start) and symbol, of the states that can be reached."""
    numbers, rows = {machine.start: 0}, [machine.start]
    to, out, weight = [], [], []
    for state in rows:
        line = [[0] * 128, [0] * 128, [0.0] * 128]
        for x in SYMBOLS:
            after, line[1][x], line[2][x] = machine.step(state, x)
            if after not in numbers:
                numbers[after] = len(rows)
                rows.append(after)
            line[0][x] = numbers[after]
        for table, values in zip((to, out, weight), line, strict=True):
            table.append(values)
    return to, out, weight


class Grammar:
    """The composed transducers: one table read from right to left, then one from left to right."""

    def __init__(self) -> None:
        self.passes = (compiled(compose(target_after(), report_after())), compiled(compose(compose(negation(), report_before()), target_before())))

    def read(self, symbols: list[int]) -> list[tuple[int, float]]:
        """Each symbol with its marks, and the weight that the paths give it."""
        weights = [0.0] * len(symbols)
        for (to, out, weight), order in zip(self.passes, (range(len(symbols) - 1, -1, -1), range(len(symbols))), strict=True):
            state, marked = 0, []
            for i in order:
                x = symbols[i]
                if x & 15 in _HITS:
                    marked.append((i, out[state][x]))
                    weights[i] += weight[state][x]
                state = to[state][x]
            symbols = list(symbols)
            for i, x in marked:
                symbols[i] = x
        return list(zip(symbols, weights, strict=True))

    def contexts(self, symbols: list[int]) -> list[str | None]:
        """For each symbol the context under which it is accepted, or None."""
        return [context_of(x) for x, _ in self.read(symbols)]


def context_of(symbol: int) -> str | None:
    if not _hit(symbol):
        return None
    if symbol & REPORTED:
        return "reported"
    if symbol & NEGATED:
        return "negated"
    # A threat is one only towards a target; otherwise the words are innocent.
    if symbol & 15 == THREAT:
        return "threat" if symbol & TARGETED else None
    return "targeted" if symbol & TARGETED else "plain"


_GRAMMAR = Grammar()
THREAT_WORDS = {w for v in THREATS for w in inflected(v)}
_CLASS = {**{w: THREAT for w in THREAT_WORDS}, **{w: k for k, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (PASSIVE, PASSIVES)) for w in words}, **{w: OWNER for w in OWNERS if w not in TARGETS}, ":": COLON, ",": COMMA, **dict.fromkeys('"“”„«»', QUOTE)}


def plural(noun: str) -> list[str]:
    return [noun, noun + ("es" if noun.endswith(("s", "sh", "ch", "x")) else "s")]


def lowered(text: str) -> str:
    """Lower case and plain apostrophes, with every character in its place."""
    for mark in _APOSTROPHES:
        if mark in text:
            text = text.replace(mark, "'")
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def class_of(token: str) -> int:
    """A word's class; a contraction's is that of what it begins with ("you're"), and any "...n't" negates."""
    found = _CLASS.get(token)
    if found is None and "'" in token:
        head, _, tail = token.partition("'")
        found = NEGATION if token.endswith("n't") else _CLASS.get(head) if tail in CONTRACTED else None
    return OTHER if found is None else found


@dataclass
class Model:
    """stems: learned word starts with weights; words: whole words; weights: of CONTEXTS."""

    stems: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=lambda: {w: 1.0 for noun in INSULTS for w in plural(noun)})
    weights: tuple[float, ...] = START_WEIGHTS
    base: float = START_BASE

    def automaton(self):
        keys = ahocorasick.Automaton()
        for key in {*self.stems, *self.words, *THREAT_WORDS}:
            keys.add_word(key, len(key))
        keys.make_automaton()
        return keys

    known: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False, compare=False)

    def symbol(self, token: str) -> tuple[int, float]:
        """A token's class, and its weight as an insult; remembered up to a bound."""
        found = self.known.get(token)
        if found is None:
            weight = self.insult(token)
            found = (INSULT if weight else class_of(token), weight or 1.0)
            if len(self.known) >= 50_000:
                self.known.clear()
            self.known[token] = found
        return found

    def insult(self, word: str) -> float:
        return max([self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in STEMS)])

    def clauses(self, text: str, keys) -> list[tuple[str, str, float, int]]:
        """(clause, context, weight, hits) of every clause that the grammar accepts."""
        low = lowered(text)
        starts = sorted({end - length + 1 for end, length in keys.iter(low) if end == length - 1 or not low[end - length].isalnum()})
        out, done = [], 0
        for start in starts:
            if start < done:
                continue
            # The clause begins after the last end before the match; what was read before is not read again.
            left = done
            for end in _END.finditer(low, done, start):
                left = end.end()
            found = _END.search(low, start)
            done = found.start() if found else len(low)
            found = [self.symbol(t) for t in _TOKEN.findall(low[left:done])]
            read = _GRAMMAR.read([x for x, _ in found])
            hits = [(weight + path, context, weight) for (_, weight), (x, path) in zip(found, read, strict=True) if x & 15 in _HITS and (context := context_of(x))]
            if hits:
                _, context, weight = max(hits)  # the heaviest path names the clause
                out.append((text[left:done].strip(), context, weight, len(hits)))
        return out

    def features(self, text: str | None, keys) -> list[float]:
        sums, weak, dense = dict.fromkeys(CONTEXTS, 0.0), 0.0, 0.0
        found = self.clauses(text or "", keys)
        for _, context, weight, hits in found:
            if weight >= STRONG:
                sums[context] += weight
            else:
                weak += weight
                dense += hits
        dense = dense and dense * 100 / (len(text.split()) + 5)
        return [*(min(v, 3.0) for v in sums.values()), min(weak, 4.0), min(dense, 8.0)]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + x @ np.array(self.weights), -30, 30)))


def learn_stems(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Stems and whole words that mark toxic documents, by greedy cover.

    Documents are counted per distinct word, word counts are rolled up into
    stems, and only patterns that are nearly always toxic stay. A pattern is
    then chosen only for toxic documents that no stronger one explains, so
    words that merely occur beside insults, or in copies of a toxic text, are
    not learned.
    """
    texts = sample.groupBy(F.xxhash64("text").alias("text_id")).agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"), F.max("label").alias("label"))
    words = F.array_distinct(F.expr("regexp_extract_all(lower(text), '[\\\\p{L}][\\\\p{L}\\\\p{N}]{2,}', 0)"))
    by_word = stash(texts.select("doc_id", "label", F.explode(words).alias("word")), "toxic-words")
    counts = by_word.groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("seen"))
    stem = lambda k: F.when(F.length("word") > k, F.substring("word", 1, k))
    patterns = counts.select("toxic", "seen", F.explode(F.array_compact(F.array(F.concat("word", F.lit("$")), *map(stem, STEMS)))).alias("pattern"))
    share, z2 = F.col("toxic") / F.col("seen"), 1.96**2
    bound = (share + z2 / (2 * F.col("seen")) - 1.96 * F.sqrt(share * (1 - share) / F.col("seen") + z2 / (4 * F.col("seen") ** 2))) / (1 + z2 / F.col("seen"))
    strong = patterns.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("seen").alias("seen")).where((F.col("toxic") >= MIN_DOCS) & (bound >= MIN_SHARE))
    strong = stash(strong, "toxic-patterns")
    support = {r["pattern"]: (int(r["toxic"]), int(r["seen"])) for r in strong.collect()}  # all that the bounded sample has
    if not support:
        return {}, {}
    toxic = by_word.where("label = 1").select("doc_id", F.explode(F.array_compact(F.array(F.concat("word", F.lit("$")), *map(stem, STEMS)))).alias("pattern"))
    pairs = toxic.join(broadcast_if_small(strong.select("pattern")), "pattern").groupBy("pattern").agg(F.collect_set("doc_id").alias("docs"))
    docs_of = {r["pattern"]: set(r["docs"]) for r in pairs.toLocalIterator()}  # a pattern's toxic documents among at most TRAIN_ROWS
    stems, whole, left = {}, {}, set().union(*docs_of.values()) - set().union(*(docs_of.get(w + "$", set()) for w in INSULTS))
    while docs_of:
        # Most new documents first; of equals the purest, then the longest, which says most.
        best = max(docs_of, key=lambda p: (len(docs_of[p] & left), support[p][0] / support[p][1], len(p), p))
        new = docs_of.pop(best) & left
        if len(new) < MIN_DOCS:
            break
        left -= new
        toxic_docs, seen = support[best]
        # Beyond STRONG only for patterns of which at most one in twenty documents is clean.
        weight = min(1.5, 0.32 * math.log((toxic_docs + 0.5) / (seen - toxic_docs + 0.5)))
        (whole if best.endswith("$") else stems)[best.rstrip("$")] = weight
    return stems, whole


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[tuple[float, ...], float]:
    """Logistic weights, pulled towards the start values; never negative."""
    start = np.array([*START_WEIGHTS, START_BASE])
    w, x1 = start.copy(), np.hstack([x, np.ones((len(x), 1))])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + ridge * (w - start)
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
        w[:-1] = np.maximum(w[:-1], 0)
    return tuple(w[:-1].tolist()), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, use: Column, limit: int = TRAIN_ROWS) -> Model:
    """Learn lexicon and weights from at most ``limit`` labelled documents."""
    sample = stash(labelled.sample(docs, labels, "toxic", use, limit), "toxic-sample")
    model = Model()
    stems, whole = learn_stems(sample)
    model.stems |= stems
    model.words |= whole
    rows = sample.select("doc_id", "label", _features(sample, model)("text").alias("x")).toPandas().sort_values(["doc_id", "label"])
    if len(rows):
        model.weights, model.base = fit_weights(np.array(rows["x"].tolist(), float), rows["label"].to_numpy(float))
    return model


def _features(docs: DataFrame, model: Model):
    held, keys = docs.sparkSession.sparkContext.broadcast(model), []

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        if not keys:
            keys.append(held.value.automaton())
        return pa.array([held.value.features(t, keys[0]) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return features


def scorer(docs: DataFrame, model: Model):
    """A column function: text column -> score."""
    held, keys = docs.sparkSession.sparkContext.broadcast(model), []

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        if not keys:
            keys.append(held.value.automaton())
        x = np.array([held.value.features(t, keys[0]) for t in texts.to_pylist()], float).reshape(len(texts), len(START_WEIGHTS))
        return pa.array(held.value.score(x), pa.float64())

    return lambda text: score(F.col(text).cast("string"))


def matched_clauses(docs: DataFrame, model: Model) -> DataFrame:
    """One row per matched clause: doc_id, clause, context, weight."""
    held, keys = docs.sparkSession.sparkContext.broadcast(model), []
    kind = pa.list_(pa.struct([("clause", pa.string()), ("context", pa.string()), ("weight", pa.float64())]))

    @F.arrow_udf("array<struct<clause:string,context:string,weight:double>>")
    def clauses(texts: pa.Array) -> pa.Array:
        if not keys:
            keys.append(held.value.automaton())
        return pa.array([[dict(zip(("clause", "context", "weight"), c, strict=False)) for c in held.value.clauses(t or "", keys[0])] for t in texts.to_pylist()], kind)

    return docs.select("doc_id", F.explode(clauses(F.col("text").cast("string"))).alias("c")).select("doc_id", "c.*")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, ~fold_is("doc_id", 4, 2))
    scored = docs.select("doc_id", fold_is("doc_id", 4, 2).alias("held_out"), scorer(docs, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
