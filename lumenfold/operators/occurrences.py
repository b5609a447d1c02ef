"""N-gram occurrences with offsets: lexical tokens with aliases, extraction, order, hashing, statistics."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions import hashing, text

#: Longest word n-gram.
LONGEST = 4
#: Order of occurrences within a text.
ORDER = ("start_char", "end_char", "kind", "order", "key", "alias")

#: Fields in that order, so that an array of occurrences sorts by it.
_OCCURRENCE = "struct<start_char:int,end_char:int,kind:string,order:int,key:string,alias:boolean,token_index:int>"
_COLUMNS = ("kind", "order", "key", "start_char", "end_char", "alias", "token_index")

#: Items (tokens and breaks) that are looked at together, fewer where they are long; and occurrences that are numbers at a time.
ITEMS, CHARACTERS, PLACED = 1 << 17, 1 << 23, 1 << 17
#: Tokens, and numbers learned of their keys, that a worker remembers.
REMEMBERED, LEARNED = 200_000, 1 << 22


def lexical(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, ord, surface, key, start_char, end_char, alias): canonical tokens, then their aliases at the same offsets."""
    spans = _keyed(text.token_spans(docs, id_col, text_col, row="row"))
    own = spans.select(id_col, "row", "ord", "surface", "key", "start_char", "end_char", F.lit(False).alias("alias"))
    others = spans.select(id_col, "row", "ord", "surface", F.explode(text.atom_aliases(text.canonical_surface(F.col("surface")))).alias("key"), "start_char", "end_char", F.lit(True).alias("alias"))
    return own.unionByName(others)


def _keyed(spans: DataFrame) -> DataFrame:
    return spans.withColumn("key", text.atom_key(text.canonical_surface(F.col("surface"))))


def _tokens(docs: DataFrame, id_col: str, text_col: str, counted: bool = False) -> DataFrame:
    """(id, row, run, start, end, ord, surface, own[, base]) of every token: ``run`` holds it and the next ones up to a sentence break.

    ``base`` counts the occurrences that begin with the text's tokens before this one.
    """
    spans = text.span_rows(docs, id_col, text_col)
    plain = spans.select(id_col, "row", F.transform("spans", lambda s: s.withField("surface", text.canonical_surface(s["surface"]))).alias("spans"))
    keyed = plain.select(id_col, "row", F.transform("spans", lambda s: s.withField("key", text.atom_key(s["surface"]))).alias("spans"))
    if counted:
        follow = lambda s, i: sum((F.coalesce(F.get("spans", i + k)["run"] == s["run"], F.lit(False)).cast("int") for k in range(1, LONGEST)), F.lit(1))  # noqa: E731  runs only rise
        sizes = F.transform("spans", lambda s, i: follow(s, i) + F.size(text.atom_aliases(s["surface"])) + F.when(text.char_gram_eligible(s["surface"], s["key"]), text.char_gram_count(s["key"])).otherwise(0))
        keyed = keyed.withColumn("base", totals_before(sizes))
    ahead = keyed.select(id_col, "row", F.posexplode(F.transform("spans", lambda _, i: F.slice("spans", i + 1, LONGEST))).alias("at", "ahead"), *(["base"] if counted else []))
    first = F.col("ahead")[0]
    same = F.filter("ahead", lambda s: s["run"] == F.col("ahead")[0]["run"])
    return ahead.select(id_col, "row", same.alias("run"), *[first[c].alias(n) for c, n in (("start_char", "start"), ("end_char", "end"), ("ord", "ord"), ("surface", "surface"), ("key", "own"))], *([F.get("base", F.col("at")).alias("base")] if counted else []))


@F.arrow_udf(T.ArrayType(T.LongType()))
def totals_before(counts: pa.Array) -> pa.Array:
    """Of each place of an array of counts, the sum of those before it."""
    offsets = counts.offsets.to_numpy()
    own = counts.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
    before = np.concatenate([[0], np.cumsum(own)])
    starts = offsets - offsets[0]
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(before[:-1] - np.repeat(before[starts[:-1]], np.diff(starts))))


def _of_token() -> Column:
    """All occurrences that begin with a token, as an array."""
    words = F.transform("run", lambda _, i: _occurrence(F.lit("word"), i + 1, F.array_join(F.transform(F.slice("run", 1, i + 1), lambda s: s["key"]), " "), F.col("start"), F.get("run", i)["end_char"], False, F.col("ord") + i))
    aliases = F.transform(text.atom_aliases(F.col("surface")), lambda a: _occurrence(F.lit("word"), F.lit(1), a, F.col("start"), F.col("end"), True, F.col("ord")))
    key = F.col("own")
    grams = F.transform(text.char_grams(key), lambda g: _occurrence(F.lit("char"), g["order"], g["key"], F.col("start") + g["pos"], F.col("start") + g["pos"] + g["order"], False, F.col("ord")))
    chars = F.when(text.char_gram_eligible(F.col("surface"), key), grams).otherwise(F.array().cast(f"array<{_OCCURRENCE}>"))
    return F.concat(words, aliases, chars)


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, kind, order, key, start_char, end_char, alias, token_index) of every n-gram of every text.

    Words and their aliases, word n-grams that no sentence break interrupts,
    and character n-grams of eligible words. Each token looks at the next
    ones within its row, so nothing is shuffled. ``token_index`` is the token
    that holds the last character. ``row`` tells texts of one id apart; null
    and empty texts have no occurrences.
    """
    return _tokens(docs, id_col, text_col).select(id_col, "row", F.inline(_of_token())).select(id_col, "row", *_COLUMNS)


def _occurrence(kind: Column, order: Column, key: Column, start: Column, end: Column, alias: bool, token: Column) -> Column:
    return F.struct(start.cast("int").alias("start_char"), end.cast("int").alias("end_char"), kind.alias("kind"), order.cast("int").alias("order"), key.alias("key"), F.lit(alias).alias("alias"), token.cast("int").alias("token_index"))


def placed_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`occurrences` with ``place``, from 0, of each within its text.

    Tokens do not overlap, so all that begins with one stands before all that
    begins with the next: each token's own are sorted, and counts of the
    tokens before it give the rest, within the row and without a shuffle.
    """
    own = _tokens(docs, id_col, text_col, counted=True).select(id_col, "row", "base", F.posexplode(F.array_sort(_of_token())).alias("pos", "o"))
    return own.select(id_col, "row", *[F.col("o")[c].alias(c) for c in _COLUMNS], (F.col("base") + F.col("pos")).alias("place"))


def ordered(found: DataFrame) -> DataFrame:
    """Adds ``place``, from 0, of each occurrence within its text, for rows of any origin; of whole texts `placed_occurrences` needs no shuffle."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy(*ORDER)) - 1)


# Sums within tasks ---------------------------------------------------------


class _Keys(text.KeyNumbers):
    """Numbers of keys, and what ``of`` says of keys, learned once: numbers of all together, and how many each has."""

    def __init__(self, of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        super().__init__()
        self.of, self.learned, self.began = of, array("i"), array("q", [0])

    def learn(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The keys, what is known of them, and where that of each begins."""
        names = list(self.of_key)
        found, counts = self.of(names[len(self.began) - 1 :])
        self.began.frombytes((len(self.learned) + np.cumsum(counts, dtype=np.int64)).tobytes())
        self.learned.frombytes(found.astype(np.int32).tobytes())
        return names, np.array(self.learned), np.array(self.began)

    def forget(self, kept: array) -> array:
        """Where too much is remembered, only the keys of these items stay; returns the items' numbers from now on."""
        if len(self) < REMEMBERED and len(self.learned) < LEARNED and self.held < text.SURFACES_HELD:
            return kept
        names = list(self.of_key)
        self.clear()
        self.__init__(self.of)
        return array("q", (self.of_key.setdefault(names[k], len(self.of_key)) for k in kept))


def _parts(texts: pa.Array, keys: _Keys, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(items, starts, ends, places of their texts, how many count) of about ``most`` items together; 0 is a break or a text's end.

    The last three items of a part within a text don't count: they come again
    with what follows, which n-grams that begin with them need.
    """
    held, size = [keys.forget(array("q")), array("q"), array("q"), array("q")], 0
    for at in range(len(texts)):
        rest, done = texts[at].as_py() or "", 0
        while rest:
            pieces, rest = text.cut_items(rest, max(most - len(held[0]), 1))
            items = pieces[1::2]
            ends = done + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            held[0].extend(map(keys.__getitem__, items))
            held[1].frombytes(ends[: 2 * len(items) : 2].tobytes())
            held[2].frombytes(ends[1::2].tobytes())
            held[3].extend(repeat(at, len(items)))
            size, done = size + int(ends[-1]) - done, int(ends[-1])
            if len(held[0]) >= most or (size >= CHARACTERS and len(held[0]) > 3):
                yield *map(np.array, held), len(held[0]) - 3
                held, size = [h[-3:] for h in held], 0
                held[0] = keys.forget(held[0])
        for column, value in zip(held, (0, 0, 0, at), strict=True):
            column.append(value)
    if held[0]:
        yield *map(np.array, held), len(held[0])


def _per_text(docs: DataFrame, id_col: str, text_col: str, names: list[str], of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], sums: Callable[[pa.Array, _Keys], np.ndarray]) -> DataFrame:
    """(id, *names) of each text whose first sum is not 0: ``sums`` of a batch's texts, a row for each name."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _Keys(of)
        for batch in batches:
            found = sums(batch.column(1), keys)
            some = np.flatnonzero(found[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), *(pa.array(c[some]) for c in found)], names=[id_col, *names])

    return rows.mapInArrow(each, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names))


def _add(total: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Adds values, whose texts lie side by side, to the sums of their texts."""
    if len(at):
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        total[..., at[first]] += np.add.reduceat(values, first, axis=-1)


def _key_numbers(keys: pa.StringArray) -> np.ndarray:
    """`_key_number` of a whole column without nulls."""
    if not len(keys):
        return np.empty(0, np.int64)
    _, offsets, raw = keys.buffers()
    raw, offsets = raw.to_pybytes(), np.frombuffer(offsets, np.int32, len(keys) + 1, 4 * keys.offset).tolist()
    return np.frombuffer(b"".join([sha256(raw[a:b]).digest() for a, b in pairwise(offsets)]), ">u2")[::16].astype(np.int64)


def _key_number(key: str) -> int:
    """The first 16 bits of a key's SHA-256."""
    return int.from_bytes(sha256(key.encode()).digest()[:2])


@lru_cache(1 << 17)
def _gram_number(code: int) -> int:
    """`_key_number` of characters as the bytes of a number."""
    return int.from_bytes(sha256(code.to_bytes(5).lstrip(b"\0")).digest()[:2])


def _ranks(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _own(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The occurrences that tokens have by their keys alone, in order, and how many each key has.

    As bits: 16 of the occurrence's number, 3 of the order, 7 of the end, 1 of
    late ones. Late ones stand after the token's longer word n-grams, others
    before. The end counts from the token's start; 0 is the token's end. Keys
    are ASCII; a character n-gram is a number of its bytes.
    """
    sizes = np.array([len(k) if text.gives_char_grams(k) else 0 for k in keys], np.int64)
    words = [[k] if k.isalpha() else sorted([k, *text.aliases_of(k)]) if k else [] for k in keys]
    n_words = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer("".join(k for k, n in zip(keys, sizes, strict=True) if n).encode() + bytes(5), np.uint8).astype(np.int64)
    spots = np.maximum(sizes - 2, 0)
    at, key = _ranks(spots), np.repeat(np.arange(len(keys)), spots)
    first = np.repeat(np.cumsum(sizes) - sizes, spots) + at
    window = sum(raw[first + i] << 8 * (4 - i) for i in range(5))
    orders = np.minimum(sizes[key] - at - 2, 3)
    order = 3 + _ranks(orders)
    window, at, key = (np.repeat(c, orders) for c in (window, at, key))
    codes, place = np.unique(window >> 8 * (5 - order), return_inverse=True)
    numbers = np.array(list(map(_gram_number, codes.tolist())), np.int64)[place]
    grams = np.bincount(key, minlength=len(keys))
    counts = grams + n_words
    begin = np.cumsum(counts) - counts
    found = np.empty(counts.sum(), np.int64)
    found[begin[key] + _ranks(grams) + (at > 0) * n_words[key]] = numbers | order << 16 | at + order << 19 | (at > 0).astype(np.int64) << 26
    found[np.repeat(begin + np.minimum(spots, 3), n_words) + _ranks(n_words)] = [_key_number(w) | 1 << 16 for w in chain.from_iterable(words)]
    return found, counts


def _placed(texts: pa.Array, keys: _Keys, most: int = ITEMS, placed: int = PLACED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | int, np.ndarray]]:
    """(place of the text, place, end_char, order, number of the key) of all occurrences, about ``placed`` together, each text's side by side."""
    done = np.zeros(len(texts), np.int64)
    for items, starts, ends, texts_at, counting in _parts(texts, keys, most):
        names, learned, began = keys.learn()
        grams = [(_key_numbers(longer), places) for longer, places in text.gram_numbers(items, names)]
        token = np.flatnonzero(items[:counting] > 0)
        if not len(token):
            continue
        key, at = items[token], texts_at[token]
        longer = sum((places[token] >= 0).astype(np.int64) for _, places in grams)
        alone = began[key + 1] - began[key]
        late = np.append(0, np.cumsum(learned >> 26))
        early = alone - (late[began[key + 1]] - late[began[key]])
        before = np.cumsum(alone + longer) - alone - longer
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        base = before + np.repeat(done[at[first]] - before[first], np.diff(np.append(first, len(at))))
        done[at[first]] += np.add.reduceat(alone + longer, first)
        for k, (numbers, places) in enumerate(grams):
            here = np.flatnonzero(places[token] >= 0)
            yield at[here], base[here] + early[here] + k, ends[token[here] + k + 1], k + 2, numbers[places[token[here]]]
        for own in np.split(np.arange(len(token)), np.flatnonzero(np.diff(np.cumsum(alone) // placed)) + 1):
            n, begin = alone[own], began[key[own]]
            of = lambda values: np.repeat(values, n)  # noqa: B023, E731
            flat = np.arange(n.sum()) + of(begin - np.cumsum(n) + n)
            bits = learned[flat]
            end = bits >> 19 & 127
            yield of(at[own]), flat + of(base[own] - begin) + (bits >> 26) * of(longer[own]), np.where(end > 0, of(starts[token[own]]) + end, of(ends[token[own]])), bits >> 16 & 7, bits & 0xFFFF


def place_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 1_000_003) -> DataFrame:
    """(id, last_place, place_digest, key_digest) of each text with occurrences: sums over all that `placed_occurrences` gives.

    An occurrence adds its place times its end plus its order, and its place
    from 1 times the first 16 bits of its key's SHA-256, each modulo
    ``modulus``. Occurrences are numbers within their row: what a token has by
    its key alone is learned once per key, of some texts together each distinct
    word n-gram is hashed once, and no occurrence is a row.
    """

    def sums(texts: pa.Array, keys: _Keys) -> np.ndarray:
        found = np.zeros((3, len(texts)), np.int64)  # the first one counts
        for at, place, end, order, number in _placed(texts, keys):
            _add(found, at, np.stack([np.ones(len(at), np.int64), (place * end + order) % modulus, (place + 1) * number % modulus]))
        return found

    counted = _per_text(docs, id_col, text_col, ["n", "place_digest", "key_digest"], _own, sums)
    return counted.select(id_col, (F.col("n") - 1).alias("last_place"), "place_digest", "key_digest")


def _shapes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many aliases and character n-grams a token with each key has, one after the other."""
    sizes = np.array([len(k) if text.gives_char_grams(k) else 0 for k in keys], np.int64)
    aliases = np.array([0 if k.isalpha() else len(text.aliases_of(k)) for k in keys], np.int64)
    return np.stack([aliases, sum(np.maximum(sizes - n + 1, 0) for n in (3, 4, 5))], 1).ravel(), np.full(len(keys), 2)


def _statistics(texts: pa.Array, keys: _Keys, most: int = ITEMS) -> np.ndarray:
    """Lexical tokens, aliases, word and character occurrences of each text."""
    found = np.zeros((4, len(texts)), np.int64)
    for items, _, _, at, counting in _parts(texts, keys, most):
        aliases, chars = keys.learn()[1].reshape(-1, 2)[items[:counting]].T.astype(np.int64)
        word = np.append(items > 0, [False] * (LONGEST - 1))
        begin, words = word[:counting], np.zeros(counting, np.int64)
        for k in range(LONGEST):
            begin = begin & word[k : counting + k]
            words += begin
        _add(found, at[:counting], np.stack([word[:counting] + aliases, aliases, words + aliases, chars]))
    return found


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`extraction_statistics` of whole texts: all is counted within the row, and no occurrence is made."""
    return _per_text(docs, id_col, text_col, ["lexical_tokens", "alias_tokens", "word_occurrences", "char_occurrences"], _shapes, _statistics)


def extraction_statistics(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per text: lexical tokens (aliases included), aliases, word and character occurrences, for rows of any origin; of whole texts `text_statistics` needs no rows."""
    word, single = F.col("kind") == "word", F.col("order") == 1
    return found.groupBy("row", id_col).agg(F.count_if(word & single).alias("lexical_tokens"), F.count_if(F.col("alias")).alias("alias_tokens"), F.count_if(word).alias("word_occurrences"), F.count_if(~word).alias("char_occurrences")).drop("row")


def hashed(found: DataFrame, keep_key: bool = False, secret: bytes = b"ngram-v1") -> DataFrame:
    """Adds namespace, feature_id and bucket; each distinct key is hashed once. The key stays only on request."""
    named = found.withColumn("namespace", hashing.namespace(F.col("kind"), F.col("order")))
    keys = named.select("namespace", "key").distinct().withColumn("h", hashing.feature_hash(secret)("namespace", "key"))
    joined = named.join(keys, ["namespace", "key"]).select(*[c for c in found.columns if c != "key" or keep_key], "namespace", F.col("h.feature_id").alias("feature_id"), F.col("h.bucket").alias("bucket"))
    return joined
