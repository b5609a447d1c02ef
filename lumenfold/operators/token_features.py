"""Features of tokens, ranked within the row, and bucket statistics of all n-grams.

A token's candidates all lie in its own text: the word n-grams that end with
it, its aliases and its character n-grams. So they are hashed, ranked and cut
where the text is read, and no n-gram is shuffled. Tokens are numbers of their
keys; of some texts together, each distinct n-gram is hashed once (BLAKE2b,
which Spark lacks), and ranking works on arrays. What a key itself contributes
is remembered between rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import hashing, text

#: Keys whose own features a worker remembers; n-grams that a task gathers before it hands a run over.
REMEMBERED, RUN_KEYS = 200_000, 1_000_000
#: Items (tokens and breaks) that are looked at together.
ITEMS = 1 << 17
#: Bytes of text for which one group of runs is planned.
SLICE_BYTES = 16 << 20
WORD_ORDERS, CHAR_ORDERS = (4, 3, 2), (5, 4, 3)


class _Hash:
    """BLAKE2b of namespace and key; the state after the secret is made once per namespace."""

    def __init__(self, secret: bytes) -> None:
        self.of = {}
        for name, (offset, buckets) in hashing.namespace_table().items():
            begun = hashlib.blake2b(digest_size=8, key=secret)
            begun.update(name.encode() + b"\0")
            self.of[name] = (begun.copy, 1 + offset, buckets)

    def raw(self, name: str, keys: Iterable[bytes]) -> np.ndarray:
        begun = self.of[name][0]

        def digest(key: bytes) -> bytes:
            state = begun()
            state.update(key)
            return state.digest()

        return np.frombuffer(b"".join(map(digest, keys)), "<u8")

    def features(self, name: str, keys: Iterable[bytes]) -> np.ndarray:
        _, first, buckets = self.of[name]
        return (first + self.raw(name, keys) % np.uint64(buckets)).astype(np.int32)


def _char_grams(key: str, n: int) -> set[str]:
    return {key[i : i + n] for i in range(len(key) - n + 1)}


def _own(h: _Hash, key: str) -> list[int]:
    """Ids that a token has by its key alone, best first: the word, its aliases, then longer character n-grams first."""
    coded = lambda keys: (k.encode() for k in keys)
    ids = [*h.features("word_1", coded([key])), *sorted(h.features("word_1", coded(text.aliases_of(key))))]
    if text.gives_char_grams(key):
        for n in CHAR_ORDERS:
            ids += sorted(set(h.features(f"char_{n}", coded(_char_grams(key, n)))))
    return list(dict.fromkeys(ids))


def _parts(texts: pa.Array, numbers: text.KeyNumbers, most: int = ITEMS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(items, place of the text, token index) of about ``most`` items together.

    The index is -1 for breaks, and for the three items before a part of a very
    long text, which come again since n-grams reach back to them.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for at in range(len(texts)):
        items = np.array(array("i", map(numbers.__getitem__, text.surfaces(texts[at].as_py() or "", breaks=True))), np.int64)
        index = np.where(items > 0, np.cumsum(items > 0) - 1, -1)
        for begin in range(0, len(items), most):
            back = min(begin, 3)
            own = index[begin - back : begin + most].copy()
            own[:back] = -1
            held.append((np.append(items[begin - back : begin + most], 0), np.full(len(own) + 1, at), np.append(own, -1)))
            size += len(own)
            if size >= most:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _ends(places: np.ndarray, order: int) -> np.ndarray:
    """The place of the n-gram that ends at each item, from that of the one that begins there."""
    return np.concatenate([np.full(order - 1, -1), places])[: len(places)]


def token_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 24, secret: bytes = b"ngram-v1") -> DataFrame:
    """(id, row, token_index, feature_ids, candidate_count, dropped) of every token: its best ``most`` distinct ids in rank order.

    Longer word n-grams rank before shorter ones, words before aliases, and
    all of them before character n-grams, longer first; smaller ids first
    within these. Null and empty texts have no tokens; rows that share an id
    are texts of their own.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, numbers = _Hash(secret), text.KeyNumbers()
        own, starts = array("i"), array("q", [0, 0])  # of each key in turn; breaks have none
        for batch in batches:
            for items, at, index in _parts(batch.column(2), numbers):
                names = list(numbers.of_key)
                for key in names[len(starts) - 1 :]:
                    own.extend(_own(h, key))
                    starts.append(len(own))
                token = np.flatnonzero(index >= 0)
                key, began = items[token], np.array(starts)
                grams = dict(zip((2, 3, 4), text.gram_numbers(items, names), strict=True))
                words = []  # by falling order, the id of the n-gram that ends with each token, or 0
                for n in WORD_ORDERS:
                    keys, places = grams[n]
                    ids = np.append(h.features(f"word_{n}", keys.cast(pa.binary()).to_pylist()), np.int32(0))
                    words.append(ids[_ends(places, n)[token]])
                longer = sum((w > 0).astype(np.int64) for w in words)
                counts = longer + began[key + 1] - began[key]
                kept = np.minimum(counts, most)
                ends = np.cumsum(kept)
                rank = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - kept, kept)
                flat = np.array(own, np.int32)[np.maximum(np.repeat(began[key] - longer, kept) + rank, 0)]  # places of words are filled below
                before = np.zeros(len(token), np.int64)
                for w in words:
                    here = (w > 0) & (before < kept)
                    flat[(ends - kept + before)[here]] = w[here]
                    before += w > 0
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat, pa.int32()))
                again = pa.array(at[token])
                yield pa.record_batch(
                    [batch.column(0).take(again), batch.column(1).take(again), pa.array(index[token].astype(np.int32)), ids, pa.array(counts.astype(np.int32)), pa.array(np.maximum(counts - most, 0).astype(np.int32))],
                    names=[id_col, "row", "token_index", "feature_ids", "candidate_count", "dropped"],
                )
            if len(numbers.of_key) >= REMEMBERED or numbers.held >= text.SURFACES_HELD:
                numbers, own, starts = text.KeyNumbers(), array("i"), array("q", [0, 0])

    return rows.mapInArrow(each, f"`{id_col}` {kind}, row long, token_index int, feature_ids array<int>, candidate_count int, dropped int")


# Bucket statistics --------------------------------------------------------------


def bucket_statistics(docs: DataFrame, text_col: str = "text", secret: bytes = b"ngram-v1") -> DataFrame:
    """(namespace, unique_keys, bucket_count, occupied_buckets, collision_rate, load_factor, max_bucket_depth) of all n-grams and aliases.

    Each task hands over sorted runs of its distinct keys as 80 bits of hashes
    (the 64 of the feature hash and 16 of another), not as text; runs of one
    slice of the hash's range are merged in one group, whose number grows with
    the texts. Keys count as equal where all 80 bits agree.
    """
    volume = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).head()[0] or 0
    bits = min(16, max(3, int(volume // SLICE_BYTES).bit_length()))
    runs = pa.schema([("space", pa.string()), ("slice", pa.int32()), ("keys", pa.binary())])
    packed = np.dtype([("raw", "<u8"), ("more", "<u2")])

    def packed_keys(h: _Hash, name: str, keys: list[bytes]) -> np.ndarray:
        found = np.empty(len(keys), packed)
        found["raw"] = h.raw(name, keys)
        found["more"] = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)) & np.uint64(0xFFFF)
        return found

    def hand_over(gathered: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for name, parts in gathered.items():
            found = np.concatenate([np.empty(0, packed), *parts])
            raw, more = found["raw"].astype(np.uint64), found["more"].astype(np.uint16)
            found = found[(order := np.lexsort((more, raw)))]
            raw, more = raw[order], more[order]
            fresh = np.append(True, (raw[1:] != raw[:-1]) | (more[1:] != more[:-1]))[: len(found)]
            found, cut = found[fresh], (raw[fresh] >> np.uint64(64 - bits)).astype(np.int32)
            for part in np.split(np.arange(len(found)), np.flatnonzero(np.diff(cut)) + 1):
                if len(part):
                    rows.append((name, int(cut[part[0]]), found[part].tobytes()))
            parts.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), runs, strict=True)], schema=runs)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, numbers, known = _Hash(secret), text.KeyNumbers(), 1
        gathered: dict[str, list[np.ndarray]] = {n: [] for n in hashing.NAMESPACE_BUCKETS}
        for batch in batches:
            for items, _, _ in _parts(batch.column(0), numbers):
                names = list(numbers.of_key)
                own: dict[str, set[str]] = {"word_1": set(), **{f"char_{n}": set() for n in CHAR_ORDERS}}
                for key in names[known:]:
                    own["word_1"].update([key, *text.aliases_of(key)])
                    if text.gives_char_grams(key):
                        for n in CHAR_ORDERS:
                            own[f"char_{n}"] |= _char_grams(key, n)
                known = len(names)
                for name, keys in own.items():
                    gathered[name].append(packed_keys(h, name, [k.encode() for k in keys]))
                for n, (keys, _) in zip((2, 3, 4), text.gram_numbers(items, names), strict=True):
                    gathered[f"word_{n}"].append(packed_keys(h, f"word_{n}", keys.cast(pa.binary()).to_pylist()))
                if sum(len(x) for parts in gathered.values() for x in parts) >= RUN_KEYS:
                    yield from hand_over(gathered)
            if len(numbers.of_key) >= REMEMBERED or numbers.held >= text.SURFACES_HELD:
                numbers, known = text.KeyNumbers(), 1
        yield from hand_over(gathered)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct keys of each bucket, in one slice of one namespace."""
        name = key[0].as_py()
        held = np.concatenate([np.frombuffer(v, packed) for batch in batches for v in batch.column(batch.schema.get_field_index("keys")).to_pylist()])
        raw, more = held["raw"].astype(np.uint64), held["more"].astype(np.uint16)
        order = np.lexsort((more, raw))
        raw, more = raw[order], more[order]
        fresh = np.concatenate([[True], (raw[1:] != raw[:-1]) | (more[1:] != more[:-1])])
        depth = np.bincount((raw[fresh] % np.uint64(hashing.NAMESPACE_BUCKETS[name])).astype(np.int64))
        hit = np.flatnonzero(depth)
        yield pa.record_batch([pa.array([name] * len(hit)), pa.array(hit.astype(np.int32)), pa.array(depth[hit].astype(np.int64))], names=["namespace", "bucket", "keys"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(each, "space string, slice int, keys binary").groupBy("space", "slice").applyInArrow(merge, "namespace string, bucket int, keys long")
    depth = counts.groupBy("namespace", "bucket").agg(F.sum("keys").alias("keys"))
    size = F.create_map(*[F.lit(x) for pair in hashing.NAMESPACE_BUCKETS.items() for x in pair])[F.col("namespace")]
    stats = depth.groupBy("namespace").agg(F.sum("keys").alias("unique_keys"), F.count("*").alias("occupied_buckets"), F.max("keys").alias("max_bucket_depth"))
    return stats.select("namespace", "unique_keys", size.alias("bucket_count"), "occupied_buckets", (1 - F.col("occupied_buckets") / F.col("unique_keys")).alias("collision_rate"), (F.col("unique_keys") / size).alias("load_factor"), "max_bucket_depth")
