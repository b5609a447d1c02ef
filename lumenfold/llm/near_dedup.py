"""Near-duplicate detection with circulant MinHash and exact verification.

Plan
----
1. One pass over the texts makes, per document, the size of its shingle set,
   a 128-bit digest of that set, and the band keys of its circulant MinHash
   signature. Texts are not kept.
2. Documents of equal sets form a *class*, which is one numbered node from
   here on, so exact copies cost nothing afterwards.
3. In each band bucket every class is paired with the bucket's smallest one
   (a star, never all pairs). Pairs whose sizes cannot reach the threshold are
   not made.
4. Star pairs are verified on full shingle sets inside the JVM.
5. Linked classes become components. In a bucket whose members still lie in
   several components, members are compared exactly, in blocks of bounded
   size, and only links that join components are returned.
6. Components over all links give each document's smallest reachable id.

A key that many rows share (a hot bucket, or a hub with many pairs) is never
joined in one task: what is known of such keys, at most ``HOT_KEYS`` rows, is
broadcast, and a hot hub's set goes to several tasks (``meet``, ``_linked``).

Circulant MinHash: one permutation (sigma) scatters shingles over a ring of
places; the second (pi) ranks the places. Coordinate k of a signature is the
smallest ``pi[place + k]``: the same permutation turned by k, so two
permutations yield all coordinates. Sets of fewer than ``WIDE`` shingles use a
ring of ``RING`` places and a table of ranks; larger ones, which would crowd
it, use all 64-bit integers as ring and a bijection as pi. Sets near that
limit have the bands of both, so that no pair is told apart by it.

Defined results: a null or empty text has an empty set, links with nothing
and is its own component. Rows that repeat a doc_id each go by their own text
and may so differ in component; copies count as one text. Rows of null doc_id
link with nothing, have a null component and are kept. An empty table gives an
empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import HOT_ROWS, broadcast_if_small, fresh, hot_limit, list_array, map_arrow, meet, mix64, shingle_set, stash, text_bytes, text_digest, trim, without_ids, without_rows
from lumenfold.llm.components import connected_components

RING_BITS = 20
RING = 1 << RING_BITS
#: Signature coordinates are cut into BANDS bands of ROWS. At Jaccard 0.85 a
#: pair shares no band with probability (1 - 0.85**6)**32 = 2.6e-7; at 0.8 with 5.4e-5.
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
#: Sets of fewer shingles use the ring of RING places.
WIDE = 1 << 16
#: A verification block holds at most so many documents, and shingles unless one document alone has more.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 19
#: Buckets up to this many members are resolved by pairs, larger ones in blocks.
SMALL_BUCKET = 6


@lru_cache(1)
def ring_table() -> np.ndarray:
    """pi, with its start repeated at the end so that a turn is a plain slice."""
    ranks = np.random.Generator(np.random.PCG64(20_240_611)).permutation(RING).astype(np.uint32)
    table = np.concatenate([ranks, ranks[:COORDINATES]])
    return np.lib.stride_tricks.sliding_window_view(table, COORDINATES)


def signature(shingles: np.ndarray, wide: bool = False) -> np.ndarray:
    """All coordinates of a non-empty set; rows of pi are reduced in slices of bounded size."""
    places = mix64(shingles ^ np.uint64(0xA5A5_5A5A_1234_9876))
    out = np.full(COORDINATES, np.iinfo(np.uint64).max)
    if wide:
        turn = np.arange(COORDINATES, dtype=np.uint64)
        for at in range(0, len(places), 512):
            np.minimum(out, mix64((places[at : at + 512, None] + turn) ^ np.uint64(0x3C6E_F372_FE94_F82B)).min(axis=0), out=out)
        return out
    turns, places = ring_table(), (places >> np.uint64(64 - RING_BITS)).astype(np.int64)
    for at in range(0, len(places), 4096):
        np.minimum(out, turns[places[at : at + 4096]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, first: int = 1) -> np.ndarray:
    """One 64-bit key per band; the band's number, counted from ``first``, is part of the key."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(first, first + BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        keys = mix64(keys ^ rows[:, i])
    return keys


def set_bands(shingles: np.ndarray) -> np.ndarray:
    """The band keys of a set: of the small ring, the wide one, or, near the limit, both."""
    n = len(shingles)
    narrow = [band_keys(signature(shingles))] if 0 < n < 2 * WIDE else []
    wide = [band_keys(signature(shingles, True), 1 + BANDS)] if n > WIDE // 2 else []
    return np.concatenate([np.empty(0, np.uint64), *narrow, *wide])


def _profile_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes, high, low, keys, counts = [], [], [], [], []
    for text in text_bytes(batch.column(1)):
        shingles = shingle_set(text)
        sizes.append(len(shingles))
        digest = xxhash.xxh3_128_intdigest(shingles.tobytes())
        high.append(digest >> 64)
        low.append(digest & 0xFFFF_FFFF_FFFF_FFFF)
        keys.append(set_bands(shingles))
        counts.append(len(keys[-1]))
    flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (high, low)), list_array(flat.view(np.int64), np.array(counts, np.int32), pa.int64())],
        names=["doc_id", "n", "high", "low", "bands"],
    )


def _sets_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = [shingle_set(text) for text in text_bytes(batch.column(0))]
    digests = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in sets]
    high, low = ([d >> 64 for d in digests], [d & 0xFFFF_FFFF_FFFF_FFFF for d in digests])
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    halves = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (high, low)]
    return pa.RecordBatch.from_arrays([*halves, list_array(flat.view(np.int64), np.array([len(s) for s in sets], np.int32), pa.int64())], names=["high", "low", "shingles"])


def _can_link(a: str, b: str, percent: int):
    """The smaller set must reach ``percent`` of the larger one."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, total: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold, as links (a, b); ``total``: about how many pairs there are.

    An ``a`` of many pairs has its set in several tasks, one per part of its pairs.
    """
    limit = hot_limit(total)
    parts = F.ceil(F.col("n") / limit).cast("int").alias("parts")
    many = F.broadcast(stash(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("a", parts), "hot-hubs"))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")).join(many, "a", "left")
    left = left.select("a", "left", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    both = dealt.join(right, "b").join(left, ["a", "part"])
    common = both.select("a", "b", F.size(F.array_intersect("left", "right")).alias("common"), (F.size("left") + F.size("right")).alias("total"))
    return common.where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent).select("a", "b")


def _block_links(percent: int):
    """Exact links inside a block pair: a forest that joins its components.

    Intersection sizes come from products of 0/1 matrices over the shingles
    that at least two of the documents have, some columns at a time.
    """
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    def links(rows: pa.Table) -> pa.Table:
        ids, side, component = (rows[c].to_numpy() for c in ("node", "block", "component"))
        order = np.lexsort((ids, side))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        ids, side, component = ids[order], side[order], component[order]
        names, comps = np.unique(component, return_inverse=True)
        if rows["i"][0] != rows["j"][0] and side[0] == side[-1]:
            return none  # the other block is empty
        # rows x columns: all x all inside one block, else first block x second
        split = int(np.searchsorted(side, side[-1]))
        down, right = (slice(split), slice(split, None)) if split else (slice(None), slice(None))
        lists = rows["shingles"].combine_chunks()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        owner, flat = np.repeat(place, sizes), lists.flatten().to_numpy()
        sizes = sizes[order]
        by_shingle = np.argsort(flat, kind="stable")
        flat, owner = flat[by_shingle], owner[by_shingle]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
        counts = np.diff(np.append(first, len(flat)))
        owner = owner[np.repeat(counts > 1, counts)]
        counts = counts[counts > 1]
        column = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        common = np.zeros((len(sizes[down]), len(sizes[right])), np.float32)
        width = 4096
        for low in range(0, len(counts), width):
            a, b = np.searchsorted(column, [low, low + width])
            part = np.zeros((len(sizes), min(width, len(counts) - low)), np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            common += part[down] @ part[right].T
        shared = common.astype(np.int64)
        hit = shared * 100 >= (sizes[down, None] + sizes[None, right] - shared) * percent
        hit &= comps[down, None] != comps[None, right]
        root = list(range(len(names)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(hit), strict=True):
            j += split
            x, y = find(comps[i]), find(comps[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        trim()
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return links


def _sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles), once each, of the classes named in ``nodes`` (one stashed column), stashed."""
    wanted = stash(classes.join(broadcast_if_small(nodes), "node", "left_semi").select("high", "low", "node", "rep"), "wanted")
    reps = wanted.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(broadcast_if_small(reps), "doc_id", "left_semi")
    made = map_arrow(texts.select("text"), _sets_batch, "high long, low long, shingles array<long>")
    sets = stash(made.join(broadcast_if_small(wanted.drop("rep")), ["high", "low"]).select("node", "shingles"), "sets")
    if sets.count() > nodes.count():  # ids repeat
        sets = stash(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    return sets


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``percent``: two documents are linked where 100 * |A & B| >= percent * |A | B|;
    the bands are laid out for 80 and more.
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    profile = stash(map_arrow(slim, _profile_batch, "doc_id long, n long, high long, low long, bands array<long>"), "profile")
    filled = profile.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = filled.groupBy("high", "low", "n").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.count("*").alias("copies"))
    classes = stash(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay

    placed = classes.select("node", "n", F.explode("bands").alias("key"))
    total = classes.count()
    limit = hot_limit(total * BANDS)
    starts = stash(placed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("members")).where("members > 1").select("key", F.col("first.node").alias("hub"), F.col("first.n").alias("hub_n"), "members"), "bucket-starts")
    buckets = stash(meet(placed, starts, F.col("members") > limit), "buckets")

    star = stash(buckets.where((F.col("node") != F.col("hub")) & _can_link("n", "hub_n", percent)).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "star")
    sets = _sets_of(docs, classes, stash(buckets.select("node").distinct(), "bucket-nodes"))
    links = stash(_linked(star, sets, percent, star.count()), "links")

    found = connected_components(links)
    open_ = _unresolved(buckets, found, limit)
    pairs = stash(_pairs_of_small(open_.where(F.col("members") <= SMALL_BUCKET), percent), "pairs")
    more = _linked(pairs, sets, percent, pairs.count()).unionByName(_links_of_large(open_.where(F.col("members") > SMALL_BUCKET), sets, percent, limit))
    links = stash(links.unionByName(more), "all-links")
    found = connected_components(links)

    # A component is named by the smallest id in it; components of many classes and classes of many copies meet broadcasts.
    own = classes.select("high", "low", "n", "rep", "copies", "node")
    named = own.join(found.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").drop("at")
    least = stash(named.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("classes")), "least")
    in_component = meet(named.where("component IS NOT NULL"), least, F.col("classes") > hot_limit(total), "component")
    columns = ["high", "low", "n", "copies", "component_id"]
    class_ids = stash(in_component.select(columns).unionByName(named.where("component IS NULL").withColumnRenamed("rep", "component_id").select(columns)), "named")
    keyed, filled = profile.select("doc_id", "n", "high", "low"), (F.col("n") > 0) & F.col("doc_id").isNotNull()
    linked = meet(keyed.where(filled), class_ids, F.col("copies") > hot_limit(profile.count()), ["high", "low", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = keyed.where(~filled).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _unresolved(buckets: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """Members, with components, of the buckets that hold several components."""
    at = found.withColumnRenamed("node", "at")
    labelled = stash(buckets.join(at, F.col("node") == F.col("at"), "left").select("key", "node", "n", "hub", "members", F.coalesce("component", "node").alias("component")), "labelled")
    spread = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("in_bucket")).where("low != high AND in_bucket > 2")
    spread = stash(spread.select("key", "in_bucket"), "spread")
    return stash(meet(labelled, spread, F.col("in_bucket") > limit).drop("in_bucket"), "unresolved")


def _pairs_of_small(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in small buckets, without the star pairs."""
    x = members.select("key", "hub", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("component").alias("a_component"))
    y = members.select("key", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("component").alias("b_component"))
    both = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("a") != F.col("hub")) & (F.col("a_component") != F.col("b_component")) & _can_link("a_n", "b_n", percent))
    return both.select("a", "b").distinct()


def _links_of_large(members: DataFrame, sets: DataFrame, percent: int, limit: int) -> DataFrame:
    """Links of large buckets, from exact comparison in blocks."""
    full = _block_pairs(members, limit).join(sets, "node")
    return full.groupBy("key", "i", "j").applyInArrow(_block_links(percent), "a long, b long").distinct()


def _block_pairs(members: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """Members once for every pair (i, j) of blocks that they take part in.

    A bucket's largest component is its *core*, the other members the *rest*.
    Blocks of the rest (numbered first) meet each other and the blocks of the
    core; core blocks never meet, as they could only link what is linked.
    So work grows with rest times members, not with members squared. A bucket
    that fits one block is one block.
    """
    parts = members.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    cores = parts.groupBy("key").agg(F.max(F.struct("c", "w", "component")).alias("core"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    n_blocks = lambda c, w: F.greatest(F.ceil(c / BLOCK_DOCS), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    several = n_blocks(F.col("c"), F.col("w")) > 1
    q_core, q_rest = n_blocks(F.col("core.c"), F.col("core.w")), n_blocks(F.col("c") - F.col("core.c"), F.col("w") - F.col("core.w"))
    sized = cores.select("key", F.col("c").alias("in_bucket"), F.when(several, F.col("core.component")).alias("core"), F.when(several, q_core).alias("q_core"), F.when(several, q_rest).otherwise(1).alias("q_rest"))
    # Equal member lists in several bands are compared once.
    lists = members.groupBy("key").agg(F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("sum"), F.count("*").alias("size")).groupBy("sum", "size").agg(F.min("key").alias("key"))
    sized = stash(sized.join(lists.select("key"), "key"), "block-counts")
    once = meet(members.select("key", "node", "component"), sized, F.col("in_bucket") > limit).drop("in_bucket")
    in_core, place = F.col("component").eqNullSafe(F.col("core")), F.xxhash64("node")
    block = F.when(in_core, F.col("q_rest") + F.pmod(place, F.col("q_core"))).otherwise(F.pmod(place, F.col("q_rest"))).cast("int")
    met = F.when(in_core, F.col("q_rest")).otherwise(F.col("q_rest") + F.coalesce("q_core", F.lit(0)))
    spread = once.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    return spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "component", "node")


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Rows of ``docs`` that represent their component, one per component; columns unchanged.

    Where ids are null or repeat, rows are told apart by id and text: the
    smallest id, null last, represents its component, and of rows that repeat
    both one stays. Rows of empty sets all stay.
    """
    if docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        gone = stash(near_duplicates(docs, percent).where("NOT kept").select("doc_id").distinct(), "near-copies")
        return without_ids(docs, gone)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"), text_digest().alias("digest"))
    names = _numbered(stash(slim.groupBy("doc_id", "digest").agg(F.count("*").alias("rows")), "row-names"))
    own = names.select(F.col("doc_id").alias("own_doc"), F.col("digest").alias("own_text"), "number")
    once = slim.groupBy("doc_id", "digest").agg(F.first("text").alias("text"))
    texts = stash(once.join(own, F.col("doc_id").eqNullSafe(F.col("own_doc")) & (F.col("digest") == F.col("own_text"))).select(F.col("number").alias("doc_id"), "text"), "row-texts")
    found = stash(near_duplicates(texts, percent).select(F.col("doc_id").alias("number"), "n_shingles", "kept"), "row-verdicts")
    named = names.join(found, "number").select(F.col("doc_id").alias("gone_doc"), F.col("digest").alias("gone_text"), "rows", "n_shingles", "kept")
    gone = stash(named.where("NOT kept").select("gone_doc", "gone_text"), "near-copies")
    repeated = stash(named.where("kept AND rows > 1 AND n_shingles > 0").select("gone_doc", "gone_text"), "row-repeats")

    digest, row = fresh(docs, "gone_digest"), fresh(docs, "gone_row")
    kept = without_rows(docs.withColumn(digest, text_digest()), gone, digest)
    match = kept["doc_id"].eqNullSafe(F.col("gone_doc")) & (kept[digest] == F.col("gone_text"))
    whole = F.struct(*[kept[c] for c in docs.columns])
    # Of repeats the one row with the smallest digest of all its columns; combines before the shuffle.
    one = kept.join(broadcast_if_small(repeated), match, "left_semi").groupBy("doc_id", digest).agg(F.min_by(whole, F.md5(F.to_json(whole))).alias(row)).select(f"{row}.*")
    return without_rows(kept, repeated, digest).drop(digest).unionByName(one)


def _numbered(names: DataFrame) -> DataFrame:
    """Adds ``number``: the place by doc_id, null last, and digest; ranks inside range partitions plus the counts before them."""
    order = (F.col("doc_id").asc_nulls_last(), F.col("digest"))
    dealt = stash(names.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "row-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # one row per partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return stash(dealt.withColumn("inside", inside).join(F.broadcast(starts), "part").withColumn("number", (F.col("start") + F.col("inside")).cast("long")).drop("part", "inside", "start"), "row-numbers")


def brute_force(rows: Iterator[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component) by comparing every two documents' word tuples."""
    sets: dict[int, set[tuple[str, ...]]] = {}
    for doc_id, text in rows:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}
