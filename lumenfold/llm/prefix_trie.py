"""The trie of conversations that share their first turns.

A node is a distinct sequence of turns; its members are the conversations that
begin with it. Its smallest member owns it, and with a node a conversation
owns all longer prefixes of its own, so what a conversation owns is a chain
that starts at one depth (`first_owned`). That depth is found by binary
search: each round all conversations look the digest of their middle prefix up
in the minima of digests at once, and half of the prefixes is left. Chains
hang on chains: the tree is aggregated bottom-up over chains, in rounds that
double how far a sum travels (`chain_totals`), then along each chain.

Prefix digests are sums of hashes of the turns and their places (240 bits), so
that a prefix of millions of turns is summed up in blocks. Conversations,
prefixes or chains that very many rows share are met by broadcasts of their
few keys (`meet`), or are summed up before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import WORD_PATTERN, hot_limit, meet, stash, trim

#: Turns of one conversation that one window sums up; longer ones are summed up in blocks.
BLOCK = 4_096
#: Bytes of joined ids in one row on their way to a node's hash.
SEGMENT = 1 << 20
_LIMBS = [f"d{k}" for k in range(4)]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, said, words) of every turn that has a conversation: its place from 0, digest of role and text, and words.

    Turns are ordered by turn (null first), then role, then text. Rows are
    dealt by ranges of that order, so that a long conversation lies in many
    tasks; a place is the rank in its range and the rows in ranges before it.
    """
    role, text = text_of("role"), text_of("text")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    words = F.regexp_count("text", F.lit(WORD_PATTERN)).cast("long")
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stash(sorted_rows.select("conv_id", F.monotonically_increasing_id().alias("ord"), said.alias("said"), words.alias("words")), "turns").withColumn("part", F.shiftright("ord", 33))
    pieces = numbered.groupBy("conv_id", "part").agg(F.min("ord").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = pieces.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return numbered.join(shift, ["conv_id", "part"]).select("conv_id", (F.col("ord") + F.col("shift")).alias("pos"), "said", "words")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, n, base, place, said, words): each conversation with the head of its base; without turns: one row, place null.

    Conversation c takes the first h = crc32(c) mod ``most`` turns of
    c - c % ``every``, then its own turns after its first h.
    """
    turns = stash(turns, "ordered")
    sizes = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("own"))
    head = F.crc32(F.col("conv_id").cast("string")) % most
    based = sizes.select("conv_id", "own", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = based.join(bases, "base", "left").withColumn("taken", taken).withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = stash(convs.select("conv_id", "base", "own", "h", "taken", "n"), "convs")
    own = meet(turns, convs, F.col("own") > hot_limit(turns.count()), "conv_id").where("pos >= h").select("conv_id", "n", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("place"), "said", "words")
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    lent = convs.select("conv_id", "n", "base", "taken").join(heads, "base").where("pos < taken").select("conv_id", "n", (F.col("pos") + 1).alias("place"), "said", "words")
    nothing = convs.where("n = 0").select("conv_id", "n", F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("said"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(lent).unionByName(nothing)


def running(df: DataFrame, key: str, place: str, sums: list[str], longest: int, down: bool = False) -> DataFrame:
    """``df`` with each of ``sums`` replaced by its sum over the rows of ``key`` up to this ``place`` (``down``: from it on).

    Sums run within blocks of places; only if a place lies beyond the first
    block, sums of whole blocks are added.
    """
    block = F.floor(F.col(place) / BLOCK).cast("long")
    rows = df.withColumn("block_", block)
    order = F.col(place).desc() if down else F.col(place).asc()
    inside = Window.partitionBy(key, "block_").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({c: F.sum(c).over(inside) for c in sums})
    if longest >= BLOCK:
        totals = rows.groupBy(key, "block_").agg(*[F.sum(c).alias(c) for c in sums])
        other = Window.partitionBy(key).orderBy(F.col("block_").desc() if down else F.col("block_").asc()).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(key, "block_", *[F.sum(c).over(other).alias(f"{c}_before") for c in sums])
        joined = out.join(offsets, [key, "block_"])
        out = joined.withColumns({c: F.col(c) + F.coalesce(F.col(f"{c}_before"), F.lit(0)) for c in sums}).drop(*[f"{c}_before" for c in sums])
    return out.drop("block_")


def prefixes(rows: DataFrame, longest: int) -> DataFrame:
    """(conv_id, n, depth, digest, words) of every prefix of at least one turn."""
    mixed = F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), "said"), 256)
    limbs = {c: F.conv(F.substring("mixed", 15 * k + 1, 15), 16, 10).cast("decimal(30,0)") for k, c in enumerate(_LIMBS)}
    hashed = rows.where("place IS NOT NULL").withColumn("mixed", mixed).select("conv_id", "n", "place", "words", *[v.alias(c) for c, v in limbs.items()])
    summed = running(hashed, "conv_id", "place", _LIMBS, longest)
    return summed.select("conv_id", "n", F.col("place").alias("depth"), F.unhex(F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in _LIMBS]), 256)).alias("digest"), "words")


def first_owned(found: DataFrame, shared: DataFrame, convs: DataFrame, longest: int) -> DataFrame:
    """(conv_id, n, first): the first depth at which each conversation is its prefix's smallest member, n + 1 if none.

    ``shared``: digest, owner and members of the prefixes of several
    conversations; any other prefix is owned by the only one that has it. Each
    round asks for the middle of what is left of every conversation.
    """
    left = found.select("conv_id", "depth", "digest", F.lit(1).cast("long").alias("low"), (F.col("n") + 1).alias("high"))
    bounds = convs.select("conv_id", "n", F.lit(1).cast("long").alias("low"), (F.col("n") + 1).alias("high"))
    total, owners = found.count(), shared.select("digest", "owner", "members")
    crowded = hot_limit(total)
    for _ in range(max(longest, 1).bit_length()):
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("long")
        asked = left.where(F.col("depth") == middle).select("conv_id", "digest", middle.alias("middle"))
        hits = meet(asked, owners, F.col("members") > crowded, "digest").where("owner != conv_id").select("conv_id", (F.col("middle") + 1).alias("after"))
        told = stash(bounds.join(hits, "conv_id", "left").select("conv_id", "n", F.when(F.col("low") >= F.col("high"), F.col("low")).otherwise(F.coalesce("after", "low")).alias("low"), F.when((F.col("low") >= F.col("high")) | F.col("after").isNotNull(), F.col("high")).otherwise(middle).alias("high")), "bounds")
        bounds = told
        narrower = meet(left.drop("low", "high"), told, F.col("n") > crowded, "conv_id").where("depth >= low AND depth < high")
        left = stash(narrower.select("conv_id", "depth", "digest", "low", "high"), "asked")
    return bounds.select("conv_id", "n", F.col("low").alias("first"))


def chain_totals(chains: DataFrame) -> DataFrame:
    """(chain, leaves, saved) of each chain with all chains below it; ``chains``: chain, above (null: on the top chain), leaves, saved.

    In round k a chain's sum, which reaches 2^k - 1 chains down, goes to the
    chain 2^k above: as many rounds as the height of the tree has binary
    digits, each of one aggregation and two joins.
    """
    total = chains.count()
    state = stash(chains, "chains")
    while True:
        moving = state.where("above IS NOT NULL")
        if moving.isEmpty():
            return state.select("chain", "leaves", "saved")
        came = stash(moving.groupBy("above").agg(F.count("*").alias("many"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")), "came")
        keyed = stash(came.join(state.select(F.col("chain").alias("above"), F.col("above").alias("next")), "above").select("above", "next", "many"), "next")
        jumped = meet(moving.drop("leaves", "saved"), keyed, F.col("many") > hot_limit(total), "above").select("chain", F.col("next").alias("above"))
        summed = state.select("chain", "leaves", "saved").join(came.select(F.col("above").alias("chain"), "more_leaves", "more_saved"), "chain", "left")
        summed = summed.select("chain", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        state = stash(summed.join(jumped, "chain", "left"), "chains")


def id_hashes(ends: DataFrame) -> DataFrame:
    """(node_id, depth, ends_sha256) of nodes at which conversations end; ``ends``: conv_id, node_id, depth.

    Ids are sorted and joined by ranges, in segments of a megabyte; the hash
    of a node then runs over its segments only, one after the other.
    """
    order = ["node_id", "depth", "conv_id"]
    segment = pa.schema([("node_id", pa.int64()), ("depth", pa.int64()), ("begin", pa.int64()), ("ids", pa.binary())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, begin, held, size, out = None, 0, [], 0, []
        for batch in batches:
            for key in zip(*(batch.column(c).to_pylist() for c in order), strict=True):
                if key[:2] != node or size >= SEGMENT:
                    if held:
                        out.append((*node, begin, b",".join(held)))
                    if len(out) >= 1_000 or size >= SEGMENT:
                        yield _batch(out, segment)
                        out = []
                    node, begin, held, size = key[:2], key[2], [], 0
                held.append(b"%d" % key[2])
                size += len(held[-1]) + 1
        if held:
            out.append((*node, begin, b",".join(held)))
        if out:
            yield _batch(out, segment)
        trim()

    hashes = pa.schema([("node_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running_hash, out = None, None, []
        for batch in batches:
            for n, d, ids in zip(*(batch.column(c).to_pylist() for c in ("node_id", "depth", "ids")), strict=True):
                if (n, d) == node:
                    running_hash.update(b"," + ids)
                    continue
                if node:
                    out.append((*node, running_hash.hexdigest()))
                node, running_hash = (n, d), hashlib.sha256(ids)
            if len(out) >= 1_000:
                yield _batch(out, hashes)
                out = []
        if node:
            out.append((*node, running_hash.hexdigest()))
        if out:
            yield _batch(out, hashes)
        trim()

    joined = stash(ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "node_id long, depth long, begin long, ids binary"), "segments")
    return joined.repartition("node_id", "depth").sortWithinPartitions("node_id", "depth", "begin").mapInArrow(digest, "node_id long, depth long, ends_sha256 string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def build_trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of ``rows`` (conv_id, n, place, said, words, as `rebuilt` gives them); see `trie` for its columns."""
    rows = stash(rows, "rebuilt")
    convs = stash(rows.select("conv_id", "n").distinct(), "convs")
    many, top, longest = convs.agg(F.count("*"), F.min("conv_id"), F.max("n")).head()
    if not many:
        return rows.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    found = stash(prefixes(rows, longest), "prefixes")
    minima = found.groupBy("digest").agg(F.min("conv_id").alias("owner"), F.count("*").alias("members")).where("members > 1")
    shared = stash(minima, "minima")
    depths = stash(first_owned(found, shared, convs, longest), "owned")

    # A conversation's last prefix, and the one before its chain, belong to another chain where they are not its own.
    crowded = hot_limit(found.count())
    placed = stash(meet(found, depths.withColumnRenamed("n", "turns"), F.col("turns") > crowded, "conv_id").drop("turns"), "placed")
    others = placed.where("depth = first - 1 OR (depth = n AND first > n)").select("conv_id", "digest", "depth", "first", "n")
    lent = stash(meet(others, shared, F.col("members") > crowded, "digest").select("conv_id", "depth", "first", "n", "owner"), "lent")
    ends = depths.where("first <= n").select("conv_id", F.col("conv_id").alias("node_id"), F.col("n").alias("depth"))
    ends = ends.unionByName(lent.where("depth = n").select("conv_id", F.col("owner").alias("node_id"), "depth"))
    ends = ends.unionByName(depths.where("n = 0").select("conv_id", F.lit(top).alias("node_id"), F.lit(0).cast("long").alias("depth")))

    # Chains, where they hang, and their nodes; the root is the first node of the top chain.
    hung = depths.where((F.col("first") <= F.col("n")) & (F.col("conv_id") != top)).select("conv_id", "first", "n")
    on = lent.select("conv_id", "owner")
    chains = hung.join(on, "conv_id", "left").select("conv_id", "first", "n", F.coalesce("owner", F.lit(top)).alias("parent"), (F.col("first") - 1).alias("hook"))
    chains = stash(chains, "chains")
    hooks = chains.groupBy(F.col("parent").alias("conv_id"), F.col("hook").alias("depth")).agg(F.count("*").alias("hung"))
    own = placed.where("depth >= first").select("conv_id", "n", "first", "depth", "digest", "words")
    nodes = own.join(shared.select("digest", "members"), "digest", "left").select("conv_id", "n", "first", "depth", F.coalesce("members", F.lit(1)).alias("n_convs"), "words")
    turns_of_top = depths.where(F.col("conv_id") == top).select("conv_id", "n", F.lit(1).cast("long").alias("first"), F.lit(0).cast("long").alias("depth"), F.lit(many).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    nodes = nodes.unionByName(turns_of_top).join(hooks, ["conv_id", "depth"], "left")
    last = F.col("depth") == F.col("n")
    nodes = nodes.withColumns({"n_children": F.coalesce("hung", F.lit(0)) + F.when(last, 0).otherwise(1), "own_saved": (F.col("n_convs") - 1) * F.col("words")})
    nodes = stash(nodes.withColumn("own_leaves", (F.col("n_children") == 0).cast("long")), "nodes")

    per_chain = nodes.groupBy("conv_id").agg(F.sum("own_leaves").alias("leaves"), F.sum("own_saved").alias("saved"))
    above = F.when(F.col("parent") != top, F.col("parent"))
    totals = chain_totals(chains.join(per_chain, "conv_id").select(F.col("conv_id").alias("chain"), above.alias("above"), "leaves", "saved"))
    below = chains.join(totals, chains["conv_id"] == totals["chain"]).groupBy(F.col("parent").alias("conv_id"), F.col("hook").alias("depth")).agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    with_hung = nodes.join(below, ["conv_id", "depth"], "left").withColumns({"n_leaves": F.col("own_leaves") + F.coalesce("hung_leaves", F.lit(0)), "saved_tokens": F.col("own_saved") + F.coalesce("hung_saved", F.lit(0))})
    along = running(with_hung.select("conv_id", "first", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"), "conv_id", "depth", ["n_leaves", "saved_tokens"], longest, down=True)

    begin = chains.select(F.col("conv_id"), F.col("first").alias("depth"), "parent")
    hashed = id_hashes(ends).select(F.col("node_id").alias("conv_id"), "depth", "ends_sha256")
    whole = along.join(begin, ["conv_id", "depth"], "left").join(hashed, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    return whole.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256, as whole numbers and
    lowercase hex.

    Null roles and texts are empty ones; null turns come first, and turns of
    one number are ordered by role, then text, by code points. Rows without
    conv_id belong to no conversation. Repeated rows are turns of their own. A
    conversation left without turns ends at the root. An empty table has no
    nodes, not even a root; extra columns are left out.
    """
    return build_trie(rebuilt(ordered_turns(conversations)))


ORACLE_SQL = """
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), bits
), built AS (
  SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY t.own, t.pos) AS depth, role, text
  FROM convs c JOIN (SELECT 0 AS own, * FROM turns UNION ALL SELECT 1, * FROM turns) t
    ON (t.own = 0 AND t.conv_id = c.base AND t.pos < c.h) OR (t.own = 1 AND t.conv_id = c.conv_id AND t.pos >= c.h)
), prefixes AS (
  SELECT conv_id, depth, text, to_json(list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY depth)) AS turns FROM built
  UNION ALL SELECT conv_id, 0, '', '[]' FROM convs
), owned AS (
  SELECT *, min(conv_id) OVER (PARTITION BY turns) AS owner, count(*) OVER (PARTITION BY turns) AS members,
         depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM prefixes
), nodes AS (
  SELECT owner AS conv_id, depth, any_value(members) AS n_convs, any_value(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM owned GROUP BY owner, depth
), linked AS (
  SELECT n.*, p.owner AS parent_conv_id FROM nodes n LEFT JOIN owned p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
), children AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c USING (conv_id, depth)
), subtree AS (
  SELECT o.owner AS conv_id, o.depth, sum((m.n_children = 0)::INT) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved_tokens
  FROM owned o JOIN counted m ON m.conv_id = o.conv_id AND m.depth >= o.depth GROUP BY o.owner, o.depth
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM counted JOIN subtree USING (conv_id, depth)
"""
