"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with
that speaker as assistant and the others as named users. Each rendering comes
with masks: the character spans of the assistant's words, which alone are
trained on.

A rendering is cut into blocks of ``BLOCK_TURNS`` turn numbers, and a block
into parts of ``PART_ROWS`` messages, so neither a conversation of any length
nor any number of rows of one turn number (or of null ones) gathers in one
row. Blocks and parts of a perspective, in order, are the whole dialogue.

Only blocks of more than ``PART_ROWS`` messages are numbered: equal messages
are counted first, distinct ones dealt by ranges of their order, and a
message's place is its place in its range plus the totals of the ranges
before it. Blocks of a busy conversation meet its participants under salts.

Defined results: null roles speak as ``unknown``; null texts are empty
messages; rows of one turn number are ordered by role and text, and repeated
rows are rendered as often as they occur. Rows of null conv_id or turn are a
conversation, or a block, of their own (null). An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import broadcast_if_small, hot_limit, stash

BLOCK_TURNS = 64
PART_ROWS = 4096
_SAID = ("turn", "speaker", "text")


def _same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    """The columns ``keys`` of two tables are equal, or both null."""
    found = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        found = found & a[k].eqNullSafe(b[k])
    return found


def _placed(rows: DataFrame, part_rows: int) -> DataFrame:
    """(conv_id, block, part, turn, speaker, text) of crowded blocks, each message with its part."""
    counted = rows.groupBy("conv_id", "block", *_SAID).agg(F.count("*").alias("n"))
    dealt = stash(counted.repartitionByRange("conv_id", "block", *_SAID).withColumn("deal", F.spark_partition_id()), "chat-dealt")
    own = Window.partitionBy("conv_id", "block", "deal").orderBy(*_SAID).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("conv_id", "block", "deal").agg(F.sum("n").alias("total"))
    # At most one row per range and block, so a window holds no more rows than there are ranges.
    earlier = Window.partitionBy("conv_id", "block").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    before = stash(totals.select("conv_id", "block", "deal", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before")), "chat-before")
    local = dealt.withColumn("at", F.coalesce(F.sum("n").over(own), F.lit(0)))
    start = F.col("before") + F.col("at")
    met = local.join(broadcast_if_small(before), _same(local, before, "conv_id", "block", "deal"))
    met = met.select(local["conv_id"], local["block"], *_SAID, start.alias("start"), (start + F.col("n")).alias("stop"))
    first, last = F.floor(F.col("start") / part_rows), F.floor((F.col("stop") - 1) / part_rows)
    parts = met.withColumn("part", F.explode(F.sequence(first, last)))
    times = F.least("stop", (F.col("part") + 1) * part_rows) - F.greatest("start", F.col("part") * part_rows)
    return parts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).select("conv_id", "block", "part", *_SAID)


def _in_parts(rows: DataFrame, part_rows: int) -> DataFrame:
    """``rows`` with the part of its block that each message is in."""
    crowded = stash(rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")).where(F.col("n") > part_rows).select("conv_id", "block"), "chat-crowded")
    plain = rows.withColumn("part", F.lit(0).cast("long"))
    if not crowded.head(1):
        return plain
    few = broadcast_if_small(crowded)
    cut = _placed(rows.join(few, _same(rows, crowded, "conv_id", "block"), "left_semi"), part_rows)
    return plain.join(few, _same(plain, crowded, "conv_id", "block"), "left_anti").unionByName(cut)


def _perspectives(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """``blocks`` once for every participant of their conversation."""
    people = rows.select("conv_id", F.col("speaker").alias("perspective")).distinct()
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    limit = hot_limit(rows.count())
    busy = stash(sizes.where(F.col("n") > limit).select(F.col("conv_id").alias("busy_id"), F.ceil(F.col("n") / limit).alias("salts")), "chat-busy")
    if busy.head(1):
        few = broadcast_if_small(busy)  # at most HOT_KEYS rows
        salts = F.coalesce("salts", F.lit(1).cast("long"))
        blocks = blocks.join(few, F.col("conv_id").eqNullSafe(F.col("busy_id")), "left").withColumn("salt", F.pmod(F.hash("block", "part").cast("long"), salts)).drop("busy_id", "salts")
        people = people.join(few, F.col("conv_id").eqNullSafe(F.col("busy_id")), "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("busy_id", "salts")
        return blocks.join(people, _same(blocks, people, "conv_id", "salt")).select(blocks["conv_id"], "perspective", "block", "part", "said")
    return blocks.join(people, _same(blocks, people, "conv_id")).select(blocks["conv_id"], "perspective", "block", "part", "said")


def rotate(turns: DataFrame, block_turns: int = BLOCK_TURNS, part_rows: int | None = None) -> DataFrame:
    """(conv_id, perspective, block, part, n_turns, n_masked, rendered, masks) per participant, block and part.

    ``masks``: spans (start, end) of characters, end exclusive, in which the
    assistant's message stands, its end mark included.
    """
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / block_turns).cast("long").alias("block"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    parted = _in_parts(rows, part_rows or PART_ROWS)
    blocks = parted.groupBy("conv_id", "block", "part").agg(F.array_sort(F.collect_list(F.struct(*_SAID))).alias("said"))
    both = _perspectives(blocks, rows)

    def opening(x):
        return F.when(x["speaker"] == F.col("perspective"), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), x["speaker"], F.lit("|>\n")))

    parts = F.transform("said", lambda x: F.struct(opening(x).alias("head"), F.concat(x["text"], F.lit("<|end|>\n")).alias("body"), (x["speaker"] == F.col("perspective")).alias("own")))
    with_parts = both.withColumn("parts", parts)
    # Where each message begins: lengths of all that stands before it, at most a part's messages.
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, p):
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    return with_parts.select(
        "conv_id",
        "perspective",
        "block",
        "part",
        F.size("said").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["own"])).alias("n_masked"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.aggregate("parts", begin, step)["spans"].alias("masks"),
    )


def rotate_flat(turns: DataFrame, part_rows: int | None = None) -> DataFrame:
    """``rotate`` with masks as text (``start-end`` joined by commas), for comparison with SQL."""
    span = F.transform("masks", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string")))
    return rotate(turns, part_rows=part_rows).withColumn("masks", F.array_join(span, ","))



def oracle_sql(part_rows: int = PART_ROWS) -> str:
    """The same renderings by SQL alone."""
    return f"""
WITH r AS (SELECT conv_id, CAST(floor(turn / {BLOCK_TURNS}.0) AS BIGINT) AS block, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations),
n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, block ORDER BY turn, speaker, body) - 1) // {part_rows} AS part FROM r),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r),
m AS (SELECT n.conv_id, block, part, perspective, turn, speaker, body, speaker = perspective AS own,
  CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user:' || speaker || '|>' || chr(10) END AS head, body || '<|end|>' || chr(10) AS tail
  FROM n JOIN people p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, perspective, block, part ORDER BY turn, speaker, body ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM m)
SELECT conv_id, perspective, block, part, count(*)::INT AS n_turns, count(*) FILTER (WHERE own)::INT AS n_masked,
  string_agg(head || tail, '' ORDER BY turn, speaker, body) AS rendered,
  coalesce(string_agg((stop - length(tail))::VARCHAR || '-' || stop::VARCHAR, ',' ORDER BY stop) FILTER (WHERE own), '') AS masks
FROM o GROUP BY conv_id, perspective, block, part
"""


ORACLE_SQL = oracle_sql()
