"""Tokenizer interface: ids and character spans, chat rendering, trained-token masks.

A tokenizer is any function of a text that returns (ids, spans). It runs in an
Arrow function per batch and is built once per worker from its factory, so
tokenizers that load files work as well as the built-in one, which needs none.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.sources.storage import content_hash

Tokenizer = Callable[[str], tuple[list[int], list[tuple[int, int]]]]
_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
TOKENS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("spans", T.ArrayType(_SPAN))])


def word_tokenizer(vocabulary: int = 1 << 16) -> Tokenizer:
    """Words, numbers, single marks and runs of blanks; ids are hashes, so every character is in one token."""
    pattern = re.compile(r"\w+|\s+|[^\w\s]")

    def tokenize(text: str) -> tuple[list[int], list[tuple[int, int]]]:
        found = list(pattern.finditer(text))
        return [zlib.crc32(m.group().encode()) % vocabulary for m in found], [m.span() for m in found]

    return tokenize


#: Tokens that are Python objects at a time.
TOKENS_HELD = 1 << 15


def _tokens_of(tokenizer: Tokenizer, texts: pa.Array) -> pa.Array:
    """Ids and spans of each text; they are Arrow's after TOKENS_HELD tokens, so that no batch is held as objects."""
    parts, lengths, places = [], [0], [0]
    ids, starts, ends = [], [], []
    for i in range(len(texts)):
        own, spans = tokenizer(texts[i].as_py() or "")
        ids.extend(own)
        starts.extend(a for a, _ in spans)
        ends.extend(z for _, z in spans)
        lengths.append(lengths[-1] + len(own))
        places.append(places[-1] + len(spans))
        if len(ids) >= TOKENS_HELD or i + 1 == len(texts):
            parts.append([pa.array(x, pa.int32()) for x in (ids, starts, ends)])
            ids, starts, ends = [], [], []
    flat = [pa.concat_arrays(x) for x in zip(*parts, strict=True)] or [pa.array([], pa.int32())] * 3
    spans = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.StructArray.from_arrays(flat[1:], names=["start", "end"]))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), flat[0]), spans], names=["ids", "spans"])


def tokenize(factory: Callable[[], Tokenizer] = word_tokenizer):
    """A column function: text -> struct(ids, spans); null is empty."""
    made: list[Tokenizer] = []

    @F.arrow_udf(TOKENS)
    def run(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(factory())
        return _tokens_of(made[0], texts)

    return run


def render_chat(messages: Column, answer_next: bool = False) -> Column:
    """Messages (array of struct(role, content)) in the plain chat template."""
    said = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("<|end|>\n"))), "")
    return F.concat(said, F.lit("<|assistant|>\n")) if answer_next else said


def chat_segments(messages: Column) -> Column:
    """array of struct(start, end, role): where each message's content stands in its rendering."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,role:string>>").alias("found"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["role"]) + 5
        end = start + F.length(m["content"])
        return F.struct((end + 8).alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), m["role"].alias("role")))).alias("found"))

    return F.aggregate(messages, begin, step)["found"]


def tokenize_chat(rows: DataFrame, factory: Callable[[], Tokenizer] = word_tokenizer) -> DataFrame:
    """Adds input_ids, spans, segments and assistant_mask to rows of messages.

    A token is trained if it lies wholly inside an assistant message.
    """
    shown = rows.withColumn("rendered", render_chat(F.col("messages"))).withColumn("segments", chat_segments(F.col("messages")))
    cut = shown.withColumn("tokens", tokenize(factory)("rendered"))
    inside = lambda s: F.exists("segments", lambda g: (g["role"] == "assistant") & (g["start"] <= s["start"]) & (s["end"] <= g["end"]))
    return cut.select("*", F.col("tokens.ids").alias("input_ids"), F.col("tokens.spans").alias("spans"), F.transform("tokens.spans", lambda s: inside(s).cast("int")).alias("assistant_mask")).drop("tokens")


def align_messages(rows: DataFrame, factory: Callable[[], Tokenizer] = word_tokenizer, special: tuple[int, ...] = (), direct: Callable[[], Tokenizer] | None = None) -> DataFrame:
    """Adds ``alignment``: total, content, control, special and cross-segment tokens of each row of messages.

    Content tokens lie wholly inside one message and are not special; all
    others are control tokens, and those that reach over a message's border
    are counted as crossing too. ``direct`` is the tokenizer whose ids are
    authoritative: a row for which the two streams differ raises.
    """
    cut = tokenize_chat(rows, factory)
    if direct is not None:
        same = tokenize(direct)("rendered")["ids"] == F.col("input_ids")
        cut = cut.withColumn("input_ids", F.when(same, F.col("input_ids")).otherwise(F.raise_error(F.lit("the direct and the offset token stream differ"))))
    marks = F.array(*map(F.lit, special)).cast("array<int>")
    touched = lambda s: F.exists("segments", lambda g: (g["start"] < s["end"]) & (s["start"] < g["end"]))
    inside = lambda s: F.exists("segments", lambda g: (g["start"] <= s["start"]) & (s["end"] <= g["end"]))
    kinds = F.zip_with("input_ids", "spans", lambda i, s: F.struct(F.array_contains(marks, i).alias("special"), inside(s).alias("inside"), touched(s).alias("touched")))
    count = lambda f: F.size(F.filter("kinds", f))
    content = count(lambda k: k["inside"] & ~k["special"])
    found = cut.withColumn("kinds", kinds)
    return found.withColumn("alignment", F.struct(F.size("kinds").alias("total_tokens"), content.alias("content_tokens"), (F.size("kinds") - content).alias("control_tokens"), count(lambda k: k["special"]).alias("special_tokens"), count(lambda k: k["touched"] & ~k["inside"] & ~k["special"]).alias("crossing_tokens"))).drop("kinds")


class CapabilityError(ValueError):
    """A tokenizer lacks what its use requires."""


@dataclass(frozen=True)
class Requirements:
    """What a cache needs of its tokenizer."""

    offsets: bool = True
    assistant_mask: bool = True
    deterministic: bool = True

    def for_plain_text(self) -> Requirements:
        """The same for texts without turns: every token is trained, so nobody's words have to be told apart."""
        return replace(self, assistant_mask=False)

    def check(self, able: dict[str, bool]) -> None:
        """Names everything that is required and missing."""
        missing = [name for name, wanted in asdict(self).items() if wanted and not able.get(name)]
        if missing:
            raise CapabilityError("the tokenizer lacks: " + ", ".join(missing))


#: A short conversation in the chat template, and where its answer stands.
_CHAT = "<|user|>\nHello<|end|>\n<|assistant|>\nHi é<|end|>\n"
_ANSWER = (_CHAT.index("Hi é"), _CHAT.index("Hi é") + 4)


def capabilities(factory: Callable[[], Tokenizer] = word_tokenizer, probe: str = "a1 é!\n") -> dict[str, bool]:
    """What a tokenizer can do, tried on probes; one that fails on them can do nothing."""
    try:
        tokenizer, other = factory(), factory()
        ids, spans = tokenizer(probe)
        chat_ids, chat = tokenizer(_CHAT)
        sound = len(ids) == len(spans) and all(0 <= a <= b <= len(probe) for a, b in spans)
        inside = [(a, b) for a, b in chat if a < _ANSWER[1] and b > _ANSWER[0]]
        return {
            "offsets": sound, "lossless": "".join(probe[a:b] for a, b in spans) == probe, "deterministic": other(probe) == (ids, spans) == tokenizer(probe),
            # an answer's tokens can be told from the template's if none reaches across its ends
            "assistant_mask": sound and len(chat_ids) == len(chat) and bool(inside) and all(_ANSWER[0] <= a and b <= _ANSWER[1] for a, b in inside),
        }
    except Exception:  # a library of any kind stands behind the interface
        return dict.fromkeys(("offsets", "lossless", "deterministic", "assistant_mask"), False)


def tokenizer_manifest(name: str, revision: str, factory: Callable[[], Tokenizer] = word_tokenizer, vocabulary: int | None = None, special: dict[str, int] | None = None, template: str | None = None, required: Requirements | None = None) -> dict[str, object]:
    """What caches that must agree record of their tokenizer, sealed; its revision must be pinned and its requirements met."""
    if not revision:
        raise ValueError("a tokenizer's revision must be pinned")
    able = capabilities(factory)
    (required or Requirements()).check(able)
    manifest = {"name": name, "revision": revision, "vocabulary": vocabulary, "special_tokens": special or {}, "template_sha256": template and hashlib.sha256(template.encode()).hexdigest(), "capabilities": able, "probe_ids": content_hash(factory()(_CHAT)[0])}
    return manifest | {"content_hash": content_hash(manifest)}
