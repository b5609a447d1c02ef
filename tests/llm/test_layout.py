"""Sharding, chat, media and token storage."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import chat, sharding, tiff, token_store
from lumenfold.llm.common import scratch_path

from .conftest import DOCS, duck, prose, same

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# Sharding


def test_shards_are_even_and_slots_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 50)
    rows = [(i, prose(i % 900 if i % 3 else 0, 5 + i % 40), "en" if i % 3 else "de", "s", 1) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS)).toPandas()
    per = got.groupby("shard").agg(n=("slot", "size"), low=("slot", "min"), high=("slot", "max"), kinds=("slot", "nunique"), b=("size", "sum"))
    assert list(per.index) == list(range(16)) and (per.low == 0).all() and (per.high == per.n - 1).all() and (per.kinds == per.n).all()
    assert per.b.max() <= 1.06 * per.b.mean()
    text = {r[0]: r[1] for r in rows}
    assert all(s == len(text[d].encode()) + 1 and c == zlib.crc32(text[d].encode()) for d, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()


def test_a_hot_text_is_split_others_stay_together(spark):
    rows = [(i, prose(1, 30) if i % 3 == 0 else prose(i % 400, 30), "en", "s", 1) for i in range(2400)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sharding.shard(docs).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    assert got.groupby("shard")["size"].sum().max() <= 1.1 * got["size"].sum() / 16
    spread = got.groupby("text").shard.nunique().sort_values()
    assert spread.iloc[-1] > 1 and (spread.iloc[:-1] == 1).mean() > 0.9


def test_shard_odd_tables(odd, clashing, empty):
    for docs in (odd, clashing):
        got = sharding.shard(docs).toPandas()
        assert len(got) == docs.count() and got.shard.between(0, 15).all()
        assert got[got.doc_id == 0]["size"].tolist() == [1] and got[got.doc_id == 0].text_crc32.tolist() == [0]
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert sharding.shard(empty).count() == 0
    assert sharding.shard(odd, leaves=None, target_bytes=1 << 30).select("shard").distinct().count() == 1


# Chat


def turns(spark):
    said = [(1, 0, "ann", "hi"), (1, 1, "bob", "hey\nyou"), (1, 2, "ann", ""), (1, 2, "ann", None), (1, 70, "cy", "late"), (2, 0, None, "x"), (None, 1, "ann", "n"), (3, None, "bob", "é日"), (1, 1, "bob", "hey\nyou")]
    return spark.createDataFrame(said, "conv_id long, turn long, role string, text string")


def test_chat_equals_sql(spark):
    df = turns(spark)
    got = chat.rotate_flat(df.withColumn("said", F.lit(1)).withColumn("perspective", F.lit("own"))).toPandas()
    same(got, duck({"conversations": df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})}, chat.ORACLE_SQL))
    assert chat.rotate(df.where("false")).count() == 0


def test_crowded_turns_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "hot_limit", lambda rows: 20)
    said = [(1, 3, "ann", "again")] * 60 + [(1, 3, f"p{i % 3}", f"m{i % 40}") for i in range(90)] + [(1, i, "bob", "t") for i in range(0, 400, 7)]
    said += [(2, None, "ann", f"n{i}") for i in range(50)] + [(None, None, None, None)] * 45 + [(None, 1, "cy", "x"), (3, 0, "bob", "only")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.rotate_flat(df, part_rows=16).toPandas()
    same(got, duck({"conversations": df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})}, chat.oracle_sql(16)))
    assert got.n_turns.max() == 16 and got.part.max() > 3


def test_masks_cover_the_speaker(spark):
    for r in chat.rotate(turns(spark)).collect():
        spans = [r["rendered"][m["start"] : m["end"]] for m in r["masks"]]
        assert all(s.endswith("<|end|>\n") for s in spans) and len(spans) == r["n_masked"] == r["rendered"].count("<|assistant|>\n")
        assert f"<|user:{r['perspective']}|>" not in r["rendered"]


# TIFF


def images():
    rng = np.random.default_rng(1)
    return [rng.integers(0, k, (h, w, d), dtype=np.uint8) for h, w, d, k in ((1, 1, 1, 256), (130, 70, 1, 3), (33, 17, 3, 256), (257, 64, 4, 2))]


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, 16, 64])
def test_round_trip(compression, predictor, tile):
    for order in "<>":
        found = list(tiff.read_tiff(tiff.write_tiff(images(), compression, predictor, tile, order=order)))
        assert len(found) == 4 and all((a == b.samples).all() for a, b in zip(images(), found, strict=True))


def test_codecs():
    rng = np.random.default_rng(2)
    for n in (0, 1, 127, 128, 129, 5000, 70_000):
        for k in (1, 2, 256):
            d = rng.integers(0, k, n, dtype=np.uint8).tobytes()
            assert tiff.unlzw(tiff.lzw(d), n) == d and tiff.unpackbits(tiff.packbits(d), n) == d
    # Known codes: runs, literals, and a table that grows.
    assert tiff.unpackbits(bytes.fromhex("fe aa 02 80 00 2a fd aa 03 80 00 2a 22 f7 aa"), 24) == bytes.fromhex("aa aa aa 80 00 2a aa aa aa aa 80 00 2a 22" + " aa" * 10)
    assert tiff.unlzw(bytes.fromhex("80 01 e0 40 80 44 08 0c 06 80 80".replace(" ", "")), 4) == tiff.unlzw(bytes.fromhex("8001e040804408 0c068080"), 4)


def test_pages_and_broken_files(spark):
    good = tiff.write_tiff(images())
    loop = bytearray(tiff.write_tiff(images()[:1]))
    loop[-4:] = loop[4:8]  # the chain leads back to its start
    rows = [(1, good, "x"), (2, None, "x"), (3, b"", "x"), (4, b"II*\0\xff\xff\xff\xff", "x"), (5, good[: len(good) - 30], "x"), (6, bytes(loop), "x"), (7, b"not a tiff at all", "x")]
    got = tiff.read_pages(spark.createDataFrame(rows, "id long, media binary, page string")).select("id", "page", "tiff_page.error", F.col("tiff_page.page").alias("n"), "tiff_page.samples").toPandas()
    assert len(got[got.id == 1]) == 4 and got[got.id == 1].error.isna().all() and set(got.page) == {"x"}
    assert len(got[got.id == 2]) == 0 and len(got[got.id == 6]) == 1
    assert all(got[got.id == k].error.notna().sum() == 1 for k in (3, 4, 5, 7))
    assert bytes(got[(got.id == 1) & (got.n == 3)].samples.iloc[0]) == images()[2].tobytes()


def test_text_media(clashing, odd_rows, empty):
    got = tiff.text_media(clashing).toPandas()
    want = sorted((r[0], r[1] or "") for r in odd_rows if r[0] is not None)
    for (d, text), (_, r) in zip(want, got[got.doc_id.notna()].sort_values(["doc_id", "n_bytes"]).iterrows(), strict=True):
        payload = tiff.payload_of(text.encode())
        assert (d, len(text.encode()), len(payload)) == (r.doc_id, r.n_bytes, r.payload_bytes) and len(payload) % 64 == 0 < len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(m := tiff.store_text(text.encode())), hashlib.sha256(m).hexdigest())
    assert tiff.text_media(empty).count() == 0
    assert {p.compression for p in tiff.read_tiff(tiff.store_text(b"x" * 200_000))} == {tiff.DEFLATE} and len(list(tiff.read_tiff(tiff.store_text(b"x" * 200_000)))) == 4


# Tokens


def test_ids_equal_whole_text_encoding(clashing, odd_rows, empty):
    got = token_store.tokenize_and_index(clashing, TOKENIZER).toPandas()
    texts = sorted((r for r in odd_rows if r[0] is not None), key=lambda r: r[0])
    ids = token_store.whole_text_ids([r[1] for r in texts], TOKENIZER)
    start = sum(got[got.doc_id.isna()].n_tokens)
    for (_, row), one, r in zip(got[got.doc_id.notna()].sort_values(["doc_id", "start"]).iterrows(), ids, texts, strict=True):
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (r[0], start, len(one), zlib.crc32(np.array(one, "<u4").tobytes()))
        start += len(one)
    assert token_store.tokenize_and_index(empty, TOKENIZER).count() == 0


def test_pieces_equal_whole_texts():
    """Every printable character of many scripts, alone and joined, and contractions."""
    own = token_store.encoder(TOKENIZER)
    assert isinstance(own, token_store.PieceEncoder)
    chars = [chr(c) for c in [*range(1, 0x600), *range(0x900, 0x980), 0x1680, 0x180E, *range(0x1E00, 0x2100), *range(0x3000, 0x3100), 0x1F600, 0x1F468] if not 0xD800 <= c < 0xE000]
    texts = chars + [f"a{c}b" for c in chars] + [f"A{c} {c}'s" for c in chars] + ["It's WE'RE i'D don't 12,5% x--y !!'s ...", "é ́ Å", "a<|endoftext|>b <|startoftext|>", "ÀÉîöß ŁódŹ ŒŸĲſŉİ", prose(1, 3000), "", None, "  ", " a ", "x" * 5000]
    whole = token_store.whole_text_ids(texts, TOKENIZER)
    for _ in range(2):  # the second time from memory
        ids, sizes = own.encode_batch(pa.array(texts), 2)
        stops = np.cumsum(sizes)
        for t, want, a, b in zip(texts, whole, stops - sizes, stops, strict=True):
            assert ids[a:b].tolist() == want, repr(t)
    ids, sizes = own.encode_batch(pa.array([], pa.string()), 2)
    assert len(ids) == len(sizes) == 0
    other = token_store.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert type(other) is token_store.TextEncoder


def test_recent_forgets_what_is_not_used():
    memory = token_store.Recent(3)
    for k in range(9):
        memory.add({f"k{k}": b"x"})
        assert memory.get_all(["k0"])[0] == [b"x"] and len(memory.young) + len(memory.old) <= 8
    assert memory.get_all(["k0", "k1", "k8"])[1] == [1]


def test_a_tokenizer_that_does_not_cut_at_blanks(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a  b\n\nc", "  lead", None, "It's  12 %"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["ids_crc32"] for r in token_store.tokenize_and_index(docs, path, 50256).orderBy("doc_id").collect()]
    assert got == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in token_store.whole_text_ids(texts, path, 50256)]


def test_files_are_ordered_and_pruned(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(12_000)], "doc_id long, text string").repartition(5)
    path = scratch_path(spark, "test-tokens")
    monkeypatch.setattr(token_store, "STRIPE_BYTES", 1 << 16)
    token_store.write_tokens(docs, path, TOKENIZER, 2)
    stored = token_store.read_tokens(spark, path)
    per_file = sorted((r["low"], r["high"]) for r in stored.groupBy(F.input_file_name()).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect())
    assert all(a[1] < b[0] for a, b in zip(per_file, per_file[1:], strict=False))
    plan = stored.where("doc_id = 77")
    assert len(plan.collect()) == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in plan._jdf.queryExecution().toString()
    # The scan gives the one row group that can hold the id, no more.
    scan = plan._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert 0 < scan.metrics().apply("numOutputRows").value() <= token_store.ROW_GROUP
    assert all(r["ids"][-1] == 2 for r in stored.select("ids").take(20))


def test_stripes_have_indexes_and_filters(spark, monkeypatch):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = scratch_path(spark, "test-stripes")
    monkeypatch.setattr(token_store, "STRIPE_BYTES", 1 << 16)
    token_store.write_tokens(spark.createDataFrame([(i, prose(i, 60)) for i in range(12_000)], "doc_id long, text string").coalesce(1), path, TOKENIZER, 2)
    files = [f for f in jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).listStatus(jvm.org.apache.hadoop.fs.Path(path)) if f.getPath().getName().endswith(".orc")]
    stripes = 0
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f.getPath(), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == token_store.ROW_GROUP
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            kinds = {(s.getKind().toString(), s.getColumn()) for s in footer.getStreamsList()}
            assert ("BLOOM_FILTER_UTF8", 1) in kinds and ("ROW_INDEX", 1) in kinds and not any(k.startswith("BLOOM") and c != 1 for k, c in kinds)
            assert {c.getKind().toString() for c in footer.getColumnsList()} <= {"DIRECT", "DIRECT_V2"}
            stripes += 1
        rows.close()
    assert stripes > len(files)


def test_repeated_rows_and_ids_take_their_places(spark):
    """One row many times fills several files; rows of one id stand by text; starts are places in the files."""
    rows = [(5, "the same words again")] * 3000 + [(7, prose(i, 6)) for i in range(50)] + [(None, "none here")] * 40 + [(9, None), (1, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    path = scratch_path(spark, "test-repeats")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_store.write_tokens(docs, path, TOKENIZER, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = token_store.read_tokens(spark, path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "*").orderBy("at").collect()
    assert len({r["file"] for r in stored if r["doc_id"] == 5}) > 1
    by_file = {}
    for r in stored:
        by_file.setdefault(r["file"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0, r["text_hash"]), r["ids"]))
    files = sorted(by_file.values(), key=lambda f: (f[0][0], f[-1][0]))
    in_order = [row for f in files for row in f]
    assert [k for k, _ in in_order] == sorted(k for k, _ in in_order)
    starts = np.cumsum([0, *(len(ids) for _, ids in in_order)])
    want = sorted((int(s), k[1] if k[0] else -1, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for s, (k, ids) in zip(starts, in_order, strict=False))
    got = sorted((r["start"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.token_index(spark, path).collect())
    assert got == want


def test_sources_of_one_long_common_prefix(spark):
    """Whole names decide: a cut can lie between names that agree in all but their last letter."""
    prefix = "common_crawl_of_the_year_2020_part_"
    rows = [(i, f"word {i:03d} and some more", "en", prefix + "abcd"[i % 4], 1) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    table = sharding.ranks(docs, "lang", "source")["source"]
    assert [(r["value"], r["rank"] - min(x["rank"] for x in table.collect())) for r in table.orderBy("rank").collect()] == [(prefix + c, k) for k, c in enumerate("abcd")]
    got = sharding.shard(docs, leaves=4).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert got.groupby("shard")["size"].sum().max() <= 1.1 * got["size"].sum() / 4
    assert [sorted({v[-1] for v in g.source}) for _, g in got.groupby("shard")] == [["a", "b"]] * 2 + [["c", "d"]] * 2


def test_ranks_of_many_values(spark):
    rng = random.Random(6)
    values = [None, "", "é", "Z", "a"] + [f"s{rng.randrange(10**6)}" for _ in range(3000)]
    df = spark.createDataFrame([(v, "x") for v in values], "source string, lang string")
    got = {r["value"]: r["rank"] for r in sharding.ranks(df.repartition(7), "lang", "source")["source"].collect()}
    ordered = sorted({v or "" for v in values}, key=lambda v: v.encode())
    assert sorted(got, key=got.get) == ordered and got[""] == 0 and len(set(got.values())) == len(ordered)
