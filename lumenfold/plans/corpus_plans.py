"""Queries over documents: splits, text, tokens, n-grams, alignment, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import hashing, text
from lumenfold.operators import alignment, clusters, corpus, integrity, occurrences, sequences
from lumenfold.operators import token_features as token_features_of
from lumenfold.plans.base import query, table
from lumenfold.sources.storage import broadcast_if_small, checkpoint

_HASH = "sha256('[\"cpt-split-v1\",\"' || doc_id || '\"]')"
_SPLIT = f"CASE WHEN ('0x' || substr({_HASH}, 1, 8))::UBIGINT % 100 < 10 THEN 'validation' ELSE 'train' END"


@query(f"SELECT source, {_SPLIT} AS split, count(*) AS records, sum(length(text))::BIGINT AS characters FROM documents GROUP BY ALL")
def corpus_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.source_summary(table(spark, sf_dir, "documents"))


@query(f"WITH s AS (SELECT *, {_SPLIT} AS split FROM documents) SELECT count(*) AS records, count(*) FILTER (WHERE split = 'train') AS train_records, count(*) FILTER (WHERE split = 'validation') AS validation_records, sum(length(text))::BIGINT AS characters FROM s")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_totals(table(spark, sf_dir, "documents"))


# Blanks of many kinds are put in first, so that the rules act.
_ODD = "(chr(8232) || ' ' || replace(coalesce(text, ''), ', ', ',' || chr(13) || chr(10) || chr(12288) || chr(9) || ' ' || chr(8232) || ' ') || chr(133) || chr(28) || chr(10) || chr(10))"
_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(@ODD, chr(0), ''), '\r\n?', chr(10), 'g'), '[\t\f\v ]+', ' ', 'g'), '(?m)^[\t\v-\r\x{1c}-\x{20}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+|[\t\v-\r\x{1c}-\x{20}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')".replace("@ODD", _ODD)


@query(f"SELECT doc_id, sha256({_NORMAL}) AS text_hash, length({_NORMAL}) AS characters FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat(F.lit("\u2028 "), F.replace(F.coalesce("text", F.lit("")), F.lit(", "), F.lit(",\r\n\u3000\t \u2028 ")), F.lit("\x85\x1c\n\n"))
    clean = text.normalize_lines(odd)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(clean, 256).alias("text_hash"), F.length(clean).cast("long").alias("characters"))


@query("SELECT doc_id, sha256(nfc_normalize(coalesce(text, ''))) AS text_hash FROM documents")
def normalize_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width letters are put in first; compatibility normalisation gives the plain ones back."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.nfkc(F.translate(F.coalesce("text", F.lit("")), "abcXYZ17", "ａｂｃＸＹＺ１７")), 256).alias("text_hash"))


@query("""SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS total, round(avg(length(text)), 6) AS mean, median(length(text)) AS median, quantile_disc(length(text), 0.9)::BIGINT AS p90,
  quantile_disc(length(text), 0.95)::BIGINT AS p95, quantile_disc(length(text), 0.99)::BIGINT AS p99, max(length(text))::BIGINT AS maximum FROM documents GROUP BY lang""")
def length_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("chars"))
    return corpus.length_statistics(docs, "chars", "lang").withColumn("mean", F.round("mean", 6))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exact_duplicates(table(spark, sf_dir, "documents"))


@query(f"SELECT sha256(text) AS key, array_to_string(list_sort(list(DISTINCT {_SPLIT})), ',') AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT {_SPLIT}) > 1")
def content_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = corpus.leakage(docs, F.sha2("text", 256), hashing.record_split(F.col("doc_id").cast("string")))
    return found.withColumn("splits", F.array_join("splits", ","))


_TOKEN = text.TOKEN.replace("'", "''")
_TOKENS = f"SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKEN}')) AS surface FROM documents"
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for k, p in (("money", text.MONEY), ("percent", text.PERCENT), ("date", text.DATE), ("tax_year", text.YEAR), ("form_like", text.FORM), ("number", text.NUMBER))) + " ELSE 'word' END"
_KEY = f"CASE WHEN {_CLASS} IN ('money', 'percent', 'date', 'number') THEN '<' || {_CLASS} || '>' ELSE s END"


@query(f"SELECT doc_id, count(*) AS n_tokens, sha256(string_agg(surface, chr(1) ORDER BY n)) AS tokens_hash FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKEN}')) AS surface, generate_subscripts(regexp_extract_all(text, '{_TOKEN}'), 1) AS n FROM documents) GROUP BY doc_id")
def lexical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", "\x01"), 256).alias("tokens_hash"))


_PIECES = f"SELECT doc_id, unnest(regexp_extract_all(text, '(?s){_TOKEN}|{text.GAP}|.')) AS surface, generate_subscripts(regexp_extract_all(text, '(?s){_TOKEN}|{text.GAP}|.'), 1) AS piece FROM documents"
_SPANS = f"""WITH p AS ({_PIECES}), q AS (SELECT *, regexp_full_match(surface, '{_TOKEN}') AS is_token FROM p),
r AS (SELECT *, (coalesce(sum(length(surface)) OVER w, 0))::INT AS start_char, (coalesce(sum(CASE WHEN NOT is_token AND regexp_matches(surface, '{text.BREAK}') THEN 1 ELSE 0 END) OVER w, 0))::INT AS run,
  (coalesce(sum(is_token::INT) OVER w, 0))::INT AS ord FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT doc_id, ord, surface, start_char, start_char + length(surface) AS end_char, run FROM r WHERE is_token)"""


@query(f"{_SPANS} SELECT doc_id, count(*) AS n_tokens, sum(start_char)::BIGINT AS starts, sum(end_char)::BIGINT AS ends, max(run) AS runs FROM t GROUP BY doc_id")
def lexical_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = text.token_spans(table(spark, sf_dir, "documents"))
    return spans.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum("start_char").alias("starts"), F.sum("end_char").alias("ends"), F.max("run").alias("runs"))


def _surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct canonical surfaces with their counts: later steps work once per surface."""
    return text.surface_counts(table(spark, sf_dir, "documents")).withColumn("surface", text.canonical_surface(F.col("raw")))


@query(f"SELECT {_CLASS} AS token_class, {_KEY} AS key, count(*) AS n FROM (SELECT lower(surface) AS s FROM ({_TOKENS})) GROUP BY ALL")
def atom_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("surface")
    return _surfaces(spark, sf_dir).groupBy(text.atom_class(s).alias("token_class"), text.atom_key(s).alias("key")).agg(F.sum("n").alias("n"))


_ALIASES = f"""CASE WHEN {_CLASS} = 'form_like' THEN CASE WHEN regexp_replace(s, '[-_\\s]', '', 'g') <> s THEN [regexp_replace(s, '[-_\\s]', '', 'g')] ELSE [] END WHEN {_CLASS} <> 'word' THEN []
  WHEN contains(s, '_') THEN string_split(s, '_') WHEN contains(s, '/') THEN string_split(s, '/') WHEN contains(s, '-') AND regexp_matches(s, '[a-z]') THEN string_split(s, '-') ELSE [] END"""


@query(f"SELECT alias, sum(n)::BIGINT AS n FROM (SELECT s, n, unnest(list_distinct(list_filter({_ALIASES}, lambda x: x <> ''))[1:4]) AS alias FROM (SELECT lower(surface) AS s, count(*) AS n FROM ({_TOKENS}) GROUP BY 1)) GROUP BY 1")
def atom_alias_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surfaces(spark, sf_dir).select(F.explode(text.atom_aliases(F.col("surface"))).alias("alias"), "n").groupBy("alias").agg(F.sum("n").alias("n"))


@query(f"""{_SPANS}, k AS (SELECT doc_id, ord, run, {_KEY} AS key FROM (SELECT *, lower(surface) AS s FROM t)),
g AS (SELECT doc_id, ord, run, key AS k1, lead(key, 1) OVER w AS k2, lead(key, 2) OVER w AS k3, lead(key, 3) OVER w AS k4 FROM k WINDOW w AS (PARTITION BY doc_id, run ORDER BY ord))
SELECT n AS "order", key, count(*) AS "count" FROM (SELECT 1 AS n, k1 AS key FROM g UNION ALL SELECT 2, k1 || ' ' || k2 FROM g WHERE k2 IS NOT NULL UNION ALL SELECT 3, k1 || ' ' || k2 || ' ' || k3 FROM g WHERE k3 IS NOT NULL
  UNION ALL SELECT 4, k1 || ' ' || k2 || ' ' || k3 || ' ' || k4 FROM g WHERE k4 IS NOT NULL) GROUP BY ALL""")
def word_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.gram_counts(table(spark, sf_dir, "documents"))


_ELIGIBLE = f"(length({_KEY}) >= 7 OR regexp_matches({_KEY}, '[0-9]') OR contains({_KEY}, '-') OR contains({_KEY}, '/')) AND length({_KEY}) <= 64 AND NOT starts_with({_KEY}, '<')"


@query(f"""WITH s AS (SELECT lower(surface) AS s, count(*) AS n FROM ({_TOKENS}) GROUP BY 1), e AS (SELECT s, n FROM s WHERE {_ELIGIBLE}),
g AS (SELECT k AS "order", n, unnest(list_transform(range(greatest(length(s) - k + 1, 0)), lambda i: substr(s, (i + 1)::INT, k))) AS key FROM e, (VALUES (3), (4), (5)) o(k))
SELECT "order", key, sum(n)::BIGINT AS "count" FROM g GROUP BY ALL""")
def char_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _surfaces(spark, sf_dir).groupBy("surface").agg(F.sum("n").alias("n")).withColumn("key", text.atom_key(F.col("surface")))
    grams = s.where(text.char_gram_eligible(F.col("surface"), F.col("key"))).select("n", F.explode(text.char_grams(F.col("key"))).alias("g"))
    return grams.groupBy("g.order", "g.key").agg(F.sum("n").alias("count"))


@query()
def ngram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collision statistics per namespace: each distinct key, canonical or alias, counts once."""
    return token_features_of.bucket_statistics(table(spark, sf_dir, "documents"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus records of the documents, each taken as page 1 of its own source."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.lit(1).alias("page"), "text")
    return corpus.records_of(pages)


_N = r"len(regexp_extract_all(text, '\S+'))"


@query(f"""WITH n AS (SELECT doc_id, {_N} AS n FROM documents), b AS (SELECT doc_id, n, unnest(range(ceil(n / 128.0)::BIGINT)) AS k, ceil(n / 128.0)::BIGINT AS c FROM n WHERE n >= 2),
s AS (SELECT doc_id, CASE WHEN k = c THEN n ELSE k * 128 - CASE WHEN n % 128 = 1 AND n > 128 AND k = c - 1 THEN 1 ELSE 0 END END AS a, CASE WHEN k + 1 = c THEN n ELSE (k + 1) * 128 - CASE WHEN n % 128 = 1 AND n > 128 AND k + 1 = c - 1 THEN 1 ELSE 0 END END AS z FROM b)
SELECT doc_id || '#tok=' || a || ':' || z AS record_id, (z - a)::BIGINT AS token_count FROM s""")
def token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n")).where("n >= 2")
    cut = sized.select("doc_id", F.explode(sequences.blocks(F.col("n"), 128)).alias("b"))
    return cut.select(F.format_string("%d#tok=%d:%d", "doc_id", "b.start", "b.end").alias("record_id"), (F.col("b.end") - F.col("b.start")).alias("token_count"))


@query(f"WITH n AS (SELECT source, {_N} AS n FROM documents) SELECT source, (ceil(max(n) / 8.0) * 8)::INT AS padded, sum(n)::BIGINT AS tokens, round(sum(n) / (count(*) * (ceil(max(n) / 8.0) * 8)), 9) AS utilization FROM n GROUP BY source")
def pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("source", F.regexp_count("text", F.lit(r"\S+")).alias("n"))
    padded = sequences.padded_length(F.max("n"))
    return sized.groupBy("source").agg(padded.alias("padded"), F.sum("n").alias("tokens"), F.round(F.sum("n") / (F.count("*") * padded), 9).alias("utilization"))


@query(f"""{_SPANS}, k AS (SELECT doc_id, ord, run, start_char, end_char, {_KEY} AS key FROM (SELECT *, lower(surface) AS s FROM t)),
b AS (SELECT doc_id, start_char, lead(end_char) OVER w AS end_char, key || ' ' || lead(key) OVER w AS key FROM k WINDOW w AS (PARTITION BY doc_id, run ORDER BY ord)),
f AS (SELECT doc_id, end_char - 1 AS edge, end_char, ('0x' || substr(sha256(key), 1, 6))::INT AS feature_id FROM b WHERE end_char IS NOT NULL),
j AS (SELECT f.doc_id, t.ord AS token_index, f.feature_id FROM f JOIN (SELECT *, unnest(range(start_char // 64, (end_char - 1) // 64 + 1)) AS bin FROM t) t ON f.doc_id = t.doc_id AND f.edge // 64 = t.bin WHERE f.edge >= t.start_char AND f.edge < t.end_char)
SELECT doc_id, count(DISTINCT token_index * 16777216::BIGINT + feature_id) AS aligned, sum(token_index)::BIGINT AS index_sum, sum(feature_id)::BIGINT AS feature_sum FROM j GROUP BY doc_id""")
def range_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pairs aligned to the token that holds their last character."""
    return pair_alignment(table(spark, sf_dir, "documents"))


def pair_alignment(docs: DataFrame) -> DataFrame:
    """(doc_id, aligned, index_sum, feature_sum): each text is aligned within its row; only rows that share an id meet, to count what they have in common once."""
    many = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("shared"))
    same, many = F.col("doc_id").eqNullSafe(F.col("shared")), broadcast_if_small(many)
    index, feature = lambda c: F.shiftright(c, 24), lambda c: c.bitwiseAND(F.lit((1 << 24) - 1))
    total = lambda part: F.aggregate("codes", F.lit(0).cast("long"), lambda acc, c: acc + part(c))
    alone = _pair_codes(docs.join(many, same, "left_anti")).select("doc_id", F.size(F.array_distinct("codes")).cast("long").alias("aligned"), total(index).alias("index_sum"), total(feature).alias("feature_sum"))
    code = F.col("code")
    met = _pair_codes(docs.join(many, same, "left_semi")).select("doc_id", F.explode("codes").alias("code")).groupBy("doc_id").agg(F.count_distinct(code).alias("aligned"), F.sum(index(code)).alias("index_sum"), F.sum(feature(code)).alias("feature_sum"))
    return alone.unionByName(met)


def _pair_codes(docs: DataFrame) -> DataFrame:
    """(doc_id, codes) of each text with word pairs: 2^24 times the token that holds a pair's last character, plus the pair's feature."""
    keyed = text.span_rows(docs).select("doc_id", "spans", F.transform("spans", lambda s: text.atom_key(text.canonical_surface(s["surface"]))).alias("keys"))
    feature = lambda i: F.conv(F.substring(F.sha2(F.concat(F.get("keys", i), F.lit(" "), F.get("keys", i + 1)), 256), 1, 6), 16, 10).cast("int")
    pairs = F.transform("spans", lambda s, i: F.when(F.get("spans", i + 1)["run"] == s["run"], F.struct(F.get("spans", i + 1)["end_char"].alias("end_char"), feature(i).alias("feature_id"))))
    found = keyed.select("doc_id", F.filter(pairs, lambda p: p.isNotNull()).alias("pairs"), F.col("spans.start_char").alias("starts"), F.col("spans.end_char").alias("stops"))
    return alignment.aligned_codes(found.select("doc_id", F.col("pairs.end_char").alias("ends"), F.col("pairs.feature_id").alias("features"), "starts", "stops"), "doc_id")


@query()
def token_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word n-grams, aliases (as single words) and character n-grams of every document, hashed, ranked and cut to the best 24 per token."""
    top = token_features_of.token_features(table(spark, sf_dir, "documents"))
    return top.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum(F.size("feature_ids")).alias("selected"), F.sum("dropped").cast("long").alias("dropped"), F.count_if(F.col("dropped") > 0).alias("hitting_cap"))


_OCCURRENCES = f"""{_SPANS}, k AS (SELECT doc_id, ord, run, start_char, end_char, s, {_KEY} AS key FROM (SELECT *, lower(surface) AS s FROM t)),
g AS (SELECT *, lead(key, 1) OVER w AS k2, lead(key, 2) OVER w AS k3, lead(key, 3) OVER w AS k4, lead(end_char, 1) OVER w AS e2, lead(end_char, 2) OVER w AS e3, lead(end_char, 3) OVER w AS e4 FROM k WINDOW w AS (PARTITION BY doc_id, run ORDER BY ord)),
o AS (SELECT doc_id, 'word' AS kind, 1 AS n, key, start_char, end_char, false AS alias FROM k
  UNION ALL SELECT doc_id, 'word', 1, unnest(list_distinct(list_filter({_ALIASES}, lambda x: x <> ''))[1:4]), start_char, end_char, true FROM k
  UNION ALL SELECT doc_id, 'word', 2, key || ' ' || k2, start_char, e2, false FROM g WHERE k2 IS NOT NULL
  UNION ALL SELECT doc_id, 'word', 3, key || ' ' || k2 || ' ' || k3, start_char, e3, false FROM g WHERE k3 IS NOT NULL
  UNION ALL SELECT doc_id, 'word', 4, key || ' ' || k2 || ' ' || k3 || ' ' || k4, start_char, e4, false FROM g WHERE k4 IS NOT NULL
  UNION ALL SELECT doc_id, 'char', m, substr(s, i + 1, m), start_char + i, start_char + i + m, false FROM (SELECT *, unnest(range(greatest(length(s) - m + 1, 0)))::INT AS i FROM k, (VALUES (3), (4), (5)) v(m) WHERE {_ELIGIBLE}))"""


@query(f"{_OCCURRENCES} SELECT doc_id, count(*) FILTER (WHERE kind = 'word' AND n = 1) AS lexical_tokens, count(*) FILTER (WHERE alias) AS alias_tokens, count(*) FILTER (WHERE kind = 'word') AS word_occurrences, count(*) FILTER (WHERE kind = 'char') AS char_occurrences FROM o GROUP BY doc_id")
def extraction_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.text_statistics(table(spark, sf_dir, "documents"))


@query(f"""{_OCCURRENCES}, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_char, end_char, kind, n, key, alias) - 1 AS place FROM o)
SELECT doc_id, max(place) AS last_place, sum((place * end_char + n) % 1000003)::BIGINT AS place_digest, sum((place + 1) * (('0x' || substr(sha256(key), 1, 4))::INT) % 1000003)::BIGINT AS key_digest FROM placed GROUP BY doc_id""")
def ordered_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all n-grams of a document in reading order, as digests of place, offsets and key."""
    return occurrences.place_digests(table(spark, sf_dir, "documents"))


@query(f"{_SPANS}, k AS (SELECT doc_id, start_char, end_char, lower(surface) AS s FROM t) SELECT doc_id, a AS key, start_char, end_char::INT AS end_char FROM (SELECT doc_id, start_char, end_char, unnest(list_distinct(list_filter({_ALIASES}, lambda x: x <> ''))[1:4]) AS a FROM k)")
def alias_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias tokens with the offsets of the words they stand for."""
    return occurrences.lexical(table(spark, sf_dir, "documents")).where("alias").select("doc_id", "key", "start_char", "end_char")


@query("""SELECT doc_id AS source_id, CASE WHEN doc_id % 5 = 0 THEN 'SRC-MISSING-RAW' ELSE 'SRC-HASH-MISMATCH' END AS code, CASE WHEN doc_id % 5 = 0 THEN 'ERROR' ELSE 'FATAL' END AS severity
FROM documents WHERE doc_id % 5 = 0 OR (doc_id % 7 = 1 AND doc_id % 3 <> 0)""")
def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of all documents as files: every fifth is missing, others changed; changed ones without a known hash pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("raw/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("h"))
    known = F.when(F.col("doc_id") % 3 != 0, F.upper("h")).when(F.col("doc_id") % 2 == 0, F.lit("REPLACE_ME"))
    registry = docs.select(F.col("doc_id").alias("source_id"), F.col("path").alias("raw_path"), known.alias("sha256"))
    actual = docs.where("doc_id % 5 != 0").select("path", F.when(F.col("doc_id") % 7 == 1, F.sha2("h", 256)).otherwise(F.col("h")).alias("sha256"))
    return integrity.audit_sources(registry, actual)


@query("""WITH RECURSIVE k AS (SELECT doc_id, source || ':' || lang || ':' || (n_chars // 40) AS a, sha256(text) AS b FROM documents),
e AS (SELECT x.doc_id AS u, y.m AS v FROM k x JOIN (SELECT a, min(doc_id) AS m FROM k GROUP BY a) y USING (a) UNION SELECT x.doc_id, y.m FROM k x JOIN (SELECT b, min(doc_id) AS m FROM k GROUP BY b) y USING (b)),
l AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT doc_id AS n, doc_id AS c FROM k UNION SELECT l.v, r.c FROM r JOIN l ON r.n = l.u WHERE r.c < l.v),
m AS (SELECT n AS doc_id, min(c) AS component FROM r GROUP BY n), s AS (SELECT component, 'CLUSTER-' || substr(sha256('[[' || string_agg('"' || doc_id || '"', ',' ORDER BY doc_id::VARCHAR) || ']]'), 1, 20) AS cluster_id FROM m GROUP BY component),
h AS (SELECT *, (('0x' || substr(sha256('["v1",42017,"' || cluster_id || '"]'), 1, 16))::UBIGINT % 10000)::INT AS bucket FROM s)
SELECT doc_id, component, cluster_id, bucket, CASE WHEN bucket < 8000 THEN 'train' WHEN bucket < 9000 THEN 'validation' ELSE 'test_id' END AS split FROM m JOIN h USING (component)""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of documents that share a text, or source, language and length class."""
    docs = table(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", F.concat_ws(":", "source", "lang", F.floor(F.col("n_chars") / 40).cast("string")).alias("a"), F.sha2("text", 256).alias("b"))
    return clusters.clusters(keyed, "doc_id", "a", "b")


@query("SELECT doc_id, sha256(text) AS text_hash, 'DOC-' || substr(sha256('[\"' || source || '\",' || doc_id || ']'), 1, 20) AS identifier, (('0x' || substr(sha256('[' || doc_id || ']'), 1, 16))::UBIGINT % 1000)::INT AS bucket FROM documents")
def stable_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"), hashing.identifier("DOC", hashing.json_string(F.col("source")), number).alias("identifier"), (hashing.stable_int(number) % 1000).cast("int").alias("bucket"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('[7,1,' || doc_id || ']'), doc_id) AS place FROM documents")
def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded order per pass over the data: places come from range partitions, not from one task."""
    return ordered_places(table(spark, sf_dir, "documents").select("doc_id", hashing.stable_hash(7, 1, F.col("doc_id").cast("string")).alias("k")), "k", "doc_id")


def ordered_places(rows: DataFrame, *order: str) -> DataFrame:
    """(first order column's row, place from 1): ranks inside range partitions plus the counts before them."""
    dealt = checkpoint(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # one row per partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("inside", inside).join(F.broadcast(starts), "part").select("doc_id", (F.col("start") + F.col("inside")).cast("long").alias("place"))
