"""Content-addressed identifiers, hash splits and keyed feature hashes.

A stable hash is the SHA-256 of a JSON array of its parts, so it does not
depend on partitioning, session or engine. All but the keyed 64-bit feature
hash are built-in expressions.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.sources.storage import content_hash

#: How many hex digits of the hash each kind of identifier keeps.
ID_DIGITS = {
    "SCENARIO": 24, "EXAMPLE": 24,
    "FAMILY": 20, "EVENT": 20, "FACT": 20, "DOC": 20, "CLUSTER": 20, "BUILD": 20, "EXPORT": 20, "RELEASE": 20, "MUT": 20, "CTX": 20,
}

#: Buckets of each n-gram namespace, in the order of their offsets.
NAMESPACE_BUCKETS = {"word_1": 16_384, "word_2": 32_768, "word_3": 32_768, "word_4": 16_384, "char_3": 16_384, "char_4": 16_384, "char_5": 16_384}


def json_part(part: Column | str | int | bool | None) -> Column:
    """A part of a stable hash as JSON: strings quoted and escaped, others plain."""
    if isinstance(part, Column):
        return part
    if part is None:
        return F.lit("null")
    if isinstance(part, bool):
        return F.lit(str(part).lower())
    return F.lit(str(part)) if isinstance(part, int) else json_string(F.lit(part))


def json_string(col: Column) -> Column:
    """A string column as a JSON string; null becomes ``null``. Control characters are spelled with small hex digits."""
    quoted = F.to_json(F.array(col))
    plain = quoted.substr(F.lit(2), F.length(quoted) - 2)
    small = plain
    for digit in "ABCDEF":
        small = F.regexp_replace(small, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    return F.when(col.isNull(), F.lit("null")).when(col.rlike(r"[\x0B\x0E-\x1F]"), small).otherwise(plain)


def json_array(*parts: Column | str | int | bool | None) -> Column:
    """JSON array of parts; columns must already be JSON (``json_string`` or numbers as text)."""
    return F.concat(F.lit("["), F.concat_ws(",", *[json_part(p) for p in parts]), F.lit("]"))


def stable_hash(*parts: Column | str | int | bool | None) -> Column:
    return F.sha2(json_array(*parts), 256)


def stable_int(*parts: Column | str | int | bool | None, bits: int = 64) -> Column:
    """The hash's first ``bits`` bits as an unsigned decimal(20, 0)."""
    return F.conv(F.substring(stable_hash(*parts), 1, bits // 4), 16, 10).cast("decimal(20,0)")


def identifier(kind: str, *parts: Column | str | int | bool | None) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.substring(stable_hash(*parts), 1, ID_DIGITS[kind]))


def record_split(record_id: Column, validation_percent: int = 10) -> Column:
    """``train`` or ``validation`` of a corpus record, by its id alone."""
    if validation_percent <= 0 or validation_percent >= 100:
        return F.lit("train" if validation_percent <= 0 else "validation")
    bucket = stable_int("cpt-split-v1", json_string(record_id), bits=32) % 100
    return F.when(bucket < validation_percent, "validation").otherwise("train")


def cluster_bucket(cluster_id: Column, seed: int = 42017, version: str = "v1") -> Column:
    return (stable_int(version, seed, json_string(cluster_id)) % 10_000).cast("int")


def cluster_split(cluster_id: Column, seed: int = 42017, version: str = "v1") -> Column:
    """80 % train, 10 % validation, 10 % test_id of clusters."""
    bucket = cluster_bucket(cluster_id, seed, version)
    return F.when(bucket < 8000, "train").when(bucket < 9000, "validation").otherwise("test_id")


def namespace(kind: Column, order: Column) -> Column:
    """``word_1`` to ``word_4`` or ``char_3`` to ``char_5``; anything else raises."""
    name = F.concat_ws("_", kind, order.cast("string"))
    return F.when(name.isin(*NAMESPACE_BUCKETS), name).otherwise(F.raise_error(F.concat(F.lit("unknown n-gram namespace "), name)))


def namespace_table() -> dict[str, tuple[int, int]]:
    """namespace -> (offset, buckets)."""
    out, offset = {}, 0
    for name, buckets in NAMESPACE_BUCKETS.items():
        out[name] = (offset, buckets)
        offset += buckets
    return out


def feature_id(name: str, key: str, secret: bytes) -> tuple[int, int]:
    """(feature id, bucket) of a key in a namespace; ids start at 1, 0 pads."""
    if not key:
        raise ValueError("an n-gram key must not be empty")
    offset, buckets = namespace_table()[name]
    raw = int.from_bytes(hashlib.blake2b(name.encode() + b"\0" + key.encode(), digest_size=8, key=secret).digest(), "little")
    return 1 + offset + raw % buckets, raw % buckets


def feature_hash(secret: bytes = b"ngram-v1"):
    """A column function (namespace, key) -> struct(feature_id, bucket).

    BLAKE2b has no built-in, so this is an Arrow function; call it on distinct
    keys and join back. Caches that must agree share the same ``secret``.
    """

    @F.arrow_udf(T.StructType([T.StructField("feature_id", T.IntegerType()), T.StructField("bucket", T.IntegerType())]))
    def hashed(names: pa.Array, keys: pa.Array) -> pa.Array:
        found = [feature_id(n, k, secret) for n, k in zip(names.to_pylist(), keys.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int32()) for i in (0, 1)], names=["feature_id", "bucket"])

    return hashed


def hash_manifest(secret: bytes = b"ngram-v1") -> dict[str, object]:
    """What a cache of hashed features must agree on, with a digest of it."""
    payload = {"algorithm": "blake2b-64", "key": hashlib.sha256(secret).hexdigest(), "namespaces": {n: list(v) for n, v in namespace_table().items()}, "rows": 1 + sum(NAMESPACE_BUCKETS.values())}
    return payload | {"digest": content_hash(payload)}
