from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int, vocabulary: int = 5000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, other scripts."""
    base = prose(1, 120)
    near = " ".join(base.split()[:117] + ["x", "y", "z"])
    return [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n ", "en", None, 3), (3, base, "en", "a", 1), (4, base.upper(), "en", "b", 1), (5, near, "en", "b", 1), (5, near, "en", "b", 1),
        (6, "one two", "en", "a", 7), (7, "ONE  two", "de", "b", 7), (8, "one two three", None, "", 9), (9, prose(9, 60_000), "fr", "c", 1), (None, base, "en", "a", 1), (None, None, "en", "a", None),
        (10, "日本語 テキスト \x00 ퟿ é <|endoftext|> 's it's İΣ", "ja", "c", 1), (11, prose(11, 40) + " " + prose(12, 5), "es", "é", 1), (12, prose(11, 40), "es", "z", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["score", "component_id", "kept", "size", "order", "target", "gone_id", "mix_id", "mix_times", "tiff_page", "label", "bands", "shard", "media"]
    return odd.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


def duck(tables, sql):
    """Rows of DuckDB SQL over pandas tables, sorted by columns' names."""
    import duckdb

    c = duckdb.connect()
    for name, frame in tables.items():
        c.register(name, frame)
    return c.sql(sql).df()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)

    def plain(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return "null"
        return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)

    norm = lambda f: sorted(tuple(plain(v) for v in row) for row in f[cols].astype(object).values.tolist())
    assert norm(a) == norm(b)
