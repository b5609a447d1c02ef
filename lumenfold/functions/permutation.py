"""Seeded permutations by arithmetic: the place of any row, and the row at any place, without a sort.

The numbers 0 to n - 1 are laid out in a rectangle of a x b cells with a near
the square root of n. A Feistel network over the rectangle's two coordinates
is a permutation of all cells, whatever its round function; a number that
lands on one of the few cells beyond n goes through it again (cycle walking),
so n itself is permuted. Rounds hash with MD5, which every engine has.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
#: Walks that are tried; the cells beyond n are fewer than a, so more than this many have a chance of a^-64 where they can occur at all.
WALKS = 64


def sides(n: int) -> tuple[int, int]:
    """a and b: a x b is at least n, and less than n + a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _round(seed: int, k: int, value: Column) -> Column:
    text = F.concat(F.lit(f"{seed}:{k}:"), value.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def _once(x: Column, a: int, b: int, seed: int, back: bool) -> Column:
    """One pass through the network, or back."""
    cell = F.struct(F.floor(x / b).cast("long").alias("left"), (x % b).cast("long").alias("right"))
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        cell = F.transform(F.array(cell), _turn(k, a, b, seed, -1 if back else 1))[0]
    return F.transform(F.array(cell), lambda c: c["left"] * b + c["right"])[0]


def _turn(k: int, a: int, b: int, seed: int, sign: int) -> Callable[[Column], Column]:
    """Round k of the network: one coordinate moves by a hash of the other."""

    def turned(c: Column) -> Column:
        left, right = c["left"], c["right"]
        if k % 2:
            right = F.pmod(right + sign * (_round(seed, k, left) % b), F.lit(b))
        else:
            left = F.pmod(left + sign * (_round(seed, k, right) % a), F.lit(a))
        return F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))

    return turned


def _walk(x: Column, n: int, seed: int, back: bool) -> Column:
    if n <= 1:
        return F.when((x >= 0) & (x < n), x.cast("long"))
    a, b = sides(n)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), _once(x.cast("long"), a, b, seed, back), lambda at, _: F.when(at < n, at).otherwise(_once(at, a, b, seed, back)))
    found = F.transform(F.array(walked), lambda at: F.when(at < n, at).otherwise(F.raise_error(F.lit("a walk did not end"))))[0]
    return F.when((x >= 0) & (x < n), found)


def place_of(row: Column, n: int, seed: int) -> Column:
    """The place (from 0) of row number ``row`` in the permutation of n rows that ``seed`` names; null outside."""
    return _walk(row, n, seed, back=False)


def row_at(place: Column, n: int, seed: int) -> Column:
    """The row that stands at ``place``: the inverse of `place_of`."""
    return _walk(place, n, seed, back=True)


def place_sql(table: str, number: str, n: int, seed: int) -> str:
    """(number, place) of a DuckDB table by the same rounds; walks as a recursive query."""
    a, b = sides(n)
    hashed = lambda k, c: f"(('0x' || substr(md5('{seed}:{k}:' || {c}), 1, 12))::UBIGINT)::BIGINT"
    steps = []
    for k in range(ROUNDS):
        source = f"s{k}" if k else "cells"
        left, right = ("l", f"(r + {hashed(k, 'l')} % {b}) % {b}") if k % 2 else (f"(l + {hashed(k, 'r')} % {a}) % {a}", "r")
        steps.append(f"s{k + 1} AS (SELECT i, x, {left} AS l, {right} AS r FROM {source})")
    body = f"cells AS (SELECT DISTINCT x AS i, x, x // {b} AS l, x % {b} AS r FROM range({a * b}) v(x)), " + ", ".join(steps)
    return f"""WITH RECURSIVE {body}, f AS (SELECT x, l * {b} + r AS y FROM s{ROUNDS}),
w AS (SELECT t.{number} AS i, f.y FROM {table} t JOIN f ON f.x = t.{number} UNION ALL SELECT w.i, f.y FROM w JOIN f ON f.x = w.y WHERE w.y >= {n})
SELECT i, y AS place FROM w WHERE y < {n}"""
