"""Whitening of embeddings by a one-sided Jacobi SVD of their TSQR factor.

Vectors become whole numbers (`grid`), so sums, counts and deviations are
exact. Each block of centred rows is compressed to its triangular factor R;
the factors of a task, then of groups of tasks, are stacked and factored again
until one R of dims x dims is left. Plane rotations make R's columns
orthogonal; the accumulated rotations are the components and the columns'
norms their standard deviations. The covariance is never formed, so small
deviations keep their digits.

What reaches the driver is bounded by the dimensions: one R of each of at most
``FAN`` groups, and as many means and products of components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import stash, trim

#: Rows factored at a time; partial results merged at a time; components reported.
BLOCK_ROWS, FAN, COMPONENTS = 2_048, 32, 16
#: Larger entries are cut to this many times 1/64, so that sums of 2^12 rows fit 64 bits before Python's integers take over.
LIMIT = 1 << 50


def grid(vector: Column | str = "embedding") -> Column:
    """floor(64 * entry) + 1000000 of every entry as long; null where the vector is null or has null or non-finite entries."""
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    whole = F.forall(v, lambda c: c.isNotNull() & (c < float("inf")) & (c > float("-inf")))
    cut = lambda c: F.least(F.greatest(F.floor(c * 64).cast("long"), F.lit(-LIMIT)), F.lit(LIMIT)) + 1_000_000
    near = lambda c: F.least(F.greatest(c, F.lit(-(2.0**50))), F.lit(2.0**50))
    return F.when(whole, F.transform(v, lambda c: cut(near(c))))


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column of one length as an integer matrix, without a Python object per entry."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Centre:
    """Exact sums of n vectors; ``whole`` and ``rest`` are quotient and remainder of sums by n."""

    n: int
    sums: list[int]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: 64-bit integers, or Python's where those could overflow."""
        whole = np.array([s // self.n for s in self.sums], object)
        rest = np.array([s % self.n for s in self.sums], object)
        if x.size and self.n * (int(np.abs(x).max()) + max(map(abs, whole.tolist())) + 1) >= 1 << 62:
            return self.n * (x.astype(object) - whole) - rest
        return self.n * (x - whole.astype(np.int64)) - rest.astype(np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, each entry rounded once or twice."""
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of squares of n * x - sums per row, exactly; None beyond 64 bits."""
        y = self.scaled(x)
        small = y.dtype != object and (not y.size or int(np.abs(y).max()) ** 2 * y.shape[1] < 1 << 63)
        found = (y * y).sum(axis=1).tolist() if small else [sum(int(v) ** 2 for v in row) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in found]


# ----------------------------------------------------------------- reductions


def _reduce(rows: DataFrame, fold: Callable[[object, pa.RecordBatch], object], start: object, pack: Callable, unpack: Callable, merge: Callable) -> object | None:
    """``fold`` over the batches of each task, then ``merge`` over groups of ``FAN`` results until few are left.

    Results travel as bytes; one row per task, fewer by ``FAN`` in each round.
    """
    schema = pa.schema([("at", pa.int64()), ("part", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                state = fold(state, batch.slice(at, BLOCK_ROWS))
        if state is not start:
            yield pa.record_batch([pa.array([0], pa.int64()), pa.array([pack(state)], pa.binary())], schema=schema)
        trim()

    def join(table: pa.Table) -> pa.Table:
        state = None
        for part in table.column("part").to_pylist():
            state = unpack(part) if state is None else merge(state, unpack(part))
        return pa.table([pa.array([0], pa.int64()), pa.array([pack(state)], pa.binary())], schema=schema)

    parts = stash(rows.mapInArrow(each, "at long, part binary").withColumn("at", F.spark_partition_id().cast("long")), "parts")
    while (n := parts.count()) > FAN:
        groups = -(-n // FAN)
        parts = stash(parts.groupBy((F.col("at") % groups).alias("g")).applyInArrow(join, "at long, part binary").withColumn("at", F.monotonically_increasing_id()), "parts")
    state = None
    for row in parts.orderBy("at").select("part").collect():  # at most FAN rows, each bounded by the dimensions
        state = unpack(bytes(row[0])) if state is None else merge(state, unpack(bytes(row[0])))
    return state


def _column(name: str) -> Callable[[pa.RecordBatch], np.ndarray]:
    return lambda batch: rows_of(batch.column(batch.schema.get_field_index(name)))


def sums_of(vectors: DataFrame) -> Centre | None:
    """Count and exact sums of the column ``x``; None without rows."""
    x_of = _column("x")

    def fold(state, batch):
        x = x_of(batch)
        exact = x if not x.size or int(np.abs(x).max()) < 1 << 51 else x.astype(object)
        sums = [int(v) for v in exact.sum(axis=0)]
        return (batch.num_rows, sums) if state is None else merge(state, (batch.num_rows, sums))

    def merge(a, b):
        return a[0] + b[0], [p + q for p, q in zip(a[1], b[1], strict=True)]

    pack = lambda s: " ".join(map(str, [s[0], *s[1]])).encode()
    unpack = lambda b: (lambda v: (v[0], v[1:]))([int(p) for p in b.split()])
    found = _reduce(vectors, fold, None, pack, unpack, merge)
    return Centre(*found) if found else None


def _packed(dims: int) -> tuple[Callable, Callable]:
    return lambda r: np.ascontiguousarray(r, np.float64).tobytes(), lambda b: np.frombuffer(b, np.float64).reshape(-1, dims)


def tall_skinny_r(vectors: DataFrame, centre: Centre) -> np.ndarray:
    """The triangular factor of all centred rows ``x``, without forming their products."""
    x_of, dims = _column("x"), len(centre.sums)
    factor = lambda rows: np.linalg.qr(rows, mode="r")

    def fold(state, batch):
        rows = centre.centred(x_of(batch))
        return factor(rows if state is None else np.vstack([state, rows]))

    pack, unpack = _packed(dims)
    return _reduce(vectors, fold, None, pack, unpack, lambda a, b: factor(np.vstack([a, b])))


# -------------------------------------------------------------- Jacobi rotations


def _meetings(dims: int) -> list[np.ndarray]:
    """Every pair of ``dims`` columns once, in rounds of disjoint pairs."""
    seats, rounds = list(range(dims + dims % 2)), []
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats[: len(seats) // 2], reversed(seats[len(seats) // 2 :]), strict=True) if max(a, b) < dims]
        rounds.append(np.array([(min(p), max(p)) for p in pairs], np.int64).reshape(-1, 2))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return rounds


def one_sided_jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns), falling.

    Rotates pairs of columns until every pair is orthogonal to rounding; the
    rotations are disjoint within a round and applied together.
    """
    a = np.array(r, np.float64)
    dims = a.shape[1]
    scale = np.abs(a).max() if a.size else 0.0
    v = np.eye(dims)
    if not scale:
        return np.zeros(dims), v
    a = a / scale
    rounds, done = _meetings(dims), 8 * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for pairs in rounds:
            if not len(pairs):
                continue
            i, j = pairs.T
            left, right = a[:, i], a[:, j]
            p, q, c = (left * left).sum(0), (right * right).sum(0), (left * right).sum(0)
            apart = np.abs(c) > done * np.sqrt(p) * np.sqrt(q)
            if not apart.any():
                continue
            turned = True
            i, j, p, q, c = i[apart], j[apart], p[apart], q[apart], c[apart]
            with np.errstate(over="ignore"):
                zeta = (q - p) / (2 * c)
                tan = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1 / np.hypot(1.0, tan)
            sin = cos * tan
            for m in (a, v):
                left, right = m[:, i].copy(), m[:, j].copy()
                m[:, i], m[:, j] = cos * left - sin * right, sin * left + cos * right
        if not turned:
            break
    else:
        raise RuntimeError("Jacobi rotations did not settle")
    sizes = np.sqrt((a * a).sum(0)) * scale
    order = np.argsort(-sizes, kind="stable")
    return sizes[order], v[:, order]


@dataclass(frozen=True)
class Whitener:
    """Components (columns) and standard deviations of a fit, and the share of the variance each explains."""

    centre: Centre
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float = float("nan")

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components / self.deviations


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """A whitener of the distinct vectors ``x`` (equal lengths); None without rows.

    Directions in which the vectors do not differ beyond rounding are no
    components, so there may be fewer than asked for, or none.
    """
    listed = stash(vectors.select("x").distinct(), "fit-list")
    centre = sums_of(listed)
    if centre is None:
        return None
    sizes, v = one_sided_jacobi(tall_skinny_r(listed, centre))
    real = sizes > max(len(sizes), 1) * np.finfo(float).eps * (sizes[0] if len(sizes) else 0.0)
    kept = min(components, int(real.sum()))
    share = sizes**2 / (sizes**2).sum() if kept else sizes
    found = Whitener(centre, v[:, :kept], sizes[:kept] / np.sqrt(centre.n), share[:kept])
    return Whitener(centre, found.components, found.deviations, found.explained, identity_error(listed, found))


def identity_error(vectors: DataFrame, found: Whitener) -> float:
    """Largest absolute entry of the whitened vectors' covariance (divisor n, centred first) minus the identity."""
    kept = len(found.deviations)
    if not kept:
        return 0.0
    x_of = _column("x")

    def fold(state, batch):
        w = found.whiten(x_of(batch))
        mean = w.mean(axis=0)
        part = (len(w), mean, (w - mean).T @ (w - mean))
        return part if state is None else merge(state, part)

    def merge(a, b):
        n, apart = a[0] + b[0], b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] / n * b[0])

    pack = lambda s: np.concatenate([[float(s[0])], s[1], s[2].ravel()]).tobytes()
    flat = lambda v: (int(v[0]), v[1 : kept + 1], v[kept + 1 :].reshape(kept, kept))
    n, _, products = _reduce(vectors, fold, None, pack, lambda b: flat(np.frombuffer(b, np.float64)), merge)
    return float(np.abs(products / n - np.eye(kept)).max())


def gridded(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x) of the rows that remain; shorter vectors than the longest lack entries, and so are dropped as with nulls."""
    rows = stash(embeddings.select(F.col(key), grid(vector).alias("x")).where("x IS NOT NULL"), "gridded")
    dims = rows.agg(F.max(F.size("x"))).head()[0]
    return rows.where((F.size("x") == (dims or 0)) & (F.size("x") > 0))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per remaining row and component.

    The model is fitted on distinct grid vectors, so copies weigh nothing;
    copies and repeated or null ids get rows of their own all the same.
    Null vectors, and vectors with null, missing or non-finite entries, are
    dropped; entries beyond 2^50 / 64 are cut to that. Components of equal
    eigenvalue are any basis of their space, the same for all rows. If the
    vectors do not differ in some direction, there are fewer components; one
    vector alone, or an empty table, gives no rows. ``deviation`` is null
    beyond 64 bits. Extra columns are left out.
    """
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = gridded(embeddings)
    model = fit(rows, components)
    if model is None or not len(model.deviations):
        return embeddings.sparkSession.createDataFrame([], out)
    kept, x_of = len(model.deviations), _column("x")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x, many = x_of(part), part.num_rows
                again = pa.array(np.repeat(np.arange(many), kept))
                yield pa.record_batch(
                    [
                        part.column(0).cast(pa.int64()).take(again),
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), many)),
                        pa.array(np.full(many * kept, model.centre.n, np.int64)),
                        pa.array(model.centre.deviations(x), pa.int64()).take(again),
                        pa.array(model.whiten(x).ravel()),
                        pa.array(np.tile(model.explained, many)),
                        pa.array(np.full(many * kept, model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
        trim()

    return rows.select("vec_id", "x").mapInArrow(each, out)
