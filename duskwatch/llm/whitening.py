"""Whitening directions of embeddings: blockwise QR of centred rows, then the bidiagonal qd solver.

Vectors are put on a grid, each distinct grid vector once is the list to fit. Tasks reduce their rows of it, centred
by the exact mean, to a triangle each; triangles are stacked and reduced again, sixteen at a time, until one
is left. Its bidiagonal form gives singular values by dqds and directions by twisted factorisations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.components import settle
from duskwatch.llm.singular import leading_vectors

GRID, SHIFT = 64, 1_000_000
#: Grid entries are held within this bound, so that they are exact as doubles.
BOUND = 1 << 53
#: Triangles stacked by one task.
FAN_IN = 16
KINDS = (np.int16, np.int32, np.int64)
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, offset into the values) of usable lists: not null, not empty, all entries finite."""
    flat = column.flatten()
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(float)
    sizes = np.array(column.value_lengths().fill_null(0))
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = np.flatnonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]))
    return good, sizes[good], values, (ends - sizes)[good]


def _grid(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(GRID * values), -BOUND, BOUND).astype(np.int64)


def pack(grid: np.ndarray) -> list[bytes]:
    """Each row as bytes: the width of its entries, then the entries in the narrowest kind that holds them."""
    top = np.abs(grid).max(axis=1)
    kind = (top > 32767).astype(int) + (top > 2**31 - 1)
    narrow = [grid.astype(k) if (kind == i).any() else None for i, k in enumerate(KINDS)]
    return [bytes([2 << k]) + narrow[k][i].tobytes() for i, k in enumerate(kind.tolist())]


def unpack(column: pa.Array, size: int) -> np.ndarray:
    """Rows of ``pack`` as an array of longs."""
    out = np.empty((len(column), size), np.int64)
    raw = column.to_pylist()
    width = np.array([x[0] for x in raw], int)
    for k in KINDS:
        at = np.flatnonzero(width == np.dtype(k).itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join(raw[i][1:] for i in at), k).reshape(len(at), size)
    return out


@dataclass
class Whitening:
    """``n`` fitted vectors of ``size`` entries with exact sums; directions as columns, with the eigenvalues of the covariance."""

    n: int
    size: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    trace: float
    identity_error: float | None = None

    def centred(self, grid: np.ndarray) -> np.ndarray:
        """Grid vectors less the mean: the whole part is taken off in integers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (grid - whole) - rest

    def white(self, grid: np.ndarray) -> np.ndarray:
        return self.centred(grid) @ self.directions / np.sqrt(self.values)

    def deviations(self, grid: np.ndarray) -> list[int]:
        """Exact sums over entries of (n * x - S) ** 2."""
        whole = [s // self.n for s in self.sums]
        rest = [s % self.n for s in self.sums]
        part = grid - np.array(whole, np.int64)
        if part.size and self.n * (int(np.abs(part).max()) + 1) < 1 << 48 and self.size <= 4096:
            y = self.n * part - np.array(rest, np.int64)
            low, high = y & 0xFFFFFF, y >> 24
            sums = [(a * b).sum(axis=1).tolist() for a, b in ((high, high), (high, low), (low, low))]
            return [(x << 48) + (y << 25) + z for x, y, z in zip(*sums, strict=True)]
        return [sum((self.n * int(x) - r) ** 2 for x, r in zip(row, rest, strict=True)) for row in part.tolist()]


def _grid_rows(rows: DataFrame, id_column: str, column: str) -> DataFrame:
    """vec_id, size and packed grid vector of every usable row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, sizes, values, at = _vectors(batch.column("v"))
            ids = batch.column("vec_id").take(pa.array(good))
            for size in np.unique(sizes):
                pick = np.flatnonzero(sizes == size)
                grid = _grid(values[at[pick][:, None] + np.arange(size)])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(pick)), pa.array(np.full(len(pick), size, np.int32)), pa.array(pack(grid), pa.binary())], ["vec_id", "size", "x"]
                )

    source = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    return source.mapInArrow(run, "vec_id long, size int, x binary")


def fit_whitening(rows: DataFrame, components: int, id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """(usable rows on the grid, the whitening fitted to their distinct vectors); None where nothing varies."""
    grid = _grid_rows(rows, id_column, column)
    sizes = grid.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return grid, None
    size = sizes["size"]
    grid = grid.where(F.col("size") == size).select("vec_id", "x")
    # the offset of x is the same in every entry and leaves with the mean
    fit = settle(grid.select("x").distinct())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * size
        for batch in batches:
            x = unpack(batch.column("x"), size)
            small = x.size and np.abs(x).max() < 1 << 40
            sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0) if small else x.astype(object).sum(axis=0), strict=True)]
            n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size)), pa.array([n] * size), pa.array([str(s) for s in sums])], ["k", "n", "s"]
        )

    totals = fit.mapInArrow(add, "k long, n long, s string").groupBy("k").agg(F.sum("n"), F.sum(F.col("s").cast("decimal(38,0)"))).orderBy("k").collect()
    if not totals or not totals[0][1]:
        return grid, None
    found = Whitening(totals[0][1], size, [int(t[2]) for t in totals], np.zeros(0), np.zeros((size, 0)), 0.0)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for batch in batches:
            r = np.linalg.qr(np.vstack([r, found.centred(unpack(batch.column("x"), size))]), mode="r")
        if len(r):
            yield _triangle(TaskContext.get().partitionId(), r)

    def stack(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table["part"].to_pylist(), table["r"].to_pylist(), strict=True))
        r = np.linalg.qr(np.vstack([np.frombuffer(x).reshape(-1, size) for _, x in parts]), mode="r")
        return pa.Table.from_batches([_triangle(parts[0][0] // FAN_IN, r)])

    triangles = settle(fit.mapInArrow(reduce, "part long, r binary"))
    most = triangles.agg(F.max("part")).first()[0]
    while most:
        triangles = triangles.groupBy(F.floor(F.col("part") / FAN_IN).alias("_group")).applyInArrow(stack, "part long, r binary")
        most //= FAN_IN
    r = np.frombuffer(triangles.first()["r"]).reshape(-1, size)
    r = np.vstack([r, np.zeros((size - len(r), size))])
    squares, found.directions = leading_vectors(r, components)
    found.values, found.trace = squares / found.n, float((r * r).sum()) / found.n
    if not len(squares):
        return grid, None
    found.identity_error = _identity_error(fit, found)
    return grid, found


def _triangle(part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], ["part", "r"])


def _identity_error(fit: DataFrame, found: Whitening) -> float:
    """Largest entry of the whitened covariance less the identity, from a pass over all fitted vectors."""
    k = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = found.white(unpack(batch.column("x"), found.size))
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "s"])

    sums = fit.mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s")).orderBy("at").collect()
    total = np.array([s[1] for s in sums]).reshape(k + 1, k) / found.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = 16, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row per usable row of ``rows`` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Null and empty vectors and vectors with null or non-finite entries are left out, as are those
    whose length is not the commonest (ties: the longer). Repeated rows and null ids are kept as they are; other
    columns are ignored. Entries beyond 2**53 / 64 count as that bound. Directions without variance
    above rounding error, as in an empty table or one distinct vector, give no rows, so there
    may be fewer than ``components``. One task holds a batch of rows and ``FAN_IN`` triangles; the driver
    holds one triangle of dimension times dimension.
    """
    grid, found = fit_whitening(rows, components, id_column, column)
    if found is None:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    k = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpack(batch.column("x"), found.size)
            times = pa.array(np.repeat(np.arange(len(x)), k))
            deviation = pa.array([str(v) for v in found.deviations(x)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(times), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), deviation.take(times),
                    pa.array(found.white(x).ravel()), pa.array(np.tile(found.values / found.trace, len(x))),
                ],
                ["vec_id", "component", "deviation", "whitened", "explained"],
            )

    out = grid.mapInArrow(run, "vec_id long, component int, deviation string, whitened double, explained double")
    return out.select(
        "vec_id", "component", F.lit(found.n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened",
        "explained", F.lit(found.identity_error).alias("identity_error"),
    )
