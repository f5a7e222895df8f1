"""Approximate similarity search: an inverted file over k-means cells with byte codes of the residuals, for many queries at once.

Cells are Spark ML k-means over a bounded sample of unit vectors. Every row is filed under its nearest cell with
its difference from the centre in one byte a dimension. A query looks at the cells nearest to it; rows of a
cell are ranked by their codes and the best of them are scored again on the original vectors, in the same task. Cells
stand on shelves, and a query goes once to each shelf that has one of its cells; a shelf gives its best ``k`` alone. How many
cells are looked at is measured on a bounded sample of rows until the wanted recall is reached.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions.vectors import norm
from duskwatch.session import ensure_checkpoint_dir

#: Rows of a cell that one task ranks; a larger cell is dealt over several.
CELL_ROWS = 50_000
#: Shelves aimed at, of at least so many rows and never more than ``CELL_ROWS`` by much.
SHELVES, SHELF_ROWS = 64, 4_096
#: Queries that meet a shelf in one task, and entries of a block of scores.
LOT, BLOCK = 20_000, 8_000_000
#: Products of matrices sum in another order than the scores; rows so close to the k-th best are scored.
CLOSE = 1e-9
#: Rows per query and part of a cell that are scored again, as a multiple of k.
AGAIN = 4


def _matrix(column, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def unit_rows(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """id and unit vector of rows whose vector has a length above zero."""
    own = norm(F.col(column))
    rows = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(column).alias("_v"), own.alias("_n"))
    return rows.where((F.col("_n") > 0) & (F.col("_n") < float("inf"))).select("id", F.transform("_v", lambda x: x.cast("double") / F.col("_n")).alias("unit"))


@dataclass
class InvertedFile:
    """``filed``: id, cell, part (a cell above ``CELL_ROWS`` has several), shelf, code and unit vector; ``shelves``: those of a cell's parts."""

    centres: np.ndarray
    scale: float
    shelves: dict[int, list[int]]
    filed: DataFrame
    rows: DataFrame
    id_type: str


def _shelved(counts: dict[int, int], parts: dict[int, int], total: int) -> dict[int, list[int]]:
    """Shelf of every part of every cell: cells in order, a new shelf once one is full."""
    most = min(CELL_ROWS, max(SHELF_ROWS, total // SHELVES))
    out, shelf, held = {}, 0, 0
    for cell in sorted(counts):
        share = counts[cell] / parts[cell]
        for _ in range(parts[cell]):
            if held and held + share > most:
                shelf, held = shelf + 1, 0
            out.setdefault(cell, []).append(shelf)
            held += share
    return out


def build(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", cells: int | None = None, fit_rows: int = 50_000, seed: int = 42) -> InvertedFile | None:
    """The index over all rows; k-means is fitted on at most about ``fit_rows`` of them. ``cells`` defaults to the root of the row count, at most 4096.

    Null ids and vectors that are null or have no length or no finite one take no part; vectors must be of one length. None if no row is left.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    rows = unit_rows(vectors, id_column, column)
    total = rows.count()
    if not total:
        return None
    cells = max(1, min(cells or round(math.sqrt(total)), 4096, total))
    sample = rows if total <= fit_rows else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < fit_rows / total * (1 << 30))
    if cells > 1:
        model = KMeans(k=cells, seed=seed, maxIter=15, featuresCol="v").fit(sample.select(array_to_vector("unit").alias("v")))
        centres = np.array(model.clusterCenters())
    else:
        size = rows.select(F.size("unit")).first()[0]
        centres = np.zeros((1, size))
    size = centres.shape[1]
    # differences of unit vectors from centres within the unit ball lie within 2; most are far smaller
    far = sample.select(F.array_max(F.transform("unit", lambda x: F.abs(x))).alias("m")).agg(F.max("m")).first()[0]
    scale = (float(far) + float(np.abs(centres).max(initial=0))) / 127

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("unit"), size)
            cell = np.argmax(x @ centres.T - (centres * centres).sum(1) / 2, axis=1) if len(x) else np.zeros(0, np.int64)
            code = np.clip(np.round((x - centres[cell]) / scale), -127, 127).astype(np.int8)
            columns = [batch.column("id"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), batch.column("unit")]
            yield pa.RecordBatch.from_arrays(columns, ["id", "cell", "code", "unit"])

    kind = rows.schema["id"].dataType.simpleString()
    filed = rows.mapInArrow(file, f"id {kind}, cell int, code binary, unit array<double>").checkpoint()
    counts = {r["cell"]: r["count"] for r in filed.groupBy("cell").count().collect()}
    parts = {c: -(-n // CELL_ROWS) for c, n in counts.items()}
    many = F.create_map(*[F.lit(x) for c, p in parts.items() if p > 1 for x in (c, p)]) if any(p > 1 for p in parts.values()) else None
    part = F.lit(0) if many is None else F.pmod(F.xxhash64("id"), F.coalesce(many[F.col("cell")], F.lit(1))).cast("int")
    shelves = _shelved(counts, parts, total)
    places = spark.createDataFrame([(c, i, s) for c, some in shelves.items() for i, s in enumerate(some)], "cell int, part int, shelf int")
    return InvertedFile(centres, scale, shelves, filed.withColumn("part", part).join(F.broadcast(places), ["cell", "part"]), rows, kind)


def _copies(x: np.ndarray, keep: int) -> np.ndarray:
    """Rows without all but the first ``keep`` of equal ones, in order."""
    order = np.lexsort((np.arange(len(x)), np.unique(x, axis=0, return_inverse=True)[1].ravel()))
    new = np.ones(len(x), bool)
    new[1:] = (x[order[1:]] != x[order[:-1]]).any(1)
    at = np.arange(len(x))
    return np.sort(order[at - np.maximum.accumulate(np.where(new, at, 0)) < keep])


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products of paired rows, summed in order of the dimensions."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * x[:, d]
    return total


def _best(q: np.ndarray, q_key: np.ndarray, like: np.ndarray, x: np.ndarray, x_key: np.ndarray, k: int, take: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``k`` best rows of each query, ties to the first. ``take`` rows nearest by ``like`` are scored; None leaves no better row out."""
    out = []
    step = max(1, BLOCK // max(len(x), 1))
    for low in range(0, len(q), step):
        near = q[low : low + step] @ like.T
        near[q_key[low : low + step, None] == x_key] = -np.inf
        n = min(k if take is None else take, len(x))
        top = np.partition(near, len(x) - n, axis=1)[:, len(x) - n] if take is None else None
        at, hit = np.nonzero(near >= top[:, None] - CLOSE) if take is None else (np.repeat(np.arange(len(near)), n), np.argpartition(-near, n - 1, axis=1)[:, :n].ravel())
        real = near[at, hit] > -np.inf
        at, hit = at[real], hit[real]
        score = np.concatenate([np.zeros(0), *(_scores(q[low + at[i : i + BLOCK // 64]], x[hit[i : i + BLOCK // 64]]) for i in range(0, len(at), BLOCK // 64))])
        order = np.lexsort((hit, -score, at))
        at, hit, score = at[order], hit[order], score[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        out.append((low + at[first], hit[first], score[first]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def search(index: InvertedFile, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
    """query_id, rank, id, score of the nearest ``k`` other rows of each query (id, unit). ``exact`` looks at all cells and scores all that may count."""
    centres, scale, shelves = index.centres, index.scale, index.shelves
    size, probes = centres.shape[1], len(index.centres) if exact else min(probes, len(index.centres))
    kind = index.id_type
    asks = f"query_id {kind}, query array<double>, qshelf int, cells array<int>"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 1 + max(s for some in shelves.values() for s in some)
        for batch in batches:
            for low in range(0, len(batch), 2_000):
                some = batch.slice(low, 2_000)
                if exact:
                    row, shelf = np.repeat(np.arange(len(some)), last), np.tile(np.arange(last), len(some))
                    cells = pa.ListArray.from_arrays(pa.array(np.zeros(len(row) + 1, np.int32)), pa.array([], pa.int32()))
                else:
                    q = _matrix(some.column("unit"), size)
                    near = (centres * centres).sum(1) / 2 - q @ centres.T
                    cell = np.argpartition(near, probes - 1, axis=1)[:, :probes].ravel() if probes < len(centres) else np.tile(np.arange(len(centres)), len(q))
                    places = [shelves.get(int(c), []) for c in cell]
                    times = np.array([len(p) for p in places], int)
                    cell = np.repeat(cell, times)
                    place = np.repeat(np.repeat(np.arange(len(q)), probes), times) * last + np.array([s for p in places for s in p], int)
                    # a shelf may hold several parts of a cell
                    both = np.unique(np.stack([place, cell], 1), axis=0) if len(place) else np.zeros((0, 2), int)
                    place, first = np.unique(both[:, 0], return_index=True)
                    row, shelf = place // last, place % last
                    cells = pa.ListArray.from_arrays(pa.array(np.r_[first, len(both)].astype(np.int32)), pa.array(both[:, 1].astype(np.int32)))
                columns = [some.column("id").take(pa.array(row)), some.column("unit").take(pa.array(row)), pa.array(shelf.astype(np.int32)), cells]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "query", "qshelf", "cells"])

    def rank(asked: pa.Table, filed: pa.Table) -> pa.Table:
        if not asked.num_rows or not filed.num_rows:
            return pa.table({"query_id": pa.array([], asked["query_id"].type), "id": pa.array([], filed["id"].type), "score": pa.array([], pa.float64())})
        filed = filed.take(pc.sort_indices(filed["id"]))
        x = _matrix(filed["unit"], size)
        # of equal vectors the first by id are enough, and one more where a query is among them
        keep = _copies(x, k + 1) if len(filed["id"].unique()) == filed.num_rows else np.arange(len(x))
        filed, x = filed.take(pa.array(keep)), x[keep]
        q, ids = _matrix(asked["query"], size), pa.concat_arrays([*asked["query_id"].chunks, *filed["id"].chunks]).dictionary_encode().indices.to_numpy()
        q_key, x_key = ids[: len(q)], ids[len(q) :]
        if exact:
            found = [_best(q, q_key, x, x, x_key, k, None)]
        else:
            cell, part = (filed[c].to_numpy() for c in ("cell", "part"))
            like = centres[cell] + np.frombuffer(b"".join(filed["code"].to_pylist()), np.int8).reshape(-1, size) * scale
            wanted = asked["cells"].combine_chunks()
            who = np.repeat(np.arange(len(q)), wanted.value_lengths().to_numpy())
            what = wanted.flatten().to_numpy()
            found = []
            for c, p in sorted(set(zip(cell.tolist(), part.tolist()))):
                some, mine = who[what == c], np.flatnonzero((cell == c) & (part == p))
                at, hit, score = _best(q[some], q_key[some], like[mine], x[mine], x_key[mine], k, AGAIN * k + 1)
                found.append((some[at], mine[hit], score))
        at, hit, score = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((hit, -score, at))
        at, hit, score = at[order], hit[order], score[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        return pa.table({"query_id": asked["query_id"].take(pa.array(at[first])), "id": filed["id"].take(pa.array(hit[first])), "score": pa.array(score[first])})

    lots = max(1, -(-queries.count() // LOT))
    spread = queries.select("id", "unit").mapInArrow(ask, asks).withColumn("lot", F.pmod(F.xxhash64("query_id"), F.lit(lots)).cast("int"))
    filed = index.filed if not exact else index.filed.drop("code")
    filed = filed.withColumn("_lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))) if lots > 1 else filed.withColumn("_lot", F.lit(0))
    found = spread.groupBy("qshelf", "lot").cogroup(filed.groupBy("shelf", "_lot")).applyInArrow(rank, f"query_id {kind}, id {kind}, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def recall(index: InvertedFile, queries: DataFrame, k: int, probes: int, true: DataFrame | None = None) -> float:
    """Share of the true nearest ``k`` that a search with ``probes`` cells finds; ``true`` holds them where they are known."""
    keys = ["query_id", "id"]
    true = search(index, queries, k, exact=True).select(*keys) if true is None else true
    hit = search(index, queries, k, probes).join(true, keys, "left_semi")
    n = true.count()
    return hit.count() / n if n else 1.0


def probes_for(index: InvertedFile, k: int = 10, wanted: float = 0.95, sample: int = 64) -> int:
    """The smallest tried number of cells, doubled from 4, that reaches the wanted recall on at most about ``sample`` rows."""
    total = index.rows.count()
    some = index.rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) <= sample / max(total, 1) * (1 << 30)).checkpoint()
    true = search(index, some, k, exact=True).select("query_id", "id").checkpoint()
    probes = 4
    while probes < len(index.centres) and recall(index, some, k, probes, true) < wanted:
        probes *= 2
    return min(probes, len(index.centres))


def approx_similar(
    vectors: DataFrame, queries: Column, k: int = 10, wanted: float = 0.95, id_column: str = "vec_id", column: str = "embedding", **options
) -> DataFrame:
    """query_id, rank, id, score: the nearest ``k`` other rows of every row for which ``queries`` holds, with the recall ``wanted`` on a sample."""
    index = build(vectors, id_column, column, **options)
    if index is None:
        kind = vectors.schema[id_column].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score double")
    asked = unit_rows(vectors.where(queries), id_column, column).dropDuplicates(["id"])
    return search(index, asked, k, probes_for(index, k, wanted))
