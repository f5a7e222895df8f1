"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is trained in one task on a bounded sample of unit vectors; every row is filed under a leaf. A priority queue
gives each query the leaves in order of the nearest centre seen. How many leaves a query visits is
calibrated: for a bounded sample of vectors the true neighbours are found among all rows, and visits widen until
the wanted share of them lies in visited leaves. Leaves are dealt to blocks of bounded size, and queries meet the blocks of their
leaves in bounded lots; scores are cosines of the original vectors in double precision.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.components import settle
from duskwatch.llm.rows import hash_sample

#: Cosines by matrix product differ from exact ones by less than this; rows so close to the last place are scored exactly.
SLACK = 1e-9
#: Cosines held at a time.
TILE = 1 << 21


class Tree:
    """Centres of a hierarchical k-means tree over unit vectors. Node 0 is the root; ``leaf`` numbers the leaves, -1 for inner nodes."""

    def __init__(self, x: np.ndarray, leaves: int, branch: int = 8, rounds: int = 12, seed: int = 0):
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        self.centre, self.children = [np.zeros(d)], [[]]
        want = max(1, len(x) // max(leaves, 1))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= want or leaves <= 1:
                continue
            parts = self._split(x[rows], min(branch, max(2, round(len(rows) / want))), rounds, rng)
            if parts is None:
                continue
            for centre, at in parts:
                self.centre.append(centre)
                self.children.append([])
                self.children[node].append(len(self.centre) - 1)
                todo.append((len(self.centre) - 1, rows[at]))
        self.centre = np.array(self.centre)
        self.leaf = np.full(len(self.centre), -1)
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            if self.children[node]:
                stack.extend(reversed(self.children[node]))
            else:
                order.append(node)
        self.leaf[order] = np.arange(len(order))
        self.leaves = len(order)

    @staticmethod
    def _split(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator):
        distinct = np.unique(x, axis=0)
        if len(distinct) < 2:
            return None
        centre = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
        for _ in range(rounds):
            own = np.argmax(x @ centre.T - (centre * centre).sum(1) / 2, axis=1)
            used = np.unique(own)
            centre = np.array([x[own == c].mean(0) for c in used])
        own = np.argmax(x @ centre.T - (centre * centre).sum(1) / 2, axis=1)
        parts = [(centre[c], np.flatnonzero(own == c)) for c in np.unique(own)]
        return parts if len(parts) > 1 else None

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector: down the tree, to the nearest child at every node."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf[node]
                continue
            c = self.centre[below]
            own = np.argmax(x[rows] @ c.T - (c * c).sum(1) / 2, axis=1)
            todo += [(below[k], rows[own == k]) for k in np.unique(own)]
        return out

    def visits(self, x: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` leaves of each unit vector, best bin first: the queue holds centres by distance."""
        most = min(most, self.leaves)
        far = (self.centre * self.centre).sum(1) - 2 * (x @ self.centre.T)
        out = np.empty((len(x), most), np.int64)
        for row, d in enumerate(far):
            near = d.tolist()
            queue, n = [(near[0], 0)], 0
            while n < most:
                node = heapq.heappop(queue)[1]
                below = self.children[node]
                if below:
                    for c in below:
                        heapq.heappush(queue, (near[c], c))
                else:
                    out[row, n] = self.leaf[node]
                    n += 1
        return out


def _matrix(column: pa.Array | pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float) if raw else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors by their norms, scaled first so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision, the same for the same two vectors wherever they stand."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def usable(rows: DataFrame, id_column: str, column: str) -> tuple[DataFrame, np.dtype]:
    """vec_id and packed vector of distinct rows that can take part, and the kind of the packed entries."""
    single = rows.schema[column].dataType.simpleString() == "array<float>"
    kind = np.dtype(np.float32 if single else np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            values = v.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(kind)
            sizes = np.array(v.value_lengths().fill_null(0))
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            some = np.concatenate([[0], np.cumsum(values != 0)])
            good = np.flatnonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]) & (some[ends] > some[ends - sizes]))
            values = values + kind.type(0)  # -0.0 becomes 0.0
            packed = [values[e - n : e].tobytes() for e, n in zip(ends[good].tolist(), sizes[good].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(good)), pa.array(packed, pa.binary())], ["vec_id", "v"])

    source = rows.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<float>" if single else "array<double>").alias("v")
    )
    return source.mapInArrow(run, "vec_id long, v binary"), kind


class Layout:
    """Blocks of leaves of at most ``most`` rows: neighbouring leaves share one, a larger leaf is dealt over several of its own."""

    def __init__(self, leaves: int, counts: dict[int, int], most: int):
        self.first, self.parts = np.zeros(leaves, np.int64), np.ones(leaves, np.int64)
        block, held = 0, 0
        for leaf in range(leaves):
            n = counts.get(leaf, 0)
            if held and held + n > most:
                block, held = block + 1, 0
            self.first[leaf] = block
            held += n
            if n > most:
                self.parts[leaf] = -(-n // most)
                block, held = block + int(self.parts[leaf]), 0
        self.blocks = block + 1

    def of_leaves(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the input, block) of all blocks of the leaves."""
        times = self.parts[leaves]
        row = np.repeat(np.arange(len(leaves)), times)
        at = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        return row, self.first[leaves][row] + at


class Index:
    """Every usable row under a leaf of the tree, in blocks of at most about ``block_bytes``.

    ``fit_rows`` bounds the rows the tree is trained on, picked by hash; there is a leaf for each ``leaf_rows`` rows,
    and at most one for each 16 trained rows. Of equal vectors the ``copies`` smallest ids are kept: no
    list of ``copies`` - 1 neighbours can name another one, whichever row asks.
    """

    def __init__(
        self, rows: DataFrame, copies: int, id_column: str = "vec_id", column: str = "embedding", fit_rows: int = 32_768, leaf_rows: int = 256,
        block_bytes: int = 1 << 25,
    ):
        found, self.kind = usable(rows, id_column, column)
        size = found.groupBy(F.length("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
        self.width = size["size"] if size else self.kind.itemsize
        self.rows = found.where(F.length("v") == self.width)
        by = Window.partitionBy("v").orderBy("vec_id")
        filed = self.rows.withColumn("_copy", F.dense_rank().over(by)).where(F.col("_copy") <= copies).distinct().drop("_copy")
        self.tree = self._train(size["count"] if size else 0, fit_rows, leaf_rows)
        tree, kind = self.tree, self.kind

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = tree.assign(_unit(_matrix(batch.column("v"), kind))) if batch.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], ["vec_id", "v", "leaf"])

        self.filed = settle(filed.mapInArrow(file, "vec_id long, v binary, leaf int"))
        counts = dict(tuple(r) for r in self.filed.groupBy("leaf").count().collect())
        self.layout = Layout(self.tree.leaves, counts, max(1, block_bytes // self.width))

    def _train(self, n: int, fit_rows: int, leaf_rows: int) -> Tree:
        leaves = max(1, min(n // leaf_rows, min(n, fit_rows) // 16))
        if leaves < 2:
            return Tree(np.zeros((0, self.width // self.kind.itemsize)), 1)
        kind = self.kind

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = np.vstack([_unit(_matrix(b.column("v"), kind)) for b in batches if b.num_rows])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Tree(x, leaves))], pa.binary())], ["tree"])

        sample = hash_sample(self.rows, fit_rows, "vec_id", "v").select("v")
        return pickle.loads(sample.coalesce(1).mapInArrow(train, "tree binary").first()["tree"])


def _best(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the nearest ``k`` of the rows x for each query of q, original vectors; equal scores to the smaller id."""
    units, targets = _unit(q), _unit(x)
    step = max(1, TILE // len(x))
    out = []
    for low in range(0, len(q), step):
        near = units[low : low + step] @ targets.T
        near[q_id[low : low + step, None] == x_id[None, :]] = -np.inf
        bar = np.full(len(near), -2.0)
        if near.shape[1] > k:
            bar = np.maximum(np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - SLACK, bar)
        row, col = np.nonzero(near >= bar[:, None])
        out.append((low + row, col, cosines(q[low + row], x[col])))
    row, col, score = [np.concatenate(c) for c in zip(*out, strict=True)]
    return _cut(row, col, score, x_id[col], k)


def _cut(row: np.ndarray, col: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.lexsort((vec, -score, row))
    row, col, score = row[by], col[by], score[by]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], score[keep]


def _top(found: DataFrame, k: int) -> DataFrame:
    """The nearest ``k`` rows per (query_id, query) and their ranks; equal scores go to the smaller vec_id."""
    by = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def true_neighbours(index: Index, queries: list[tuple[int, bytes]], k: int) -> DataFrame:
    """query_id, query (its number), leaf, vec_id, score, rank: exact, against every filed row. ``queries`` is a bounded list."""
    kind, q_id = index.kind, np.array([q[0] for q in queries], np.int64)
    q = _matrix(pa.array([x[1] for x in queries], pa.binary()), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, x_id, leaf = _matrix(batch.column("v"), kind), batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
            if len(x) and len(q):
                at, col, score = _best(q, q_id, x, x_id, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_id[at]), pa.array(at.astype(np.int64)), pa.array(leaf[col]), pa.array(x_id[col]), pa.array(score)],
                    ["query_id", "query", "leaf", "vec_id", "score"],
                )

    return _top(index.filed.mapInArrow(run, "query_id long, query long, leaf int, vec_id long, score double"), k)


def calibrate(index: Index, k: int, recall: float, sample: int) -> int:
    """Leaves to visit so that ``recall`` of the true neighbours of ``sample`` rows lie in them."""
    if index.tree.leaves < 2:
        return 1
    rows = hash_sample(index.rows, sample, "v", "vec_id").select("vec_id", "v").collect()
    queries = [(r["vec_id"], bytes(r["v"])) for r in rows]
    order = index.tree.visits(_unit(_matrix(pa.array([q[1] for q in queries], pa.binary()), index.kind)), index.tree.leaves)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(index.tree.leaves), order.shape), 1)
    need = np.sort([place[r["query"], r["leaf"]] for r in true_neighbours(index, queries, k).collect()])
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1 if len(need) else 1


def search(index: Index, queries: DataFrame, k: int, visits: int, lot_bytes: int = 1 << 25) -> DataFrame:
    """query_id, rank, vec_id, score of ``queries`` (vec_id, v) by visits to ``visits`` leaves each."""
    tree, kind, layout = index.tree, index.kind, index.layout
    queries = settle(queries.distinct())
    lots = max(1, -(-queries.count() * index.width // lot_bytes))
    lot = F.pmod(F.xxhash64("vec_id", "v"), F.lit(lots)).cast("int")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                leaves = tree.visits(_unit(_matrix(part.column("v"), kind)), visits)
                row = np.repeat(np.arange(len(leaves)), leaves.shape[1])
                leaf = leaves.ravel()
                at, block = layout.of_leaves(leaf)
                row, leaf = row[at], leaf[at]
                by = np.lexsort((leaf, block, row))
                row, leaf, block = row[by], leaf[by], block[by]
                starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)].astype(np.int32)), pa.array(leaf.astype(np.int32)))
                pick = pa.array(row[starts])
                yield pa.RecordBatch.from_arrays(
                    [part.column("lot").take(pick), pa.array(block[starts].astype(np.int32)), part.column("vec_id").take(pick), part.column("v").take(pick), lists],
                    ["lot", "block", "vec_id", "v", "leaves"],
                )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, spread = batch.column("leaf").to_numpy(), batch.column("spread").to_numpy()
            block = layout.first[leaf] + spread % layout.parts[leaf]
            for lot_number in range(lots):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(leaf), lot_number, np.int32)), pa.array(block.astype(np.int32)), *[batch.column(c) for c in ("vec_id", "v", "leaf")]],
                    ["lot", "block", "vec_id", "v", "leaf"],
                )

    def meet(asked: pa.Table, filed: pa.Table) -> pa.Table:
        q, q_id, packed = _matrix(asked["v"], kind), asked["vec_id"].to_numpy(), asked["v"].to_pylist()
        x, x_id, leaf = _matrix(filed["v"], kind), filed["vec_id"].to_numpy(), filed["leaf"].to_numpy()
        lists = asked["leaves"].combine_chunks()
        wants = lists.flatten().to_numpy()
        who = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
        by_leaf, by_want = np.argsort(leaf, kind="stable"), np.argsort(wants, kind="stable")
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for number in np.unique(wants).tolist() if len(leaf) else []:
            rows = by_leaf[slice(*np.searchsorted(leaf, [number, number + 1], sorter=by_leaf))]
            asks = who[by_want[slice(*np.searchsorted(wants, [number, number + 1], sorter=by_want))]]
            if len(rows):
                at, col, score = _best(q[asks], q_id[asks], x[rows], x_id[rows], k)
                out.append((asks[at], rows[col], score))
        at, col, score = [np.concatenate(c) for c in zip(*out, strict=True)]
        at, col, score = _cut(at, col, score, x_id[col] if len(col) else col, k)
        return pa.table(
            {
                "query_id": pa.array(q_id[at] if len(at) else at, pa.int64()), "query": pa.array([packed[i] for i in at.tolist()], pa.binary()),
                "vec_id": pa.array(x_id[col] if len(col) else col, pa.int64()), "score": pa.array(score, pa.float64()),
            }
        )

    asked = queries.withColumn("lot", lot).mapInArrow(ask, "lot int, block int, vec_id long, v binary, leaves array<int>")
    filed = index.filed.withColumn("spread", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 20))).mapInArrow(
        place, "lot int, block int, vec_id long, v binary, leaf int"
    )
    met = asked.groupBy("lot", "block").cogroup(filed.groupBy("lot", "block")).applyInArrow(meet, "query_id long, query binary, vec_id long, score double")
    return _top(met, k).select("query_id", "rank", "vec_id", "score")


def nearest(
    rows: DataFrame, asks: str = "vec_id % 50 = 0", k: int = 5, recall: float = 0.95, sample: int = 256, id_column: str = "vec_id", column: str = "embedding",
    **index_options,
) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the ``k`` nearest other rows, by cosine, of each row for which ``asks`` holds.

    ``asks`` is a condition on vec_id. Vectors that are null, empty, zero or hold null or non-finite entries take
    no part, nor do rows without id and vectors whose length is not the commonest (ties: the longer). A row is its id
    and vector: repeated rows count once, an id with several vectors asks once for each, and a row
    never finds its own id. Equal scores go to the smaller id. Fewer rows than ``k`` give shorter lists; an empty table none.
    Other columns are ignored. ``sample`` bounds the calibration rows, the options of ``Index`` the training.
    """
    index = Index(rows, k + 1, id_column, column, **index_options)
    return search(index, index.rows.where(asks), k, calibrate(index, k, recall, sample))
