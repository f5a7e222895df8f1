import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.llm.neighbours import Index, Tree, calibrate, nearest, search

SCHEMA = "vec_id long, embedding array<float>, query_id long, score string, leaf int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "s", 2) for i, v in rows], SCHEMA)


def brute(rows, asks, k=5):
    """Every query against every other id, by definition."""
    good = {(i, tuple(np.float32(c) for c in v)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    good = sorted(good)
    x, ids = np.array([g[1] for g in good], float), np.array([g[0] for g in good])
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for i in range(len(good)):
        if asks(ids[i]):
            score = x @ x[i]
            order = sorted((round(-s, 12), j) for s, j in zip(score, ids) if j != ids[i])[:k]
            out.setdefault(int(ids[i]), []).append([int(j) for _, j in order])
    return out


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, 16)) * 2
    rows = [(i, (centre[i % 12] + rng.normal(size=16)).round(4)) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(40)] + [(rows[3][0], rows[3][1]), (rows[3][0], rows[9][1])]
    odd = [None, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] * 16, [0.0] * 16, [], [1.0, 2.0]]
    return rows + [(n + 100 + i, v) for i, v in enumerate(odd)] + [(None, rows[1][1])]


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r)
    return out


def test_all_leaves_are_exact(spark):
    rows = vectors(900)
    df = table(spark, rows).repartition(5)
    index = Index(df, 6, leaf_rows=40, block_bytes=64 * 100)
    assert index.tree.leaves > 8 and index.layout.blocks > 3
    got = lists(search(index, index.rows.where("vec_id % 10 = 0"), 5, index.tree.leaves, lot_bytes=64 * 30))
    want = brute(rows, lambda i: i % 10 == 0)
    assert got.keys() == want.keys()
    for q, r in got.items():
        assert [x.vec_id for x in r] == want[q][0] and [x.rank for x in r] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("recall", [0.6, 0.95])
def test_calibrated_recall(spark, recall):
    rows = vectors(4000, 5)
    df = table(spark, rows).repartition(4)
    index = Index(df, 6, leaf_rows=32)
    visits = calibrate(index, 5, recall, 200)
    got, want = lists(search(index, index.rows.where("vec_id % 10 = 0"), 5, visits)), brute(rows, lambda i: i % 10 == 0)
    hits = sum(len({x.vec_id for x in got[q]} & set(w[0])) for q, w in want.items())
    assert hits / (5 * len(want)) > recall - 0.05
    assert visits < index.tree.leaves * (0.5 if recall < 0.9 else 1)


def test_queue_order():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    tree = Tree(x, 40)
    assert sorted(set(tree.assign(x))) == list(range(tree.leaves))
    order = tree.visits(x[:50], tree.leaves)
    assert (np.sort(order, axis=1) == np.arange(tree.leaves)).all()
    # a leaf leaves the queue when the farthest centre on its path does
    far = {}

    def walk(node, path):
        path = [*path, node]
        if not tree.children[node]:
            far[int(tree.leaf[node])] = path[1:]
        for c in tree.children[node]:
            walk(c, path)

    walk(0, [])
    for q, leaves in zip(x[:50], order):
        worst = [max(((q - tree.centre[c]) ** 2).sum() for c in far[leaf]) for leaf in leaves.tolist()]
        assert (np.diff(worst) >= -1e-12).all()
    assert (tree.visits(x[:50], 3) == order[:, :3]).all()


def test_small_and_empty(spark):
    rows = [(0, [1.0] + [0.0] * 15), (50, [2.0] + [0.0] * 15), (3, [0.0, 1.0] + [0.0] * 14)]
    got = lists(nearest(table(spark, rows)))
    assert {q: [(x.rank, x.vec_id, round(x.score, 12)) for x in r] for q, r in got.items()} == {
        0: [(1, 50, 1.0), (2, 3, 0.0)], 50: [(1, 0, 1.0), (2, 3, 0.0)]
    }
    assert nearest(table(spark, [])).collect() == [] and nearest(table(spark, [(0, rows[0][1])])).collect() == []
    assert nearest(table(spark, [(0, None), (None, [1.0])])).collect() == []


def test_doubles_and_copies(spark):
    rows = [(i, [1.0 + 1e-6 * (i % 3), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("embedding", F.col("embedding"))
    got = lists(nearest(df, k=3))
    assert sorted(got) == [0, 50] and [x.vec_id for x in got[0]] == [3, 6, 9]
