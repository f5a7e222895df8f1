import numpy as np
import pytest

from duskwatch.llm.singular import leading_vectors
from duskwatch.llm.whitening import pack, unpack, whiten

SCHEMA = "vec_id long, embedding array<double>, n long, component string, x int"


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)) * np.linspace(3, 0.5, d) + rng.normal(size=d) * 4
    v[5:9] = v[4]
    return v.round(3)


def brute(values):
    """Covariance of the distinct grid vectors by definition, its eigenpairs by numpy."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in values]
    fit = np.array(sorted({tuple(v) for v in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (np.array(n * fit - s, dtype=float)) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    deviation = [int(((n * np.array(row, dtype=object) - s) ** 2).sum()) for row in x]
    return n, e, np.array([[float(n * a - b) / n for a, b in zip(row, s)] for row in x]) @ v / np.sqrt(np.maximum(e, 1e-300)), deviation


@pytest.mark.parametrize("n,d", [(300, 24), (40, 64)])
def test_against_eigenvectors(spark, n, d):
    v = vectors(n, d)
    odd = [(n + 1, None), (n + 2, [1.0] * (d - 1) + [None]), (n + 3, [float("nan")] * d), (n + 4, [float("inf")] + [0.0] * (d - 1)), (n + 5, []), (n + 6, [1.0])]
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)] + odd + [(None, [float(c) for c in v[0]]), (3, [float(c) for c in v[3]])]
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA).repartition(7)
    got = whiten(df, 16).collect()
    count, e, white, deviation = brute(v)
    assert len(got) == 16 * (n + 2) and {r.n for r in got} == {count}
    sign = {}
    for r in sorted(got, key=lambda r: (r.vec_id is None, r.vec_id)):
        i, k = (r.vec_id or 0), r.component - 1
        want = white[i, k]
        sign.setdefault(k, np.sign(r.whitened * want))
        assert abs(r.whitened - sign[k] * want) < 1e-9 * (1 + abs(want)) and r.deviation == deviation[i]
        assert abs(r.explained / (e[k] / e.sum()) - 1) < 1e-10 and 0 <= r.identity_error < 1e-10


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whiten(empty).collect() == [] and whiten(empty).columns[:2] == ["vec_id", "component"]
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, "c", 2) for i in range(5)] + [(9, None, 1, "c", 2)], SCHEMA)
    assert whiten(same).collect() == []


def test_few_directions(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0], 1, "c", 2) for i in range(6)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    assert abs(np.mean([r.whitened**2 for r in got]) - 1) < 1e-12


def test_wide_entries(spark):
    v = [[1e30, 1.0], [-1e30, 2.0], [5e8, 3.0], [0.0, 4.0]]
    got = whiten(spark.createDataFrame([(i, x, 1, "c", 2) for i, x in enumerate(v)], SCHEMA), 2).collect()
    x = [[max(-(2**53), min(2**53, int(np.floor(64 * c)))) for c in r] for r in v]
    s = [sum(c) for c in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in got} == {i: sum((4 * c - t) ** 2 for c, t in zip(r, s)) for i, r in enumerate(x)}


def test_pack():
    grid = np.array([[1, -2], [40_000, 3], [-(2**40), 7]])
    assert (unpack(__import__("pyarrow").array(pack(grid)), 2) == grid).all()
    assert [len(x) for x in pack(grid)] == [5, 9, 17]


@pytest.mark.parametrize("values", [[3, 2, 1], [2, 2, 2, 1], [5, 1e-3, 1e-6], [1] * 12, [4, 4, 4 - 1e-13, 1, 1, 0]])
def test_singular_values(values):
    rng = np.random.default_rng(2)
    d = len(values)
    q = lambda: np.linalg.qr(rng.normal(size=(d, d)))[0]
    m = q() * np.array(values) @ q()
    squares, v = leading_vectors(np.linalg.qr(m, mode="r"), d)
    want = np.array([x for x in values if x]) ** 2
    assert np.allclose(squares, want, rtol=1e-8) and np.allclose(v.T @ v, np.eye(len(want)), atol=1e-10)
    assert np.allclose(m.T @ (m @ v), v * squares, atol=1e-12 * max(values) ** 2 * d)
