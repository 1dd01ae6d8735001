"""Whitening against numpy's eigenvectors of the covariance."""

import numpy as np
import pytest

from corpusloom.llm import whitening
from tests.conftest import SF


def brute(vectors, top=32):
    """n, exact deviations, and variances and components of the covariance, by numpy."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:top]
    return n, [sum(v * v for v in row) for row in (n * x - s).tolist()], e[order], axes[:, order], c, e.sum()


def held(got, ids, vectors):
    n, deviations, e, axes, c, trace = brute(vectors)
    m = max((r["component"] for r in got), default=0)
    assert m == int((e > 1e-12 * e[0]).sum()) and len(got) == len(ids) * m
    table = {(r["vec_id"], r["component"]): r for r in got}
    w = np.array([[table[i, k + 1]["whitened"] for k in range(m)] for i in ids])
    want = c @ axes[:, :m] / np.sqrt(e[:m])
    signs = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * signs).max() < 1e-7
    for i, dev in zip(ids, deviations):
        r = table[i, 1]
        assert (r["n"], r["deviation"]) == (n, dev)
    for k in range(m):
        r = table[ids[0], k + 1]
        assert abs(r["explained"] - e[k] / trace) < 1e-9 and r["identity_error"] < 1e-9


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = whitening.whiten(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()
    held(got, [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


@pytest.mark.parametrize("n,d", [(5, 8), (40, 3), (2, 2), (300, 40)])
def test_ranks(spark, n, d):
    """Fewer rows than dimensions, and fewer dimensions than components."""
    v = np.random.default_rng(n).standard_normal((n, d)).tolist()
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>").repartition(3)
    held(whitening.whiten(df).collect(), list(range(n)), v)


def test_repeated_variances(spark):
    """Equal variances along several dimensions, and a dimension without any: whitened rows still have the identity."""
    v = [[s * (i == k) + 5.0 * (k == 3) for k in range(4)] for i in range(3) for s in (-1.0, 1.0)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>")).collect()
    assert len(got) == 18 and max(r["identity_error"] for r in got) < 1e-9
    assert sum(r["explained"] for r in got if r["vec_id"] == 0) == pytest.approx(1)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (None, [0.5, -1.0], None), (4, None, "x"), (5, [nan, 1.0], "x"), (6, [inf, 1.0], "x"), (7, [None, 1.0], "x"), (8, [], "x"), (9, [1.0, 2.0, 3.0], "x"), (10, [3.0, 0.1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")
    got = whitening.whiten(df).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted([("1", 1), ("1", 1), ("1", 2), ("1", 2), ("None", 1), ("None", 2), ("10", 1), ("10", 2)])
    assert {r["n"] for r in got} == {4}
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 1")).count() == 0


def test_deviation_beyond_a_long(spark):
    """Where (n x - S)^2 fits a long only by a little, or not at all."""
    x = np.array([[2**20, 0], [-(2**20), 0]], np.int64)
    assert whitening._deviations(x, 2**11, np.array([0, 0])).to_pylist() == [2**62, 2**62]
    assert whitening._deviations(x, 2**12, np.array([0, 0])).to_pylist() == [None, None]
