"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Rows stay where they are: a step is one pass over the staged integer vectors, in which each task multiplies its centred rows
with a few vectors of the dimensions' length, forms the products X v and X^T u of the step and adds up what the driver needs:
numbers per dimension, never per row. A left vector u is held as the p with u = X p, so it is formed anew in every pass
and no column of it is stored. Both sides are reorthogonalised in full. The small bidiagonal matrix is decomposed on
the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import staged

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
# a product that is this much smaller than the largest is zero: there is no more variance in its direction
ZERO = 1e-9
# wanted residual of the components against the largest deviation, where there are more dimensions than steps to take
SETTLED = 1e-14
# values of a batch that are multiplied at once
VALUES = 1 << 20
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """What `fit` finds: rows, exact sums of 64 c per dimension, unit components as columns, their variances and the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float


def integer_rows(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): floor(64 c) of every entry, for the rows whose vector holds entries, all of them finite. Of vectors of
    several lengths those of the most frequent one stay (ties: the longest), since others share no dimensions with them."""
    c = F.col(vector).cast("array<double>")
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.select(F.col(key).alias("key"), F.when(sound & (F.size(c) > 0), F.transform(c, lambda v: F.floor(v * SCALE).cast("long"))).alias("x")).where("x is not null")
    rows = staged(rows, "whitening-rows")
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).select("d").collect()
    return rows.where(F.size("x") == (length[0]["d"] if length else 0))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Bounded parts of a batch with their vectors as rows."""
    if not len(batch):
        return
    d = len(batch.column("x")[0])
    step = max(1, VALUES // d)
    for i in range(0, len(batch), step):
        part = batch.slice(i, step)
        yield part, part.column("x").flatten().to_numpy().reshape(-1, d)


def _summed(rows: DataFrame, make: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all parts of the row set of what `make` gives for a part: a few numbers, one row from each task,
    added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _matrices(batch):
                got = make(x)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    parts = rows.select("x").mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i")
    return np.array([r["v"] for r in parts.collect()])


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, rounded once: the numerator is exact."""
    return (x * n - sums) / n


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of all rows of (key, x); None without rows.

    A step takes one right vector v. The pass gives r = X v - beta u, its products with all u so far, its square and X^T r;
    taking the u out of r and of X^T r is then arithmetic on numbers per dimension. Steps end when the vectors span the
    dimensions, or earlier when every wanted component's residual has settled. Where a product vanishes, the matrix falls
    apart there and a new direction is taken, so repeated and zero variances are found as well. Components without
    variance are not returned."""
    first = _summed(rows, lambda x: np.r_[len(x), x.sum(axis=0)], "long")
    if not len(first):
        return None
    n, sums = int(first[0]), first[1:].astype(np.int64)
    d, rng = len(sums), np.random.default_rng(0)
    trace = float(_summed(rows, lambda x: np.array([np.square(_centred(x, n, sums)).sum()]))[0])
    v_all, p_all, g_all = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    b = np.zeros((0, 0))

    def fresh(v: np.ndarray) -> tuple[np.ndarray, float]:
        """v without its parts along the right vectors, as a unit vector, and its length before."""
        for _ in range(2):
            v = v - v_all @ (v_all.T @ v)
        size = float(np.linalg.norm(v))
        return v / (size or 1.0), size

    v, beta, scale = fresh(rng.standard_normal(d))[0], 0.0, np.sqrt(trace)
    while v_all.shape[1] < d and trace > 0:
        k = p_all.shape[1]
        q = v - beta * p_all[:, -1] if beta else v
        basis = np.column_stack([p_all, q])

        def products(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            y = c @ basis
            return np.r_[y.T @ y[:, -1], c.T @ y[:, -1]]

        got = _summed(rows, products)
        along, square, g = got[:k], got[k], got[k + 1 :]
        alpha = np.sqrt(max(square - along @ along, 0.0))
        v_all = np.column_stack([v_all, v])
        b = np.pad(b, ((0, 0), (0, 1)))
        if k:
            b[:, -1] = along
            b[-1, -1] += beta
        if alpha > ZERO * scale:
            p_all = np.column_stack([p_all, (q - p_all @ along) / alpha])
            g_all = np.column_stack([g_all, (g - g_all @ along) / alpha])
            b = np.pad(b, ((0, 1), (0, 0)))
            b[-1, -1] = alpha
            v, beta = fresh(g_all[:, -1])
        else:
            beta = 0.0
        if beta <= ZERO * scale:
            v, beta = fresh(rng.standard_normal(d))[0], 0.0
        elif b.shape[0] >= 2 * components:
            left, s, _ = np.linalg.svd(b)
            if (beta * np.abs(left[-1, :components]) < SETTLED * s[0]).all():
                break
    _, s, right = np.linalg.svd(b) if b.size else (None, np.zeros(0), np.zeros((0, d)))
    m = int(min(components, (s > ZERO * scale).sum()))
    return Whitening(n, sums, v_all @ right[:m].T if m else np.zeros((d, 0)), np.square(s[:m]) / n, trace / n)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    m = len(model.variances)
    axes = model.components / np.sqrt(model.variances)
    mean = _summed(rows, lambda x: (_centred(x, model.n, model.sums) @ axes).sum(axis=0)) / model.n

    def squares(x: np.ndarray) -> np.ndarray:
        w = _centred(x, model.n, model.sums) @ axes - mean
        return (w.T @ w).ravel()

    return float(np.abs(_summed(rows, squares).reshape(m, m) / model.n - np.eye(m)).max())


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sums of (n x - S)^2, exact; null for those that no long holds."""
    off = x * n - sums
    if float(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < 2.0**62:
        return pa.array(np.square(off).sum(axis=1))
    exact = [sum(v * v for v in row) for row in off.tolist()]
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each row of `df` with a sound vector and each of the leading components: key, component (from 1, by falling
    variance), n (rows of the fit), deviation (sum over dimensions of (n x - S)^2, exact), whitened, explained (the
    component's part of all variance) and identity_error.

    Rows whose vector is null, empty or holds null or non-finite entries are left out; so are vectors of another length than
    the most frequent. Repeated rows count and are returned as often as they occur, null keys too. Other columns are
    not read. Components without variance (fewer rows than dimensions, or all rows equal) are not returned, and an empty table
    gives no rows."""
    rows = integer_rows(df, key, vector)
    model = fit(rows, components)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {OUT}"
    if model is None or not len(model.variances):
        return df.sparkSession.createDataFrame([], schema)
    error, m = identity_error(rows, model), len(model.variances)
    axes, explained = model.components / np.sqrt(model.variances), model.variances / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _matrices(batch):
                k = len(x)
                each = pa.array(np.repeat(np.arange(k), m))
                number = np.tile(np.arange(m, dtype=np.int32), k)
                w = _centred(x, model.n, model.sums) @ axes
                columns = [part.column("key").take(each), pa.array(number + np.int32(1)), pa.array(np.full(k * m, model.n)), _deviations(x, model.n, model.sums).take(each), pa.array(w.ravel()), pa.array(explained[number]), pa.array(np.full(k * m, error))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
