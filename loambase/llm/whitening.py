"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Entries become integers, so that sums and the centred scatter are exact. Spark sums both over the rows, a
partial sum a task; the driver holds matrices of the vectors' dimension (``MOST_DIMENSIONS`` at most), never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, small_batches

#: Entries are cut at this size either way: their squares still have exact sums of 128 bits.
MOST = 1 << 50
MOST_DIMENSIONS, OFFSET, SCALE = 4096, 1_000_000, 64
#: Pivots and eigenvalues below this share of the largest count as zero, times the dimension.
NOTHING = 1e-14


@dataclass(frozen=True)
class Model:
    """Of n fitted vectors: sums (exact), eigenvalues in falling order, components (a column each), trace of
    the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integers(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, x): rows whose vector is not null and has finite entries only, of the most frequent length (of equally
    frequent ones the greatest); x = floor(64 * entry) + 1000000, cut at 2^50."""
    v = F.col("__v")
    taken = rows.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("__v"))
    good = taken.filter(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sized = good.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("k"))
    best = sized.agg(F.max(F.struct("k", "d"))["d"].alias("d")).first()["d"]
    cut = lambda x: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.lit(float(SCALE)) * x))
    return good.filter(F.size(v) == F.lit(best)).select("id", F.transform("__v", lambda x: F.floor(cut(x)).cast("long") + OFFSET).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _summed(frame: DataFrame, part: Callable[[np.ndarray], list[np.ndarray]]) -> list[int]:
    """Sums over all rows of the integer arrays that ``part`` makes of a batch's matrix, an exact total for each
    position. A task gives one row of totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                new = np.concatenate([np.asarray(p).ravel().astype(object) for p in part(_matrix(batch))])
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([list(map(str, total))], pa.list_(pa.string()))], ["totals"])

    each = frame.select("x").mapInArrow(run, "totals array<string>").select(F.posexplode("totals").alias("at", "total"))
    return [int(r["s"]) for r in each.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()]


def _scatter(middle: list[int]):
    """Upper triangle of y'y and sums of y = x - middle, exact: in doubles, longs or big integers, whichever
    holds them."""
    centre = np.array(middle, np.int64)

    def part(x: np.ndarray) -> list[np.ndarray]:
        y = x - centre
        upper = np.triu_indices(y.shape[1])
        most = int(np.abs(y).max(initial=0))
        if len(y) * most * most < 1 << 53:
            z = y.astype(float)
            return [(z.T @ z)[upper].astype(np.int64), y.sum(axis=0)]
        if len(y) * most * most < 1 << 62:
            return [(y.T @ y)[upper], y.sum(axis=0)]
        y = y.astype(object)
        return [(y.T @ y)[upper], y.sum(axis=0)]

    return part


def cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order): lower trapezoidal factor of a semidefinite matrix with rows and columns in ``order``, the
    largest remaining diagonal entry first; as many columns as the matrix has rank."""
    rest, d = matrix.astype(float).copy(), len(matrix)
    order, factor = np.arange(d), np.zeros((d, d))
    floor = NOTHING * d * max(float(np.diag(rest).max(initial=0)), 0)
    for k in range(d):
        p = k + int(np.diag(rest)[k:].argmax())
        if rest[p, p] <= floor:
            return factor[:, :k], order
        for m in (rest, factor):
            m[[k, p]] = m[[p, k]]
        rest[:, [k, p]] = rest[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor with columns rotated in pairs until all are at right angles; each round of a sweep rotates
    disjoint pairs at once."""
    g = factor.copy()
    k = g.shape[1]
    teams = np.arange(k + k % 2)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(1, len(teams) - 1)):
            half = len(teams) // 2
            p, q = np.minimum(teams[:half], teams[half:][::-1]), np.maximum(teams[:half], teams[half:][::-1])
            p, q = p[q < k], q[q < k]
            a, b = g[:, p], g[:, q]
            x, y, z = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            angle = np.abs(z) / np.where(x * y > 0, np.sqrt(x * y), 1)
            worst = max(worst, float(angle.max(initial=0)))
            turn = angle > 1e-16
            zeta = (y - x) / np.where(turn, 2 * z, 1)
            t = np.where(turn, np.where(zeta >= 0, 1, -1) / (np.abs(zeta) + np.hypot(1, zeta)), 0)
            c = 1 / np.hypot(1, t)
            g[:, p], g[:, q] = c * a - c * t * b, c * t * a + c * b
            teams = np.concatenate([teams[:1], teams[-1:], teams[1:-1]])
        if worst < 1e-15 * max(1, k):
            break
    return g


def decomposed(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance in falling order, those that count as zero left out, and unit eigenvectors."""
    factor, order = cholesky(covariance)
    g = jacobi(factor)
    values = (g * g).sum(axis=0)
    rank = np.argsort(-values, kind="stable")
    rank = rank[values[rank] > NOTHING * len(covariance) * values.max(initial=0)]
    vectors = np.zeros((len(covariance), len(rank)))
    vectors[order] = g[:, rank] / np.sqrt(values[rank])
    return values[rank], vectors


def fit(x: DataFrame) -> Model | None:
    """The model of vectors (x); None where there are none."""
    first = _summed(x, lambda m: [np.array([len(m)]), m.astype(object).sum(axis=0) if np.abs(m).max(initial=0) > MOST // 1024 else m.sum(axis=0)])
    if not first:
        return None
    n, sums = first[0], first[1:]
    d = len(sums)
    if d > MOST_DIMENSIONS:
        raise ValueError(f"fit: vectors of {d} entries, {MOST_DIMENSIONS} at most")
    totals = _summed(x, _scatter([s // n for s in sums]))
    at, covariance, rest = np.triu_indices(d), np.zeros((d, d)), totals[-d:]
    for i, j, t in zip(*at, totals[:-d], strict=True):
        covariance[i, j] = covariance[j, i] = (n * t - rest[i] * rest[j]) / (n * n)
    values, vectors = decomposed(covariance)
    return Model(n, sums, values, vectors, float(np.trace(covariance)))


def _whitened(model: Model, most: int):
    n, middle = model.n, np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([s - model.n * int(m) for s, m in zip(model.sums, middle, strict=True)], float) / n
    turned = (model.vectors / np.sqrt(model.values))[:, :most]
    return lambda x: ((x - middle).astype(float) - rest) @ turned


def identity_error(x: DataFrame, model: Model, most: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity. A task centres its
    batches at their own mean; their rows (n, mean, scatter) are put together around the mean of all."""
    white = _whitened(model, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, 0.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            w = white(_matrix(batch))
            k, m = len(w), w.mean(axis=0)
            step = m - mean
            scatter = scatter + (w - m).T @ (w - m) + np.multiply.outer(step, step) * (n * k / (n + k))
            n, mean = n + k, mean + step * (k / (n + k))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([scatter.ravel().tolist()])], ["n", "mean", "scatter"])

    parts = materialize(x.select("x").mapInArrow(run, "n long, mean array<double>, scatter array<double>"), "moments")
    summed = lambda rows: [r["s"] for r in rows.groupBy("at").agg(F.sum("v").alias("s")).orderBy("at").collect()]
    mean = np.array(summed(parts.select(F.posexplode(F.transform("mean", lambda m: m * F.col("n"))).alias("at", "v")))) / model.n
    k = len(mean)
    if not k:
        return 0.0
    off = F.transform(F.arrays_zip("mean", F.array(*map(F.lit, mean.tolist())).alias("of")), lambda z: z["mean"] - z["of"])
    spread = parts.withColumn("off", off).select(F.posexplode(F.zip_with("scatter", F.flatten(F.transform("off", lambda a: F.transform("off", lambda b: a * b * F.col("n")))), lambda s, o: s + o)).alias("at", "v"))
    return float(np.abs(np.array(summed(spread)).reshape(k, k) / model.n - np.eye(k)).max())


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """(ident, component, n, deviation, whitened, explained, identity_error) of every remaining row and of each of
    the first ``most`` components.

    Rows whose vector is null, empty, or holds null or non-finite entries, or has another length than most
    vectors, are dropped; a null id stays. Components without variance can't be scaled and are left out, so
    equal vectors alone, like no rows, give no rows. A deviation beyond a long is null. Repeated rows count as often
    as they stand; other columns are ignored."""
    small_batches(rows.sparkSession)
    x = integers(rows, ident, vector)
    kind = dict(rows.dtypes)[ident]
    model = fit(x)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], f"`{ident}` {kind}, {_OUT}")
    k = min(most, len(model.values))
    error, white, n, share = identity_error(x, model, k), _whitened(model, k), model.n, model.values[:k] / model.trace
    sums = np.array(model.sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                m = _matrix(part)
                exact = n * m.astype(object) - sums
                most_ = int(np.abs(exact).max(initial=0))
                exact = exact.astype(np.int64) if most_ * most_ * m.shape[1] < 1 << 62 else exact
                away = [int(d) if int(d) < 1 << 63 else None for d in (exact * exact).sum(axis=1)]
                at = pa.array(np.repeat(np.arange(len(m)), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))), pa.array(np.full(len(m) * k, n)), pa.array(away, pa.int64()).take(at), pa.array(white(m).ravel()), pa.array(np.tile(share, len(m))), pa.array(np.full(len(m) * k, error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return x.mapInArrow(run, f"id {kind}, {_OUT}").withColumnRenamed("id", ident)
