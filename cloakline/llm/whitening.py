"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation, the products made by Spark.

Entries become whole numbers ``floor(64 * c) + 1000000``; the fit list holds
each distinct vector once.  With X the centred fit list (one row a vector) the
steps alternate u = Xv and v = X'u:

    alpha[j] u[j]     = X v[j]  - beta[j-1] u[j-1]
    beta[j]  v[j + 1] = X' u[j] - alpha[j]  v[j]

The v are short and stay on the driver.  The u have one entry per row of X
and are never stored: X V = U R, with R the bidiagonal matrix and the small
corrections of the reorthogonalisation, so each task works out its rows' entries
of all u so far from the row, V and R.  One pass over the fit list thus gives
X'u, |u| and the products of u with all earlier u, against which it is
reorthogonalised (X'U = V R' carries the correction over to X'u); the next v is
reorthogonalised twice against all earlier v.  When a new direction vanishes,
the space found is closed under X'X; a random direction outside it starts the
next step, so equal eigenvalues are all found.  The steps end when no direction
is left; with ``early`` they end when the residuals of the wanted components are
at rounding level, which saves passes over long vectors and may miss a second
copy of an exactly equal eigenvalue.  The SVD of the small bidiagonal matrix gives the components and deviations.

A pass moves one row of at most 2 * dimension + 2 sums per task into a grouped
sum; the driver holds matrices of dimension x steps.

Defined cases: rows whose vector is null, or holds a null, NaN, infinite or
too large entry (64 * c outside +-2**52, where floor has no exact double), are
dropped.  So are rows whose vector has not the commonest length (ties: the
longest).  An empty vector is such a vector of length 0 and has no components.
Equal vectors share their result; rows that repeat an id are handled one by
one.  Only directions with a deviation above 1e-12 of the largest are
components, so there may be fewer than asked for, and none for fewer than two
distinct vectors.  A ``deviation`` over 2**63 - 1 is null (the contract's long
cannot hold it).  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.llm.common import written
from cloakline.session import read_table

SCALE, SHIFT, LARGEST = 64.0, 1_000_000, 2.0 ** 52
COMPONENTS = 16
SEED = 7
TINY = 1e-12           # of the largest deviation: below, a direction counts as constant
ROWS = 4096            # rows that numpy looks at together
OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


@dataclass(frozen=True)
class Whitening:
    """What the rows need: the mean is ``centre + rest / n``, both whole; components are columns of ``axes``."""

    n: int
    centre: np.ndarray      # floor of the mean
    rest: np.ndarray        # sums less n * centre
    axes: np.ndarray        # dimension x components
    variance: np.ndarray    # eigenvalues, falling
    trace: float
    identity_error: float = 0.0


def wholes(table: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the rows that can be used."""
    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < LARGEST))
    rows = table.where(F.col("embedding").isNotNull() & good)
    length = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    return (rows.where(F.size("embedding") == F.lit(length.length if length else 0))
            .select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            yield piece, _matrix(piece.column("x"), d)


def _centred(x: np.ndarray, w: Whitening) -> np.ndarray:
    """x less the mean: whole numbers first, so nothing cancels."""
    return (x - w.centre).astype(np.float64) - w.rest / w.n


def _summed(fit: DataFrame, d: int, work, size: int) -> np.ndarray:
    """Sum over all blocks of the fit list of ``work(block)``, an array of ``size`` doubles."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, x in _blocks(batches, d):
            total += work(x)
        yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "value"])

    rows = fit.mapInArrow(part, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for row in rows:
        out[row.at] = row.value
    return out


def _outside(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """v less its part in the span of the columns of ``basis`` (twice, for rounding)."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonal(fit: DataFrame, w: Whitening, k: int, early: bool) -> tuple[np.ndarray, np.ndarray]:
    """V (dimension x steps) and the upper bidiagonal matrix of the steps, for the first k components."""
    d = len(w.centre)
    rng = np.random.default_rng(SEED)
    basis, right, band = np.zeros((d, 0)), np.zeros((0, 0)), np.zeros((0, 0))  # right = band and corrections
    v, beta = rng.standard_normal(d), 0.0
    v /= np.linalg.norm(v)
    scale = 0.0
    while basis.shape[1] < d and w.n > 1:
        j = basis.shape[1]

        def step(x: np.ndarray, basis=basis, right=right, v=v, beta=beta, j=j) -> np.ndarray:
            c = _centred(x, w)
            p, u = c @ basis, np.zeros((len(c), j))
            for i in range(j):  # U from X V = U R, column by column; a closed column stays 0
                if right[i, i]:
                    u[:, i] = (p[:, i] - u[:, :i] @ right[:i, i]) / right[i, i]
            new = c @ v - (beta * u[:, j - 1] if j else 0.0)
            return np.concatenate([c.T @ new, u.T @ new, [new @ new]])

        got = _summed(fit, d, step, d + j + 1)
        back, along, norm2 = got[:d], got[d:-1], got[-1]
        if j:  # u is reorthogonalised against all before, of which X'U = V B' with the newest v
            back = back - basis @ (band.T @ along) - beta * along[-1] * v
        alpha = float(np.sqrt(max(norm2 - along @ along, 0.0)))
        scale = max(scale, alpha, beta)
        closed = alpha <= TINY * scale or not scale
        grown, banded = np.zeros((j + 1, j + 1)), np.zeros((j + 1, j + 1))
        grown[:j, :j], banded[:j, :j] = right, band
        grown[:j, j] = along
        if j:
            grown[j - 1, j] += beta
            banded[j - 1, j] = beta
        grown[j, j] = banded[j, j] = 0.0 if closed else alpha
        restarted = beta == 0.0
        basis, right, band = np.column_stack([basis, v]), grown, banded
        if closed and restarted:
            break  # a random direction outside the space gives nothing: nor does any other
        after = np.zeros(d) if closed else _outside(back / alpha - alpha * v, basis)
        beta = float(np.linalg.norm(after))
        if beta <= TINY * scale:
            after, beta = _outside(rng.standard_normal(d), basis), 0.0
            if basis.shape[1] == d:
                break
            v = after / np.linalg.norm(after)
            continue
        v = after / beta
        if early and j > k:
            left, value, _ = np.linalg.svd(band)
            if (beta * np.abs(left[-1, :k]) <= 1e-14 * value[0]).all():
                break
    return basis, band


def fit(table: DataFrame, k: int = COMPONENTS, early: bool = False) -> tuple[DataFrame, Whitening | None]:
    """The usable rows and the whitening of their distinct vectors."""
    rows = written(wholes(table), "wholes")
    distinct = written(rows.select("x").groupBy("x").agg(F.lit(1).alias("_")).select("x"), "fit")
    first = distinct.select(F.size("x").alias("d")).first()
    d = first.d if first else 0
    if not d:
        return rows, None
    sums = distinct.select(F.posexplode("x").alias("at", "value"))
    sums = sums.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("sum")).collect()
    total = {r.at: int(r["sum"]) for r in sums}
    n = sums[0].n
    centre = np.array([total[i] // n for i in range(d)], np.int64)
    w = Whitening(n, centre, np.array([total[i] % n for i in range(d)], np.int64), np.zeros((d, 0)), np.zeros(0), 0.0)
    basis, band = bidiagonal(distinct, w, k, early)
    _, value, turn = np.linalg.svd(band) if len(band) else (None, np.zeros(0), np.zeros((0, 0)))
    live = value[:k] > TINY * max(value.max(initial=0.0), 1e-300)
    axes = (basis @ turn.T[:, :k])[:, live] if len(value) else basis
    variance = value[:k][live] ** 2 / n
    m = len(variance)
    # one more pass: the trace, and the covariance of the whitened fit list
    half = Whitening(n, w.centre, w.rest, axes, variance, 0.0)

    def moments(x: np.ndarray) -> np.ndarray:
        c = _centred(x, half)
        y = c @ axes / np.sqrt(variance)
        return np.concatenate([[(c * c).sum()], y.sum(axis=0), (y.T @ y).ravel()])

    got = _summed(distinct, d, moments, 1 + m + m * m)
    mean = got[1:1 + m] / n
    cov = got[1 + m:].reshape(m, m) / n - np.outer(mean, mean)
    return rows, Whitening(n, w.centre, w.rest, axes, variance, got[0] / n, float(np.abs(cov - np.eye(m)).max(initial=0.0)))


def deviations(x: np.ndarray, w: Whitening) -> list[int | None]:
    """Sum over the dimensions of (n * x - sum)**2, exact; None where a long cannot hold it."""
    far = np.abs(x - w.centre).max(initial=0) + 1
    if float(w.n) * float(far) < 2.0 ** 31 and x.shape[1] * (float(w.n) * float(far)) ** 2 < 2.0 ** 62:
        return ((w.n * (x - w.centre) - w.rest) ** 2).sum(axis=1).tolist()
    rest = w.rest.tolist()
    out = (sum((w.n * a - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in (x - w.centre).tolist())
    return [v if v < 1 << 63 else None for v in out]


def whitened(table: DataFrame, k: int = COMPONENTS, early: bool = False) -> DataFrame:
    """Rows OUT: each usable row of ``table`` (vec_id, embedding) on each of the first k components."""
    rows, w = fit(table, k, early)
    if w is None or not len(w.variance):
        return table.sparkSession.createDataFrame([], OUT)
    d, m = len(w.centre), len(w.variance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, d):
            r = len(x)
            each = pa.array(np.repeat(np.arange(r), m))
            yield pa.record_batch([
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), r)),
                pa.array(np.full(r * m, w.n, np.int64)), pa.array(deviations(x, w), pa.int64()).take(each),
                pa.array((_centred(x, w) @ w.axes / np.sqrt(w.variance)).ravel()),
                pa.array(np.tile(w.variance / w.trace, r)), pa.array(np.full(r * m, w.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, OUT)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read_table(spark, sf_dir, "embeddings"))
