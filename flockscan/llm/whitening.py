"""Embedding whitening: eigenvectors in float32, refined by matrix products in higher precision.

Vectors are counted in whole 256ths, so the sums and products over all of them are integers
and exact, however the rows are dealt over tasks. The covariance is found in two passes: sums
first, then products of what is centred. Its eigenvectors are found in float32 and
corrected by Ogita-Aishima iterations, matrix products alone in extended precision, each of
which doubles the number of right digits. Where eigenvalues lie so close that the correction
can't tell their vectors apart, the covariance is projected on the cluster, and this small
problem, with its large common part taken off, is solved and refined by itself.

Only matrices of the dimension's size reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockscan.llm.words import spare_name
from flockscan.storage import save

COMPONENTS = 4
# Entries are counted in these parts of one; a larger entry than ``LARGEST`` parts is none.
PARTS, LARGEST = 256, 1 << 61
# Bits of a limb, rows multiplied at once: products of limbs add up without rounding below 2^53.
LIMB, ROWS = 20, 4_096
# Partial sums added up by one task.
FAN = 64
ROUNDS, PATIENCE = 40, 3

# Eigenvectors

High = np.longdouble


def _corrected(matrix: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """``(values, correction, bound)`` of approximate eigenvectors, as by Ogita and Aishima.

    Values closer than the bound are not told apart: their vectors are only made orthogonal.
    """
    eye = np.eye(basis.shape[1], dtype=High)
    lack = eye - basis.T @ basis
    projected = basis.T @ (matrix @ basis)
    # Rounding that differs on both sides would be blown up by small gaps.
    projected = (projected + projected.T) / 2
    values = np.diag(projected) / (1 - np.diag(lack))
    off = projected - np.diag(values)
    bound = 2 * (np.linalg.norm(off.astype(float)) + np.abs(values).max() * np.linalg.norm(lack.astype(float)))
    gap = values[None, :] - values[:, None]
    # Nor are values that differ by rounding alone.
    far = np.abs(gap) > max(bound, len(basis) * np.finfo(High).eps * np.abs(values).max())
    correction = np.where(far, (projected + lack * values[None, :]) / np.where(far, gap, 1), lack / 2)
    np.fill_diagonal(correction, np.diag(lack) / 2)
    return values, correction, float(bound)


def _refined(matrix: np.ndarray, basis: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """``(values, basis)`` after corrections until they no longer help.

    A correction may be larger than the one before, as close values are told apart later.
    """
    best, found, worse = math.inf, (np.zeros(basis.shape[1], High), basis), 0
    for _ in range(rounds):
        values, correction, bound = _corrected(matrix, basis)
        worse = 0 if bound < best / 2 else worse + 1
        if bound < best:
            best, found = bound, (values, basis)
        if worse > PATIENCE or not np.isfinite(bound):
            break
        basis = basis + basis @ correction
    return found


def _clusters(values: np.ndarray, bound: float) -> list[np.ndarray]:
    """Runs of values, in falling order, each closer than ``bound`` to the next."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(-np.diff(values[order]) > bound) + 1
    return np.split(order, cuts)


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(values, vectors)`` of a symmetric matrix in extended precision, largest value first.

    Vectors are the columns. Those of equal values are any orthonormal basis of their space.
    """
    matrix = matrix.astype(High)
    n = len(matrix)
    scale = np.abs(matrix).max(initial=0)
    if not n or not scale:
        return np.zeros(n, High), np.eye(n, dtype=High)
    matrix = matrix / scale
    _, start = np.linalg.eigh(matrix.astype(np.float32))
    values, basis = _refined(matrix, start.astype(High))
    # What float32 can't tell apart may be one cluster; it is solved again without its common part.
    close = 64 * n * float(np.finfo(np.float32).eps) * float(np.abs(values).max())
    for _ in range(3):
        parts = [c for c in _clusters(values, close) if len(c) > 1]
        if not parts:
            break
        for own in parts:
            span = basis[:, own]
            middle = values[own].mean()
            small = span.T @ (matrix @ span - middle * span)
            small = (small + small.T) / 2
            size = np.abs(small).max()
            if size:
                _, turn = np.linalg.eigh((small / size).astype(float))
                _, turn = _refined(small / size, turn.astype(High))
                basis[:, own] = span @ turn
        values, basis = _refined(matrix, basis)
        close *= float(np.finfo(np.float32).eps)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, basis[:, order]


# Exact sums over all rows

PARTIAL = "n long, sums binary"


def _matrix(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    """The integer vectors of a batch as rows."""
    return np.asarray(batch.column("x").flatten(), np.int64).reshape(-1, dimension)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the sums of all partial sums."""
    n, total = 0, None
    for batch in batches:
        for rows, cell in zip(batch.column("n").to_pylist(), batch.column("sums"), strict=True):
            n += rows
            own = np.frombuffer(cell.as_buffer(), np.int64)
            total = own.copy() if total is None else total + own
    if total is not None:
        # Low halves that ran over 32 bits carry into the high ones.
        high, low = total.reshape(2, -1)
        total = np.concatenate([high + (low >> 32), low & 0xFFFFFFFF])
        yield _partial(n, total)


def _partial(n: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([n], pa.int64()), pa.array([sums.astype("<i8").tobytes()], pa.binary())], ["n", "sums"])


def _halves(sums: np.ndarray) -> np.ndarray:
    """High and low 32 bits, which can be added many times without running over."""
    flat = sums.reshape(-1)
    return np.concatenate([flat >> 32, flat & 0xFFFFFFFF])


def _whole(rows: DataFrame) -> tuple[int, list[int]]:
    """``(n, sums)`` over all partial sums, added up by tasks of a few each until one is left."""
    found = save(rows, "sums")
    while found.rows > 1:
        tasks = -(-found.rows // FAN)
        parts = found.frame.coalesce(1) if tasks == 1 else found.frame.repartition(tasks)
        found = save(parts.mapInArrow(_added, PARTIAL), "sums")
    row = found.frame.first()
    if row is None:
        return 0, []
    high, low = np.frombuffer(row["sums"], "<i8").reshape(2, -1)
    return row["n"], [(h << 32) + m for h, m in zip(high.tolist(), low.tolist(), strict=True)]


def _sums(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[pa.RecordBatch]:
    n, total = 0, np.zeros(2 * dimension, np.int64)
    for batch in batches:
        x = _matrix(batch, dimension)
        n += len(x)
        total += np.concatenate([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])
    yield _partial(n, total)


def _limbs(c: np.ndarray, count: int) -> list[np.ndarray]:
    """Signed digits of ``LIMB`` bits, lowest first, exact as doubles."""
    out = []
    for _ in range(count - 1):
        low = c & ((1 << LIMB) - 1)
        out.append(low.astype(np.float64))
        c = c >> LIMB
    return [*out, c.astype(np.float64)]


def _products(batches: Iterator[pa.RecordBatch], centre: np.ndarray, count: int) -> Iterator[pa.RecordBatch]:
    """Sums of products of centred entries, one matrix for each sum of two limbs' places."""
    dimension = len(centre)
    n, total = 0, np.zeros((2, (2 * count - 1) * dimension * dimension), np.int64)
    for batch in batches:
        x = _matrix(batch, dimension)
        n += len(x)
        for low in range(0, len(x), ROWS):
            limbs = _limbs(x[low : low + ROWS] - centre, count)
            for i, a in enumerate(limbs):
                for j, b in enumerate(limbs):
                    part = slice((i + j) * dimension**2, (i + j + 1) * dimension**2)
                    total[:, part] += _halves((a.T @ b).astype(np.int64)).reshape(2, -1)
    yield _partial(n, total.reshape(-1))


@dataclass
class Whitening:
    """What is fitted: ``n`` vectors with sums ``S``, and the components of their covariance."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        """The whole numbers nearest to the mean."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def rest(self) -> np.ndarray:
        """What the sums exceed the centre by, times ``n``."""
        return np.array([s - self.n * int(m) for s, m in zip(self.sums, self.centre, strict=True)], object)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components, each of variance one over what was fitted."""
        offset = np.array([float(High(int(r)) / High(self.n)) for r in self.rest()])
        centred = (x - self.centre).astype(np.float64) - offset
        return centred @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of ``(n x - S)^2`` of each row; null beyond a long."""
        c, rest = x - self.centre, self.rest().astype(object)
        most = self.n * int(np.abs(c).max(initial=0)) + max((abs(int(r)) for r in rest), default=0)
        if most * most * max(len(rest), 1) < 2**63:
            d = c * self.n - rest.astype(np.int64)
            return (d * d).sum(1).tolist()
        exact = ((c.astype(object) * self.n - rest) ** 2).sum(1)
        return [int(v) if v < 2**63 else None for v in exact]


def whole_vectors(vectors: DataFrame, vector: str) -> tuple[DataFrame, Column]:
    """``vectors`` with an array of longs in a column of its own name, without unusable rows."""
    name = spare_name(vectors, "x")
    entries = F.col(f"`{vector}`")
    scaled = F.transform(entries, lambda c: F.lit(float(PARTS)) * c.cast("double"))
    fits = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(LARGEST)))
    usable = entries.isNotNull() & (F.size(entries) > 0) & fits
    x = F.transform(scaled, lambda c: F.floor(c).cast("long"))
    return vectors.filter(usable).withColumn(name, x), F.col(name)


def fit_whitening(fit: DataFrame, dimension: int, spread: int, components: int = COMPONENTS) -> Whitening:
    """Components of the covariance of ``fit(x)``, arrays of ``dimension`` longs up to ``spread`` in size."""
    n, sums = _whole(fit.mapInArrow(lambda batches: _sums(batches, dimension), PARTIAL))
    plain = Whitening(n, sums, 0.0, np.empty(0), np.empty((dimension, 0)))
    if not n:
        return plain
    centre = plain.centre
    # Signed digits that hold twice the largest entry.
    count = max(1, -(-((2 * spread).bit_length() + 1) // LIMB))
    _, products = _whole(fit.mapInArrow(lambda batches: _products(batches, centre, count), PARTIAL))
    own = np.array(products, object).reshape(2 * count - 1, dimension, dimension)
    total = sum(own[i] << (LIMB * i) for i in range(2 * count - 1))
    rest = plain.rest()
    # n^2 times the covariance, exact; it is rounded once.
    exact = total * n - np.outer(rest, rest)
    square = High(n) * High(n)
    matrix = np.array([[High(str(v)) / square for v in row] for row in exact.tolist()], High)
    values, vectors = eigen(matrix)
    # A component without variance can't be whitened.
    kept = np.flatnonzero(values > values.max(initial=0) * dimension * float(np.finfo(np.float64).eps))[:components]
    trace = float(np.trace(matrix))
    return Whitening(n, sums, trace, values[kept].astype(float), vectors[:, kept].astype(float))


def _moments(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    """Counts, sums and products of whitened rows."""
    k = len(model.values)
    n, total, square = 0, np.zeros(k), np.zeros((k, k))
    for batch in batches:
        w = model.whitened(_matrix(batch, len(model.sums)))
        n, total, square = n + len(w), total + w.sum(0), square + w.T @ w
    moments = np.concatenate([total, square.reshape(-1)]).astype("<f8")
    yield pa.record_batch([pa.array([n], pa.int64()), pa.array([moments.tolist()], pa.list_(pa.float64()))], ["n", "m"])


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry by which the covariance of the whitened rows is off the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    rows = fit.mapInArrow(lambda batches: _moments(batches, model), "n long, m array<double>")
    entries = rows.select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    found = np.array([v for _, v in sorted(map(tuple, entries.collect()))]) / model.n
    mean, square = found[:k], found[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def _project(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    for batch in batches:
        x = _matrix(batch, len(model.sums))
        row = np.repeat(np.arange(len(x)), k)
        yield pa.record_batch(
            [
                batch.column("vec_id").take(pa.array(row)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(row)),
                pa.array(model.whitened(x).reshape(-1)),
                pa.array(np.tile(model.values / model.trace if k else model.values, len(x))),
            ],
            ["vec_id", "component", "deviation", "whitened", "explained"],
        )


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` by row and component.

    Entries c become whole numbers floor(256 c). The fit takes each distinct vector of
    whole numbers once: ``n`` of them with sums S. Components are the unit eigenvectors of their
    covariance (divisor n), numbered from 1 by falling eigenvalue; ``whitened`` is the centred
    vector projected on one, over the root of its eigenvalue, ``explained`` the eigenvalue's
    share of the trace, ``deviation`` the exact sum of (n x - S)^2, ``identity_error`` the
    largest entry by which the covariance of ``whitened`` over the fit is off the identity.

    Rows are left out whose vector is null or empty or holds a null or non-finite entry, or
    one of 2^53 and more. The dimension is the most frequent length (of equals the largest);
    vectors of other lengths are left out too. A component without variance is not given,
    so equal vectors alone give no rows. ``deviation`` is null beyond a long. Repeated rows and
    null ids each give their rows. Other columns are ignored; an empty table gives an empty one.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    usable, x = whole_vectors(vectors, vector)
    whole = usable.select("vec_id", x.alias("x"))
    largest = F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))
    lengths = whole.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(largest).alias("most"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    dimension, most = (top["d"], top["most"]) if top else (1, 0)
    whole = whole.filter(F.size("x") == dimension)
    fit = save(whole.select("x").distinct(), "fit").frame
    model = fit_whitening(fit, dimension, most, components)
    error = identity_error(fit, model)
    projected = whole.mapInArrow(
        lambda batches: _project(batches, model),
        f"vec_id {kind}, component int, deviation long, whitened double, explained double",
    )
    return projected.select(
        "vec_id",
        "component",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        "explained",
        F.lit(error).alias("identity_error"),
    )
