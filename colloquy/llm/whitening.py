"""Embedding whitening by incremental eigendecomposition.

A vector's entries become whole numbers ``floor(64 c) + SHIFT``, so its sums are exact.  The eigendecomposition of the covariance
comes from rank-one updates alone:

1. Each partition keeps a spectrum: rows, mean, eigenvalues and eigenvectors of its scatter.  A vector x at distance d from the mean of the n before it adds
   ``n / (n + 1) d d'`` to the scatter: a centred rank-one update.  Its new eigenvalues are the roots of a secular equation between the old ones; entries
   that vanish and eigenvalues that (nearly) coincide are deflated first, and the eigenvectors are those of the update that has exactly the roots found
   (Löwner's formula), which keeps them orthogonal.  What is outside the span of the eigenvectors so far is a new direction of eigenvalue zero.
   Equal vectors that follow each other are one update.
2. Spectra are combined by updates, too: an eigenpair of one is a rank-one update ``e v v'`` of the other, the distance of the means one more.  ``FAN`` spectra
   meet in a task, round after round, until one is left; it is as large as its dimension squared, however many rows there are.
3. Rayleigh-Ritz refinement: all vectors, centred exactly, are projected on the basis, their second moments are added up by partition, and the small
   matrix that comes out turns the basis; this is repeated until the basis stays as it is, to double precision (one or two passes).

Whitened rows are then one more pass, and the identity error another one over what it wrote.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import Stored, cut, positional

SCALE, SHIFT = 64, 1_000_000
#: Components that are returned at most.
COMPONENTS = 32
#: Spectra that meet in one task.
FAN = 16
#: Passes of the refinement at most; share of the trace below which an eigenvalue is nothing.
PASSES, NOTHING = 6, 1e-12
_EPS = np.finfo(float).eps


def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``diag(d) + z z'`` for rising, different d and z without zeros.

    Each root is sought as a distance from the nearer pole of its interval, so that its distance from both is known to full
    relative precision.  Steps fit a rational function with the two poles that bound the root; a step that leaves the bracket halves it."""
    n = len(d)
    w = z * z
    high = np.append(d[1:], d[-1] + w.sum())
    if n == 1:
        return np.array([d[0] + w[0]]), np.ones((1, 1))
    middle = (d + high) / 2
    gap = d[:, None] - d  # gap[i, j] = d[i] - d[j]
    k = np.arange(n)
    left = 1 + (w[:, None] / (d[:, None] - middle)).sum(0) >= 0  # the root is in the half near its own pole
    left[-1] = True
    origin = np.where(left, k, np.minimum(k + 1, n - 1))
    delta = gap[:, origin]  # d[i] - the origin of root k
    half = middle - d[origin]
    low, up = np.where(left, 0.0, half), np.where(left, half, 0.0)
    up[-1] = high[-1] - d[-1]
    if 1 + (w / (d - middle[-1])).sum() < 0:
        low[-1] = half[-1]
    else:
        up[-1] = half[-1]
    t = (low + up) / 2
    below = k[:, None] <= k
    near, far = delta[k, k], delta[np.minimum(k + 1, n - 1), k]
    for _ in range(80):
        diff = delta - t
        term = w[:, None] / diff
        slope = term / diff
        f, slopes = 1 + term.sum(0), slope.sum(0)
        done = np.abs(f) <= 4 * _EPS * (1 + np.abs(term).sum(0) + np.abs(t) * slopes)  # as far as f and t are known
        if done.all():
            break
        low, up = np.where(f < 0, t, low), np.where(f < 0, up, t)
        psi = np.where(below, slope, 0).sum(0)
        phi = slopes - psi
        x, y = near - t, far - t
        y[-1] = 1.0
        phi[-1] = 0.0
        # f is fitted by c + s / (near - t) + r / (far - t), with the slopes of both sums
        c = f - x * psi - y * phi
        a = (x + y) * f - x * y * (psi + phi)
        b = x * y * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = (f * x / c)[-1]
            new = t + step
        fine = (new > low) & (new < up)
        t = np.where(done, t, np.where(fine, new, (low + up) / 2))
    diff = delta - t  # d[i] - root k
    roots = d[origin] + t
    # the z that has exactly these roots: z[i]^2 = prod_k (root k - d[i]) / prod_{k != i} (d[k] - d[i])
    ratio = np.ones((n, n))
    ratio[:, :-1] = -diff[:, :-1]
    other = -gap.copy()  # other[i, j] = d[j] - d[i]
    lowers = np.tril(np.ones((n, n), bool), -1)  # j < i meets root j, j > i meets root j - 1
    product = np.where(lowers, ratio / np.where(lowers, other, 1), 1).prod(1)
    shifted = np.zeros((n, n))
    shifted[:, 1:] = ratio[:, :-1]
    uppers = lowers.T
    product *= np.where(uppers, shifted / np.where(uppers, other, 1), 1).prod(1)
    exact = np.sqrt(np.abs(product * -diff[:, -1]))
    vectors = np.copysign(exact, z)[:, None] / diff
    return roots, vectors / np.sqrt((vectors * vectors).sum(0))


def updated(values: np.ndarray, basis: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of ``basis diag(values) basis' + (basis z)(basis z)'``, with deflation."""
    size = float(np.sqrt(z @ z))
    if not size:
        return values, basis
    tiny = 8 * _EPS * max(abs(values[-1]), size * size)
    close = np.flatnonzero(np.diff(values) <= tiny)
    if len(close):
        z, basis = z.copy(), basis.copy()
        for i in close.tolist():  # a rotation of two directions of one eigenvalue leaves the update in one of them
            r = float(np.hypot(z[i], z[i + 1]))
            if r:
                c, s = z[i + 1] / r, z[i] / r
                z[i], z[i + 1] = 0.0, r
                basis[:, i], basis[:, i + 1] = c * basis[:, i] - s * basis[:, i + 1], s * basis[:, i] + c * basis[:, i + 1]
    active = np.abs(z) * size > tiny
    if not active.any():
        return values, basis
    roots, turn = secular(values[active], z[active])
    values, new = values.copy(), basis.copy()
    values[active] = roots
    new[:, active] = basis[:, active] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], new[:, order]


class Spectrum:
    """Rows, mean, and the eigenpairs of the scatter of what was added."""

    def __init__(self, dim: int, n: float = 0, mean=None, values=None, basis=None):
        self.n, self.dim = n, dim
        self.mean = np.zeros(dim) if mean is None else np.array(mean, float)
        self.values = np.zeros(0) if values is None else np.array(values, float)
        self.basis = np.zeros((dim, 0)) if basis is None else np.array(basis, float).reshape(dim, -1)
        self.todo = 0

    def rank_one(self, v: np.ndarray) -> None:
        """Adds v v' to the scatter."""
        z = self.basis.T @ v
        rest = v - self.basis @ z
        if len(self.values) < self.dim:
            again = self.basis.T @ rest
            rest -= self.basis @ again
            z = z + again
            size = float(np.sqrt(rest @ rest))
            if size > 1e-10 * float(np.sqrt(v @ v)):
                self.values = np.append(0.0, self.values)
                self.basis = np.column_stack((rest / size, self.basis))
                z = np.append(size, z)
        if len(z):
            self.values, self.basis = updated(self.values, self.basis, z)
        self.todo += 1
        if self.todo >= 512 and len(self.values):  # rounding of many updates
            self.basis, self.todo = np.linalg.qr(self.basis)[0], 0

    def add(self, x: np.ndarray, times: int = 1) -> None:
        """Adds a vector, as often as said."""
        away = x - self.mean
        if self.n:
            self.rank_one(away * np.sqrt(self.n * times / (self.n + times)))
        self.n += times
        self.mean += away * (times / self.n)

    def add_block(self, x: np.ndarray) -> None:
        """Adds many vectors: an orthogonal rotation leaves as many rows of the same scatter as there are dimensions, each of them a rank-one update."""
        mean = x.mean(0)
        rows = np.linalg.qr(x - mean, mode="r")
        other = Spectrum(self.dim, len(x), mean)
        if not self.n:
            self.n, self.mean = other.n, other.mean
        else:
            self.join(other)
        for row in rows:
            self.rank_one(row)

    def join(self, other: Spectrum) -> None:
        """Adds all that is in another spectrum."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.values, self.basis = other.n, other.mean, other.values, other.basis
            return
        for e, v in zip(other.values, other.basis.T, strict=True):
            if e > 0:
                self.rank_one(np.sqrt(e) * v)
        away = other.mean - self.mean
        self.rank_one(away * np.sqrt(self.n * other.n / (self.n + other.n)))
        self.n += other.n
        self.mean = self.mean + away * (other.n / self.n)

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"n": int(self.n), "mean": self.mean.tolist(), "values": self.values.tolist(), "basis": self.basis.ravel().tolist()}], _ROW)


_ROW = pa.schema([("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("values", pa.list_(pa.float64())), ("basis", pa.list_(pa.float64()))])
_SPECTRUM = "n long, mean array<double>, values array<double>, basis array<double>"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>): the rows that count, as whole numbers; of vectors of several lengths those of the most frequent one (the longest of equally frequent ones)."""
    rows, new, _ = positional(vectors, "vec_id", "embedding")
    e = F.transform(new["embedding"], lambda c: c.cast("double"))
    fine = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.select(F.col(new["vec_id"]).alias("vec_id"), e.alias("e")).where(F.col("e").isNotNull() & (F.size("e") > 0) & fine)
    lengths = rows.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size("e") == (lengths.d if lengths else 0))
    return rows.select("vec_id", F.transform("e", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """The lists of a column, all of one length and without nulls, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _spectra(fold: int):
    def run(batches):
        s = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x")) - SHIFT
            s = s or Spectrum(x.shape[1])
            if fold > 1:
                for low in range(0, len(x), fold):
                    s.add_block(x[low : low + fold].astype(float))
                continue
            new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(1)))
            for row, times in zip(x[new].astype(float), np.diff(np.append(new, len(x))).tolist(), strict=True):
                s.add(row, times)
        if s:
            yield s.row()

    return run


def _joined(table: pa.Table) -> pa.Table:
    rows = table.sort_by([("n", "descending")]).to_pylist()
    s = Spectrum(len(rows[0]["mean"]))
    for r in rows:
        s.join(Spectrum(s.dim, r["n"], r["mean"], r["values"], r["basis"]))
    return pa.Table.from_batches([s.row()])


def spectrum(x: DataFrame, fold: int = 1) -> Spectrum | None:
    """The spectrum of all rows: one of each partition, combined ``FAN`` at a time.  The mean is that of x - SHIFT.

    With a ``fold`` of some thousands a partition rotates so many vectors into as many updates as there are dimensions: the
    same scatter by far fewer updates, for tables where an update of each vector (about a millisecond at 64 dimensions) is too slow."""
    got = cut(x.select("x").mapInArrow(_spectra(fold), _SPECTRUM).withColumn("g", F.monotonically_increasing_id()))
    left = got.count()
    while left > 1:
        groups = -(-left // FAN)
        got = cut(got.withColumn("g", F.pmod(F.xxhash64("g"), F.lit(groups))).groupBy("g").applyInArrow(_joined, _SPECTRUM).withColumn("g", F.monotonically_increasing_id()))
        left = got.count()
    row = got.first()
    return Spectrum(len(row["mean"]), row["n"], row["mean"], row["values"], row["basis"]) if row else None


def _moments(n: int, sums: list[int], basis: np.ndarray):
    mean = np.array([s // n for s in sums]), np.array([(s % n) / n for s in sums])

    def run(batches):
        total = np.zeros((basis.shape[1],) * 2)
        for batch in batches:
            if batch.num_rows:
                y = ((matrix(batch.column("x")) - mean[0]) - mean[1]) @ basis
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[0])), pa.array(list(total))], names=["i", "row"])

    return run


def _added(df: DataFrame, width: int) -> np.ndarray:
    """The sum of matrices of (i, row), by Spark."""
    sums = df.groupBy("i").agg(*[F.sum(F.col("row")[k]).alias(f"s{k}") for k in range(width)]).collect()
    out = np.zeros((width, width))
    for r in sums:
        out[r[0]] = r[1:]
    return out


def refined(x: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance (falling) and eigenvectors: Rayleigh-Ritz over all rows until the basis stays."""
    for _ in range(PASSES):
        basis = np.linalg.qr(basis)[0]
        width = basis.shape[1]
        v = _added(x.select("x").mapInArrow(_moments(n, sums, basis), "i long, row array<double>"), width) / n
        v = (v + v.T) / 2
        values, turn = np.linalg.eigh(v)
        values, turn = values[::-1], turn[:, ::-1]
        off = np.abs(v - np.diag(np.diag(v))).max(initial=0)
        basis = basis @ turn
        if off <= 64 * _EPS * max(np.trace(v), 1e-300):
            break
    return values, basis


class Whitening:
    """What is needed to whiten a vector: rows, exact sums, variances and components (columns), explained shares."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, basis: np.ndarray, trace: float):
        self.n, self.sums, self.trace = n, sums, trace
        some = values > NOTHING * max(trace, 1e-300)
        self.values, self.basis = values[some], basis[:, some]


def fit(x: DataFrame, components: int = COMPONENTS, fold: int = 1) -> Whitening | None:
    """The whitening of the covariance of x(vec_id, x); None without rows.  Directions without variance are no components."""
    s = spectrum(x, fold)
    if s is None:
        return None
    n = int(s.n)
    dims = range(s.dim)
    got = x.agg(*[F.sum(F.col("x")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in dims]).first()
    sums = [int(v) for v in got]
    full = np.linalg.qr(np.column_stack((s.basis[:, ::-1], np.eye(s.dim))))[0][:, : s.dim]  # directions that no update has met
    values, basis = refined(x, n, sums, full)
    w = Whitening(n, sums, values, basis, float(values.sum()))
    w.values, w.basis = w.values[:components], w.basis[:, :components]
    return w


def _whiten(w: Whitening):
    whole, rest = np.array([s // w.n for s in w.sums]), np.array([s % w.n for s in w.sums])
    turn = w.basis / np.sqrt(w.values)

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                away = matrix(part.column("x")) - whole
                white = (away - rest / w.n) @ turn
                far = int(np.abs(away).max()) + 1
                if far * w.n < 2**31 and (far * w.n) ** 2 * away.shape[1] < 2**63:
                    d = w.n * away - rest
                    deviation = pa.array((d * d).sum(1))
                else:
                    exact = [sum((w.n * int(a) - int(r)) ** 2 for a, r in zip(row, rest, strict=True)) for row in away]
                    deviation = pa.array([v if v < 2**63 else None for v in exact], pa.int64())
                flat = pa.array(white.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, white.shape[1], dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), deviation, lists], names=["vec_id", "deviation", "whitened"])

    return run


def transform(x: DataFrame, w: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened array<double>): a row for each row of x."""
    return x.mapInArrow(_whiten(w), f"vec_id {x.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>")


def _products(batches):
    total = None
    for batch in batches:
        if batch.num_rows:
            y = matrix(batch.column("whitened"))
            y = np.column_stack((y, np.ones(len(y))))
            total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total))], names=["i", "row"])


def identity_error(white: DataFrame, n: int, components: int) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity."""
    m = _added(white.select("whitened").mapInArrow(_products, "i long, row array<double>"), components + 1) / n
    mean = m[-1, :-1]
    return float(np.abs(m[:-1, :-1] - np.outer(mean, mean) - np.eye(components)).max(initial=0))


def report(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each vector that counts and component.

    Vectors that are null or empty, hold null or non-finite entries, or are not of the most frequent length are dropped.  Repeated rows and null ids each
    count.  Directions without variance are no components, so equal vectors alone, one vector or an empty table give no rows.  Of equal eigenvalues any
    basis of their space is taken, the same for all rows.  A deviation beyond a long is null.  Other columns are ignored."""
    kind = vectors.schema[[c for c in vectors.columns if c.lower() == "vec_id"][0]].dataType.simpleString()
    x = whole_numbers(vectors)
    w = fit(x, components)
    if w is None or not len(w.values):
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = Stored(transform(x, w)).df
    error = identity_error(white, w.n, len(w.values))
    share = F.array(*[F.lit(float(v / w.trace)) for v in w.values])
    out = white.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"))
