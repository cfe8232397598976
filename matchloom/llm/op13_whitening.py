"""Operator 13: whitening of embeddings by a one-sided Jacobi singular value decomposition.

1. Vectors become whole numbers on a grid; one scan gives their number and exact sums.
2. Blockwise TSQR: each task folds its centred rows, block by block, into one triangular matrix, and
   these are folded in a tree on the cluster until one R is left. No covariance matrix is ever formed,
   so small standard deviations keep their digits.
3. Plane rotations make R's columns orthogonal (R has as many rows as a vector has entries). Their lengths over sqrt(n)
   are the standard deviations; the accumulated rotations are the components.
4. Rows are centred, projected and scaled where they are read.

Dropped: null vectors, empty ones and those that hold null, NaN, an infinity or what has no exact place on
the grid (2^52 or more there); where lengths differ, all but those of the commonest length (of several the largest). Repeated rows and null ids count like
others. A component without variance has a null `whitened` and 0 as `explained` (one vector, equal
vectors, fewer vectors than dimensions). `deviation` is null where it is no 64-bit number. An empty table gives no rows. Columns
are read by name, so extra ones do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import Scratch

#: The grid: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Rows that are folded at once, and matrices that are folded into one on each level of the tree.
BLOCK_ROWS, FAN_IN = 4096, 16


def on_grid(vectors: pa.Array, scale: int = SCALE, shift: int = SHIFT) -> tuple[np.ndarray, list[np.ndarray]]:
    """(each row's length, 0 if it is dropped; of each length that occurs, ascending, the rows on the grid)."""
    if pa.types.is_fixed_size_list(vectors.type):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    size = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    flat = vectors.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False) if not flat.null_count else flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(values) * scale < 1 << 52))])
    size = np.where(bad[ends] == bad[ends - size], size, 0)
    rows = []
    for d in np.unique(size[size > 0]).tolist():
        at = ends[size == d][:, None] - d + np.arange(d)
        rows.append(np.floor(values[at] * scale).astype(np.int64) + shift)
    return size, rows


def _sums(scale: int, shift: int):
    """vector -> dim, n, sums of each length in a task."""

    def run(batches):
        total: dict[int, list] = {}
        for b in batches:
            for x in on_grid(b.column(0), scale, shift)[1]:
                had = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
                had[0] += len(x)
                had[1] += x.sum(0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([s for _, s in total.values()], pa.list_(pa.int64()))], names=["dim", "n", "sums"])

    return run


def _rows_of(vectors: pa.Array, m: "Moments") -> tuple[np.ndarray, np.ndarray]:
    """(which rows are whitened, these on the grid)."""
    size, rows = on_grid(vectors, m.scale, m.shift)
    return size == m.dim, next((x for x in rows if x.shape[1] == m.dim), np.zeros((0, m.dim), np.int64))


@dataclass(frozen=True)
class Moments:
    """Number of vectors, their length, and the sum of each entry."""

    n: int
    dim: int
    sums: np.ndarray
    scale: int
    shift: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: whole and fractional part of the mean are taken off one after the other, so no digit is lost."""
        whole, rest = np.divmod(self.sums, self.n)
        return (x - whole).astype(np.float64) - rest / self.n


def moments(vectors: DataFrame, column: str, scale: int = SCALE, shift: int = SHIFT) -> Moments | None:
    parts = vectors.select(column).mapInArrow(_sums(scale, shift), "dim int, n long, sums array<long>")
    entries = parts.select("dim", "n", F.posexplode("sums").alias("at", "s")).groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by_dim = entries.groupBy("dim").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "s"))).alias("sums"))
    best = by_dim.orderBy(F.desc("n"), F.desc("dim")).first()  # one row, as long as a vector
    return best and Moments(best["n"], best["dim"], np.array([s for _, s in best["sums"]], np.int64), scale, shift)


def fold(blocks) -> np.ndarray | None:
    """R of the rows of all blocks."""
    r = None
    for b in blocks:
        for i in range(0, len(b), BLOCK_ROWS):
            r = np.linalg.qr(b[i : i + BLOCK_ROWS] if r is None else np.vstack([r, b[i : i + BLOCK_ROWS]]), mode="r")
    return r


def _triangle(m: Moments):
    """vectors -> one matrix a task."""

    def run(batches):
        r = fold(m.centred(x) for x in (_rows_of(b.column(0), m)[1] for b in batches) if len(x))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["block", "r"])

    return run


def _folded(dim: int):
    def run(key, table):
        mats = [np.frombuffer(x.as_buffer(), np.float64).reshape(-1, dim) for x in table.column("r")]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([fold(mats).tobytes()], pa.binary())})

    return run


def triangle(vectors: DataFrame, column: str, m: Moments) -> np.ndarray:
    """R of all centred rows: folded in tasks, then in a tree of FAN_IN."""
    scratch = Scratch(vectors.sparkSession)
    now = scratch.keep(vectors.select(column).mapInArrow(_triangle(m), "block long, r binary"), "triangles")
    while now.count() > 1:
        now = scratch.keep(now.withColumn("block", F.expr(f"block div {FAN_IN}")).groupBy("block").applyInArrow(_folded(m.dim), "block long, r binary"), "triangles")
    r = np.frombuffer(now.first()["r"], np.float64).reshape(-1, m.dim)
    scratch.clear()
    return r


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of d columns once, in rounds of pairs that share no column."""
    seats = list(range(d + d % 2))
    out = []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(a, b) for a, b in zip(seats[:half], seats[:half - 1:-1]) if a < d and b < d]
        out.append((np.array([min(p) for p in pairs], np.int64), np.array([max(p) for p in pairs], np.int64)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values falling, right singular vectors as columns) of r by one-sided rotations of its columns."""
    d = r.shape[1]
    order = np.argsort(-np.square(r).sum(0), kind="stable")
    a, v = r[:, order].copy(), np.eye(d)[:, order]
    small = np.sqrt(d) * np.finfo(float).eps
    tiny = np.square(r).sum() * small * small * small
    for _ in range(sweeps if d > 1 else 0):
        turned = False
        for p, q in _rounds(d):
            x, y = a[:, p], a[:, q]
            xx, yy, xy = np.square(x).sum(0), np.square(y).sum(0), (x * y).sum(0)
            some = (np.abs(xy) > small * np.sqrt(xx * yy)) & (np.minimum(xx, yy) > tiny)
            if not some.any():
                continue
            turned = True
            p, q, xx, yy, xy = p[some], q[some], xx[some], yy[some], xy[some]
            zeta = (yy - xx) / (2 * xy)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    sigma = np.sqrt(np.square(a).sum(0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


@dataclass(frozen=True)
class Whitening:
    """moments, components as columns, and the standard deviation of each (0 where the rows have no variance)."""

    moments: Moments
    components: np.ndarray
    deviations: np.ndarray
    trace: float

    def explained(self) -> np.ndarray:
        return np.square(self.deviations) / self.trace if self.trace else np.zeros_like(self.deviations)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Rows on the grid, whitened; NaN where there is no variance."""
        projected = self.moments.centred(x) @ self.components
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.deviations > 0, projected / self.deviations, np.nan)


def fit(vectors: DataFrame, column: str = "embedding", k: int | None = None, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """Of all vectors; the first k components (all of them if None). None if there is no vector."""
    m = moments(vectors, column, scale, shift)
    if m is None:
        return None
    sigma, v = jacobi(triangle(vectors, column, m))
    std = sigma / np.sqrt(m.n)
    std = np.where(sigma > sigma[0] * max(m.dim, 8) * np.finfo(float).eps, std, 0.0) if sigma[0] else np.zeros_like(sigma)
    k = min(k or m.dim, m.dim)
    return Whitening(m, v[:, :k], std[:k], float(np.square(sigma).sum() / m.n))


def _gram(w: Whitening):
    def run(batches):
        k = w.components.shape[1]
        total = np.zeros((k, k))
        for b in batches:
            z = w.apply(_rows_of(b.column(0), w.moments)[1])
            total += z.T @ z
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.float64())], names=["i", "j", "s"])

    return run


def identity_error(vectors: DataFrame, w: Whitening, column: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity (components with variance). Whitened rows have mean 0: they are centred by exact sums."""
    found = vectors.select(column).mapInArrow(_gram(w), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max((abs(r["s"] / w.moments.n - (r["i"] == r["j"])) for r in found if r["s"] == r["s"]), default=0.0)


def deviations(x: np.ndarray, m: Moments) -> list[int | None]:
    """Sum over the entries of (n * x - S)^2, exact; None beyond 64 bits."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    bound = m.n * most + int(np.abs(m.sums).max(initial=0))
    if bound < 1 << 62 and m.dim * int(np.abs(m.n * x - m.sums).max(initial=0)) ** 2 < 1 << 63:
        return np.square(m.n * x - m.sums).sum(1).tolist()
    exact = [sum((m.n * a - s) ** 2 for a, s in zip(row, m.sums.tolist())) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def _whitened(w: Whitening, error: float):
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches):
        k, explained = w.components.shape[1], w.explained()
        for b in batches:
            used, x = _rows_of(b.column(1), w.moments)
            if not len(x):
                continue
            ids = np.repeat(np.flatnonzero(used), k)
            z, dev = w.apply(x).ravel(), deviations(x, w.moments)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(ids)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(ids), w.moments.n), pa.int64()),
                    pa.array(dev, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(z, pa.float64(), mask=np.isnan(z)),
                    pa.array(np.tile(explained, len(x)), pa.float64()), pa.array(np.full(len(ids), error), pa.float64()),
                ], schema=schema,
            )

    return run


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = 8, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector and each of the first k components."""
    w = fit(vectors, column, k)
    if w is None:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    return vectors.select(F.col(vec_id).cast("long"), column).mapInArrow(_whitened(w, identity_error(vectors, w, column)), _RESULT)
