"""Embedding whitening by block Jacobi-Davidson (operator 11).

The covariance matrix is never formed. Vectors are turned into whole numbers, the
distinct ones are stored once as packed blocks, and every product of the centred
covariance with a group of directions is one Spark pass over those blocks. The
driver holds directions (dimensions x wanted components) only.

Outer iteration: Rayleigh-Ritz in the search space, converged pairs are locked
from the top. Each pair that is left gets a correction direction from its
projected equation (I - QQ')(A - t)(I - QQ') z = -r, solved by a few MINRES steps;
the steps of all pairs share their passes. It ends when every residual is at the
rounding level of doubles.

Dropped: rows whose vector is null, holds a null or non-finite entry, or has
another length than most vectors have (ties: the shorter). Components without
variance (fewer distinct vectors than dimensions, constant tables) are not
components; an empty table gives no row. Repeated rows and ids each get their own
rows. Numbers beyond 2^53 are held there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path
from .words import stored

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Numbers in one packed block of distinct vectors.
BLOCK_NUMBERS = 1 << 18
INNER_STEPS = 6
MAX_OUTER = 200
_LIMIT = float(1 << 53)
_EPS = np.finfo(float).eps


def _matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values): the rows with usable vectors of length `dim` (any if None) and
    their numbers, as doubles, one row each (flat if `dim` is None)."""
    lists = column.cast(pa.large_list(pa.float64()))
    off = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)  # null entries become nan
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (bad[off[1:]] == bad[off[:-1]]) & (off[1:] > off[:-1]) & ~lists.is_null().to_numpy(zero_copy_only=False)
    if dim is not None:
        good &= np.diff(off) == dim
    rows = np.flatnonzero(good)
    if dim is None:
        return rows, np.diff(off)[rows]
    return rows, flat[off[rows][:, None] + np.arange(dim)] if len(rows) else np.empty((0, dim))


def whole_numbers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values), -_LIMIT, _LIMIT).astype(np.int64) + OFFSET


def _pack(x: np.ndarray) -> bytes:
    """Equal vectors give equal bytes: 32-bit differences from OFFSET where all fit, else 64-bit."""
    y = x - OFFSET
    return (y.astype("<i4") if np.abs(y).max(initial=0) < 1 << 31 else y.astype("<i8")).tobytes()


def _unpack(data: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * dim * n else "<i8").reshape(n, dim).astype(np.int64)


def dimension(table: DataFrame, vec_col: str) -> int:
    """The length that most usable vectors have; 0 without one."""
    def run(batches):
        for batch in batches:
            sizes, n = np.unique(_matrix(batch.column(0))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], names=["dim", "n"])

    found = table.select(F.col(vec_col).cast("array<double>")).mapInArrow(run, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    best = found.orderBy(F.desc("n"), "dim").first()
    return best["dim"] if best else 0


class FitList:
    """The distinct whole-number vectors, stored once in packed blocks."""

    def __init__(self, table: DataFrame, vec_col: str, dim: int):
        self.dim = dim
        per_block = max(1, BLOCK_NUMBERS // dim)

        def rows(batches):
            for batch in batches:
                x = whole_numbers(_matrix(batch.column(0), dim)[1])
                yield pa.RecordBatch.from_arrays([pa.array([_pack(v) for v in x], pa.binary())], names=["x"])

        def blocks(batches):
            held, size = {}, {}
            for batch in batches:
                for v in batch.column("x").to_pylist():
                    held.setdefault(len(v), []).append(v)
                    if len(held[len(v)]) == per_block:
                        yield block(held.pop(len(v)))
            for vs in held.values():
                yield block(vs)

        def block(vs):
            return pa.RecordBatch.from_arrays([pa.array([len(vs)], pa.int64()), pa.array([b"".join(vs)], pa.binary())], names=["n", "block"])

        distinct = table.select(F.col(vec_col).cast("array<double>")).mapInArrow(rows, "x binary").groupBy("x").agg(F.count("*").alias("copies"))
        self.blocks = stored(distinct.select("x").mapInArrow(blocks, "n long, block binary"), "fit-list")
        self.n, self.sums = 0, [0] * dim
        halves = lambda y: np.stack([(y >> 26).sum(0), (y & (1 << 26) - 1).sum(0)], 1)  # noqa: E731  (no overflow)
        for i, (high, low), n in self._sums(halves, 2, "decimal(38,0)", pa.int64()):
            self.n, self.sums[i] = int(n), (int(high) << 26) + int(low) + OFFSET * int(n)
        # the mean as seen from OFFSET, from exact numbers
        self.shift = np.array([(s - OFFSET * self.n) / max(self.n, 1) for s in self.sums])

    def _sums(self, part, width: int, kind: str = "double", arrow=pa.float64()):
        """Rows (i, values, n): `part` (numbers less OFFSET -> dim x width) summed over all blocks."""
        dim = self.dim

        def run(batches):
            total, n = None, 0
            for batch in batches:
                for m, data in zip(batch.column("n").to_pylist(), batch.column("block").to_pylist()):
                    p = part(_unpack(data, dim, m))
                    total, n = p if total is None else total + p, n + m
            if total is not None:
                names = ["i", "n", *(f"v{k}" for k in range(width))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(np.full(len(total), n)), *(pa.array(total[:, k], arrow) for k in range(width))], names=names)

        schema = "i long, n long, " + ", ".join(f"v{k} {'long' if kind != 'double' else kind}" for k in range(width))
        parts = self.blocks.mapInArrow(run, schema)
        summed = parts.groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(F.col(f"v{k}").cast(kind)).alias(f"v{k}") for k in range(width)))
        return [(r["i"], [r[f"v{k}"] for k in range(width)], r["n"]) for r in summed.collect()]  # as many rows as dimensions

    def product(self, v: np.ndarray) -> np.ndarray:
        """Covariance times v (dim x k): one pass, centred before multiplying."""
        shift = self.shift

        def part(y):
            c = y - shift
            return c.T @ (c @ v)

        out = np.zeros_like(v)
        for i, values, _ in self._sums(part, v.shape[1]):
            out[i] = values
        return out / self.n

    def trace(self) -> float:
        shift = self.shift
        return sum(values[0] for _, values, _ in self._sums(lambda y: ((y - shift) ** 2).sum(0)[:, None], 1)) / self.n

    def covariance_of(self, project) -> np.ndarray:
        """Covariance of project(numbers less OFFSET) over the fit list: one pass
        gives its sums and products, centred by the mean of the whitened numbers."""
        def part(y):
            w = project(y)
            return np.vstack([w.T @ w, w.sum(0)])

        width = project(np.zeros((1, self.dim), dtype=np.int64)).shape[1]
        got = np.zeros((width + 1, width))
        for i, values, _ in self._sums(part, width):
            got[i] = values
        mean = got[-1] / self.n
        return got[:-1] / self.n - np.outer(mean, mean)


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Directions of `new` outside `basis`, orthonormal; those within it are dropped."""
    kept = np.empty((len(new), 0))
    for v in new.T:
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        for _ in range(3):
            v = v - basis @ (basis.T @ v)
            v = v - kept @ (kept.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-8:
                break
            v = v / left
        else:
            kept = np.column_stack([kept, v])
    return kept


def minres(product, shifts: np.ndarray, project, rhs: np.ndarray, steps: int) -> np.ndarray:
    """MINRES on P(A - shift_i)P z_i = rhs_i for all columns i at once, from zero:
    one product of A with a block a step."""
    k = rhs.shape[1]
    size = np.linalg.norm(rhs, axis=0)
    v_old, v = np.zeros_like(rhs), rhs / np.where(size > 0, size, 1)
    z, d_old, d_older = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    beta, c, s, c_old, s_old, phi = np.zeros(k), np.ones(k), np.zeros(k), np.ones(k), np.zeros(k), size.copy()
    live = size > 0
    for _ in range(steps):
        w = project(product(v) - shifts * v)
        alpha = (v * w).sum(0)
        w = w - alpha * v - beta * v_old
        beta_new = np.linalg.norm(w, axis=0)
        # the last two plane rotations act on the new column of the tridiagonal matrix
        eps, delta = s_old * beta, c_old * beta
        diag, delta = c * alpha - s * delta, c * delta + s * alpha
        r = np.hypot(diag, beta_new)
        live = live & (r > _EPS * np.abs(shifts))
        safe = np.where(live, r, 1)
        c_old, s_old, c, s = c, s, diag / safe, beta_new / safe
        d = (v - delta * d_old - eps * d_older) / safe
        z = z + np.where(live, c * phi * d, 0)
        phi = -s * phi
        d_older, d_old = d_old, d
        live = live & (beta_new > 1e-14 * np.abs(shifts))
        v_old, v, beta = v, w / np.where(live, beta_new, 1), np.where(live, beta_new, 0)
        if not live.any():
            break
    return z


def jacobi_davidson(product, dim: int, wanted: int, inner: int = INNER_STEPS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors, largest residual): the `wanted`
    largest eigenpairs of the symmetric operator `product` (a block in, a block out)."""
    wanted = min(wanted, dim)
    most = min(dim, max(4 * wanted, wanted + 24))
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((dim, wanted)), np.empty((dim, 0)))
    image = product(basis)
    best, since = np.inf, 0
    for _ in range(MAX_OUTER):
        h = basis.T @ image
        values, inner_vectors = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(values)[::-1]
        values, inner_vectors = values[order], inner_vectors[:, order]
        ritz, moved = basis @ inner_vectors, image @ inner_vectors
        values, x = values[:wanted], ritz[:, :wanted]
        residuals = moved[:, :wanted] - x * values
        sizes = np.linalg.norm(residuals, axis=0)
        tol = 8 * _EPS * np.sqrt(dim) * max(values[0], np.finfo(float).tiny)
        locked = np.logical_and.accumulate(sizes <= tol)
        best, since = (sizes.max(), 0) if sizes.max() < best / 2 else (best, since + 1)
        if locked.all() or basis.shape[1] == dim or since >= 3 and best <= 100 * tol:
            # a search space as large as the whole space leaves rounding only
            return values, x / np.linalg.norm(x, axis=0), float(sizes.max())
        if basis.shape[1] + wanted > most and basis.shape[1] > 2 * wanted and most < dim:
            basis, image = ritz[:, : 2 * wanted], moved[:, : 2 * wanted]  # restart with the best
            basis, r = np.linalg.qr(basis)
            image = np.linalg.solve(r.T, image.T).T
        open_ = np.flatnonzero(~locked)

        def project(w):
            return w - x @ (x.T @ w)

        steps = min(inner, max(1, dim - wanted))
        z = minres(product, values[open_], project, project(-residuals[:, open_]), steps)
        new = _orthonormal(np.column_stack([z, residuals[:, open_]])[:, : len(open_)], basis)
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(basis.shape[1]).standard_normal((dim, 1)), basis)
        new = new[:, : dim - basis.shape[1]]
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
    raise RuntimeError("Jacobi-Davidson did not reach double precision")


def whiten(table: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(id, component from 1, n, deviation, whitened, explained, identity_error): a row
    for each usable vector and component. `deviation` is null where it does not fit a long."""
    schema = f"`{id_col}` {table.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = table.sparkSession
    dim = dimension(table, vec_col)
    if not dim:
        return spark.createDataFrame([], schema)
    fit = FitList(table, vec_col, dim)
    total = fit.trace()
    if not total > 0:
        return spark.createDataFrame([], schema)
    values, vectors, _ = jacobi_davidson(fit.product, dim, min(components, dim))
    real = values > 64 * _EPS * dim * values[0]
    values, vectors = values[real], vectors[:, real]
    shift, scale = fit.shift, vectors / np.sqrt(values)

    def project(y):
        return (y - shift) @ scale

    error = float(np.abs(fit.covariance_of(project) - np.eye(len(values))).max())
    n, sums, k, explained = fit.n, fit.sums, len(values), values / total
    less = [s - OFFSET * n for s in sums]

    def deviations(y):
        far = [max(abs(int(a)), abs(int(b))) for a, b in zip(y.min(0), y.max(0))] if len(y) else []
        reach = sum((n * f + abs(s)) ** 2 for f, s in zip(far, less))
        if reach < 1 << 63:
            return pa.array((((n * y) - np.array(less, dtype=np.int64)) ** 2).sum(1), pa.int64())
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, less)) for row in y.tolist()]
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())

    def run(batches):
        for batch in batches:
            rows, vecs = _matrix(batch.column(1), dim)
            y = whole_numbers(vecs) - OFFSET
            ids, m = batch.column(0).take(pa.array(rows)), len(rows)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviations(y).take(each),
                pa.array(project(y).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return table.select(id_col, F.col(vec_col).cast("array<double>")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(table_path(sf_dir, "embeddings")))
