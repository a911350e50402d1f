"""Whitening of embeddings with leading components found by a block Jacobi-Davidson iteration.

The covariance is never built.  Its product with a thin block is one Spark job: every task centres its vectors, adds
up X'(XW) and sends that sum, whose size is the number of dimensions times the block's width.  On the driver stay the
search space (dimensions times a few block widths) and the projected problem.  In each round the unconverged Ritz
vectors get corrections from (I - QQ')(V - e I)(I - QQ') t = -r, solved roughly by MINRES with all columns in step, so
that one job serves every column; the corrections widen the search space, Rayleigh-Ritz renews the Ritz vectors, and
those whose residuals have come down to rounding are locked and projected out of what follows.

Entries are counted in 64ths, as integers, so sums and deviations are exact; a vector is centred as (n x - S) / n, whose
numerator is an integer too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewatch.llm.common import stored

#: Entries are floor(UNIT * c) + OFFSET (fixed values of the contract).
UNIT, OFFSET = 64, 1_000_000
#: Vectors are stored in blocks of about this many bytes, which bounds what a task holds at once.
BLOCK_BYTES = 4 << 20
#: Columns beyond the wanted ones in the first search space, and the widest search space in blocks.
GUARD, WIDEST = 8, 3
#: Steps of MINRES for a correction, and the part of a residual at which it stops.
INNER_STEPS, INNER_PART = 6, 0.05
EPS = float(np.finfo(np.float64).eps)
Product = Callable[[np.ndarray], np.ndarray]


def usable(vector: Column) -> Column:
    """Not null, and no entry is null or not finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def units(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * UNIT) + F.lit(OFFSET).cast("long"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a list column after one another, and the length of each list."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(column).to_numpy(zero_copy_only=False)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        entries, sizes = _flat(batch.column(0))
        begin = np.cumsum(sizes) - sizes
        for dims in np.unique(sizes).tolist():
            own = begin[sizes == dims]
            step = max(1, BLOCK_BYTES // (8 * max(dims, 1)))
            for a in range(0, len(own), step):
                x = entries[own[a : a + step, None] + np.arange(dims)]
                peak = int(np.abs(x).max(initial=0))
                yield pa.RecordBatch.from_pydict({"n": [len(x)], "dims": [dims], "peak": [peak], "block": [x.tobytes()]},
                                                 pa.schema([("n", pa.int64()), ("dims", pa.int64()), ("peak", pa.int64()), ("block", pa.binary())]))


class Fit:
    """The stored vectors with their exact sums, and the jobs over them."""

    def __init__(self, vectors: DataFrame, vector: str):
        found = vectors.where(usable(F.col(vector))).select(units(F.col(vector)).alias("x"))
        self.blocks = stored(found.mapInArrow(_packed, "n long, dims long, peak long, block binary"), "vectors")
        r = self.blocks.agg(F.sum("n"), F.min("dims"), F.max("dims"), F.max("peak")).first()
        self.n, self.dims = r[0] or 0, r[2] or 0
        if self.n and r[1] != r[2]:
            raise ValueError(f"vectors have between {r[1]} and {r[2]} dimensions; one number is needed")
        if self.n * (r[3] or 0) >= 1 << 62:
            raise OverflowError("entries are too large for exact sums in 64 bits")
        self.sums = self._total(lambda x: x.sum(axis=0), "long").astype(np.int64) if self.n and self.dims else np.zeros(self.dims, dtype=np.int64)

    def _total(self, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
        """Sum of ``part`` over all blocks: a task adds up its own blocks, its sum goes through an aggregate."""
        dims, number = self.dims, pa.int64() if kind == "long" else pa.float64()

        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for block in batch.column(0):
                    own = part(np.frombuffer(block.as_buffer(), dtype=np.int64).reshape(-1, dims)).ravel()
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), pa.array(total, number)], ["cell", "value"])

        cells = self.blocks.select("block").mapInArrow(of_task, f"cell long, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(cells.num_rows, dtype=np.int64 if kind == "long" else np.float64)
        out[cells["cell"].to_numpy()] = cells["value"].to_numpy()
        return out

    def product(self, w: np.ndarray) -> np.ndarray:
        """The covariance times ``w``."""
        n, sums = self.n, self.sums

        def part(x: np.ndarray) -> np.ndarray:
            c = (n * x - sums) / n
            return c.T @ (c @ w)

        return self._total(part).reshape(w.shape) / n

    def check(self, maps: np.ndarray) -> tuple[float, float]:
        """Trace of the covariance, and the largest entry by which the covariance of the whitened vectors misses the identity."""
        n, sums, k = self.n, self.sums, maps.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            c = (n * x - sums) / n
            y = c @ maps
            return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0), [np.square(c).sum()]])

        total = self._total(part) / n
        mean = total[k * k : -1]
        return float(total[-1]), float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def minres(apply: Product, right: np.ndarray, steps: int, part: float) -> np.ndarray:
    """Rough solutions of apply(t) = right, all columns in step; a column whose residual is small stays as it is."""
    beta = np.linalg.norm(right, axis=0)
    size = beta.copy()
    v, v_old, x = right / np.where(beta > 0, beta, 1), np.zeros_like(right), np.zeros_like(right)
    w = w_old = np.zeros_like(right)
    c = c_old = np.ones(len(beta))
    s = s_old = np.zeros(len(beta))
    eta, live = beta.copy(), beta > 0
    for _ in range(steps):
        z = apply(v)
        alpha = np.sum(v * z, axis=0)
        z = z - alpha * v - beta * v_old
        after = np.linalg.norm(z, axis=0)
        top = c * alpha - c_old * s * beta
        rho1, rho2, rho3 = np.hypot(top, after), s * alpha + c_old * c * beta, s_old * beta
        live = live & (rho1 > 0)
        safe = np.where(live, rho1, 1)
        c_old, s_old, c, s = c, s, top / safe, after / safe
        w, w_old = (v - rho3 * w_old - rho2 * w) / safe, w
        x = x + np.where(live, c * eta, 0) * w
        eta = -s * eta
        live = live & (np.abs(eta) > part * size) & (after > EPS * size)
        if not live.any():
            break
        v, v_old, beta = z / np.where(after > 0, after, 1), v, after
    return x


def _orthogonal(t: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """Orthonormal columns for what ``t`` adds to the spaces."""
    for _ in range(2):  # once more takes away what rounding left
        for q in spaces:
            t = t - q @ (q.T @ t)
        u, size, _ = np.linalg.svd(t / np.maximum(np.linalg.norm(t, axis=0), np.finfo(float).tiny), full_matrices=False)
        t = u[:, size > 1e-6]
    room = len(t) - sum(q.shape[1] for q in spaces)
    return t[:, :room]


def eigenpairs(product: Product, dims: int, wanted: int, seed: int = 0, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues of a symmetric positive operator, falling, and their unit vectors as columns."""
    wanted = min(wanted, dims)
    width = min(dims, wanted + GUARD)
    values, locked = np.zeros(0), np.zeros((dims, 0))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    image, scale = product(basis), 0.0
    for _ in range(rounds):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        scale = max(scale, abs(theta[0]))
        left = wanted - len(values)
        error = image[:, :left] - basis[:, :left] * theta[:left]
        error = error - locked @ (locked.T @ error)
        size = np.linalg.norm(error, axis=0)
        good = size <= 16 * EPS * np.sqrt(dims) * scale
        ready = int(np.argmin(good)) if not good.all() else len(good)  # only leading ones, so no larger one is passed over
        if ready:
            values, locked = np.append(values, theta[:ready]), np.hstack([locked, basis[:, :ready]])
            basis, image, error, theta = basis[:, ready:], image[:, ready:], error[:, ready:], theta[ready:]
        if len(values) == wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        if locked.shape[1] + basis.shape[1] == dims:  # everything is spanned: only rounding in the images is left
            basis = _orthogonal(basis, locked)
            image = product(basis)
            continue
        now = error.shape[1]
        held = np.hstack([locked, basis[:, :now]])

        def shifted(t: np.ndarray) -> np.ndarray:
            t = t - held @ (held.T @ t)
            out = product(t) - theta[:now] * t
            return out - held @ (held.T @ out)

        t = minres(shifted, -error, INNER_STEPS, INNER_PART)
        if basis.shape[1] + now > WIDEST * width and locked.shape[1] + WIDEST * width < dims:
            basis, image = basis[:, :width], image[:, :width]  # restart with the best Ritz vectors
        new = _orthogonal(t, locked, basis)
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)]) if new.shape[1] else image
    raise ArithmeticError(f"{len(values)} of {wanted} components converged in {rounds} rounds")


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32, seed: int = 0) -> DataFrame:
    """A row per vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null, or hold a null, NaN or infinite entry, have no rows and no part in the fit; all others are
    fitted, repeated ones as often as they come.  A null key is kept, other columns are not read.  An empty table, or
    vectors without dimensions, give no rows; vectors of different lengths are an error, as are entries or deviations
    beyond 64 bits.  Components whose variance is nothing but rounding (a constant dimension, fewer vectors than
    components) can't be scaled to 1 and are left out; equal eigenvalues get some orthonormal basis of their space.
    """
    of_key = vectors.schema[key].dataType
    schema = T.StructType([T.StructField(key, of_key), *(T.StructField(c, k()) for c, k in (
        ("component", T.IntegerType), ("n", T.LongType), ("deviation", T.LongType), ("whitened", T.DoubleType), ("explained", T.DoubleType), ("identity_error", T.DoubleType)))])
    fit = Fit(vectors, vector)
    values, axes = eigenpairs(fit.product, fit.dims, components, seed) if fit.n and fit.dims else (np.zeros(0), np.zeros((0, 0)))
    some = values > (values[0] if len(values) else 0.0) * EPS * max(fit.dims, 1) * 16
    values, axes = values[some], axes[:, some]
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    maps = axes / np.sqrt(values)
    trace, miss = fit.check(maps)
    n, sums, k = fit.n, fit.sums, len(values)
    explained = values / trace

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, (1 << 19) // k)
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                x = _flat(part.column(1))[0].reshape(-1, len(sums))
                apart = n * x - sums
                if np.square(apart.astype(np.float64)).sum(axis=1).max() >= 2.0**63 * (1 - 1e-9):
                    raise OverflowError("a deviation is beyond 64 bits")
                many = len(x) * k
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(many, n)),
                    pa.array(np.repeat(np.square(apart).sum(axis=1), k)), pa.array((apart / n @ maps).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(many, miss)),
                ], schema.names)

    return vectors.where(usable(F.col(vector))).select(F.col(key), units(F.col(vector)).alias("x")).mapInArrow(rows, schema)
