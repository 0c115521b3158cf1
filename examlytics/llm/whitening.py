"""Whitening of embeddings by a Jacobi-Davidson eigensolver (operator 11).

The covariance matrix is never formed. Integer codes of the vectors are written
once as a table of blocks; a product of the centred covariance with a few vectors
is a pass over that table in which every task centres its blocks, multiplies
them and adds up, and Spark sums the tasks' partial results per entry.

The solver keeps an orthonormal search space Q and its products. Each round does
a Rayleigh-Ritz step, locks the leading pairs whose residuals have reached double
precision, and solves the projected correction equations of the other wanted
pairs by MINRES, all pairs side by side, so that one pass serves them all. The
corrections join Q; a full Q is restarted with its best Ritz vectors. At the end
the residuals are measured anew from fresh products, and a Lanczos run beside
the locked vectors shows whether a larger eigenvalue was missed.

Memory: a task holds one block; the driver holds vectors of the embeddings'
dimension (at most ``SPACE`` of them) and sums, never rows.

Defined cases: rows whose vector is null or holds a null, not-a-number or infinite
entry are dropped, and so are vectors whose length is not the most frequent one
(of equally frequent lengths the longer counts) and vectors with an entry of 2^30
or more, whose code doubles could not carry exactly through the products. Rows
that repeat an id count apart; a null id stays null; other columns are ignored.
Directions without variance are no components, so one vector, equal vectors or an
empty table give no rows. A deviation that does not fit a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlytics.llm.common import stored

COMPONENTS = 8
#: Codes are floor(SCALE * entry) + OFFSET.
SCALE = 1024
OFFSET = 100_000
#: Entries of a block of codes.
BLOCK_ENTRIES = 1 << 18
#: Vectors of the search space at most, and after a restart.
SPACE = 48
RESTART = 24
#: Steps of MINRES in a round, and the reduction of the residual that ends them.
INNER_STEPS = 5
INNER_REDUCTION = 0.05
ROUNDS = 60
CHECK_STEPS = 12
EPS = float(np.finfo(float).eps)


# ------------------------------------------------------------------ codes

BLOCKS = "ids array<long>, n int, codes binary"


def _blocks(dims: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, BLOCK_ENTRIES // dims)
        for batch in batches:
            for a in range(0, len(batch), rows):
                part = batch.slice(a, rows)
                codes = part.column("codes").flatten().to_numpy().astype("<i8")
                ids = part.column("id")
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids), pa.array([len(part)], pa.int32()), pa.array([codes.tobytes()])],
                    names=["ids", "n", "codes"],
                )

    return pack


def coded(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """A written table of blocks of codes, and the vectors' dimension (0 without vectors)."""
    v = F.col("v")
    usable = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float(1 << 30)))
    x = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    x = x.where(v.isNotNull() & F.coalesce(F.forall(v, usable), F.lit(False)))
    lengths = x.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dims = lengths[0]["d"] if lengths else 0
    codes = F.transform("v", lambda e: F.floor(e * F.lit(float(SCALE))).cast("long") + F.lit(OFFSET))
    x = x.where(F.size("v") == dims).select("id", codes.alias("codes"))
    return stored(x.mapInArrow(_blocks(max(1, dims)), BLOCKS), "embedding-codes"), dims


def _each(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for ids, n, codes in zip(batch.column("ids"), batch.column("n").to_pylist(), batch.column("codes")):
            yield ids.values, np.frombuffer(codes.as_py(), "<i8").reshape(n, dims)


class Center(NamedTuple):
    """n vectors with the sums S per dimension; S/n = whole + part."""

    n: int
    sums: list[int]
    whole: np.ndarray
    part: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once."""
        return (x - self.whole).astype(float) - self.part


def center(blocks: DataFrame, dims: int) -> Center:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _each(batches, dims):
            yield pa.RecordBatch.from_arrays([pa.array(np.append(x.sum(axis=0), len(x))), pa.array(np.arange(dims + 1))], names=["s", "place"])

    got = blocks.mapInArrow(sums, "s long, place long").groupBy("place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    total = {r["place"]: int(r["s"]) for r in got}
    n, s = total.get(dims, 0), [total.get(j, 0) for j in range(dims)]
    whole = [round(x / n) if n else 0 for x in s]
    part = np.array([(x - n * w) / n if n else 0.0 for x, w in zip(s, whole)])
    return Center(n, s, np.array(whole, np.int64), part)


# ------------------------------------------------------------------ distributed sums


def summed(blocks: DataFrame, dims: int, size: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``add(codes of a block)``, ``size`` numbers, over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, x in _each(batches, dims):
            total += add(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["place", "value"])

    got = blocks.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for r in got:
        out[r["place"]] = r["value"]
    return out


def products(blocks: DataFrame, c: Center) -> Callable[[np.ndarray], np.ndarray]:
    """The covariance (divisor n) times the columns of a matrix: one pass for all columns."""
    dims = len(c.sums)

    def times(v: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            y = c.centred(x)
            return (y.T @ (y @ v)).ravel()

        return summed(blocks, dims, v.size, add).reshape(v.shape) / c.n

    return times


# ------------------------------------------------------------------ Jacobi-Davidson


def orthonormal(new: np.ndarray, base: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``new`` add to the orthonormal ``base``."""
    out = base
    for column in new.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        t = column / size
        for _ in range(3):
            t = t - out @ (out.T @ t)
            size = np.linalg.norm(t)
            if size < 1e-10:
                break
            t = t / size
        else:
            out = np.column_stack([out, t])
    return out[:, base.shape[1] :]


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, reduction: float) -> np.ndarray:
    """Columns x with ``apply(x)`` near ``b``, all systems side by side; ``apply`` is symmetric for each column."""
    dot = lambda p, q: np.einsum("ij,ij->j", p, q)
    over = lambda p, q: np.divide(p, q, out=np.zeros_like(p), where=np.broadcast_to(q > 0, p.shape))
    x = np.zeros_like(b)
    first = beta = np.linalg.norm(b, axis=0)
    v, before = over(b, beta), np.zeros_like(b)
    eta, beta = beta.copy(), np.zeros_like(beta)
    w0 = w1 = np.zeros_like(b)
    c0 = c1 = np.ones_like(eta)
    s0 = s1 = np.zeros_like(eta)
    for _ in range(steps):
        av = apply(v)
        alpha = dot(v, av)
        nxt = av - alpha * v - beta * before
        b2 = np.linalg.norm(nxt, axis=0)
        delta = c1 * alpha - c0 * s1 * beta
        r1, r2, r3 = np.hypot(delta, b2), s1 * alpha + c0 * c1 * beta, s0 * beta
        c2, s2 = over(delta, r1), over(b2, r1)
        w2 = over(v - r3 * w0 - r2 * w1, r1)
        x = x + c2 * eta * w2
        eta = -s2 * eta
        before, v, beta = v, over(nxt, b2), b2
        w0, w1, c0, c1, s0, s1 = w1, w2, c1, c2, s1, s2
        if np.all(np.abs(eta) <= reduction * first):
            break
    return x


def largest_pairs(times: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric operator, unit eigenvectors (columns) and residual norms."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, dims)
    space, restart = min(dims, max(SPACE, 4 * wanted)), min(dims, max(RESTART, 2 * wanted))
    q = orthonormal(rng.standard_normal((dims, restart)), np.zeros((dims, 0)))
    w = times(q)
    last = np.inf
    for _ in range(ROUNDS):
        theta, s = np.linalg.eigh((q.T @ w + w.T @ q) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        u, au = q @ s, w @ s
        residual = au[:, :wanted] - u[:, :wanted] * theta[:wanted]
        norms = np.linalg.norm(residual, axis=0)
        limit = 8 * np.sqrt(dims) * EPS * max(abs(theta[0]), abs(theta[-1]))
        open_ = np.flatnonzero(norms > limit)
        if not len(open_) or q.shape[1] == dims:
            # measure anew, not from products carried along
            x = np.linalg.qr(u[:, :wanted])[0]
            ax = times(x)
            values = np.einsum("ij,ij->j", x, ax)
            fresh = np.linalg.norm(ax - x * values, axis=0)
            worst = fresh.max(initial=0.0)
            missed = missed_direction(times, x, values, rng)
            if missed is None and (worst <= limit or worst > last / 2 or q.shape[1] == dims and worst <= 64 * limit):
                order = np.argsort(-values, kind="stable")
                return values[order], x[:, order], fresh[order]
            last = min(last, worst)
            more = u[:, wanted:restart] if missed is None else np.column_stack([missed, u[:, wanted : restart - 1]])
            extra = orthonormal(more, x)
            q, w = np.column_stack([x, extra]), np.column_stack([ax, times(extra)]) if extra.size else ax
            continue
        locked = np.setdiff1d(np.arange(wanted), open_)
        shift = theta[open_]
        # every wanted vector, locked or not, is projected out of the corrections
        z = u[:, :wanted]
        project = lambda t: t - z @ (z.T @ t)

        def apply(t: np.ndarray) -> np.ndarray:
            t = project(t)
            return project(times(t) - t * shift)

        t = minres(apply, -project(residual[:, open_]), INNER_STEPS, INNER_REDUCTION)
        if q.shape[1] + len(open_) > space and q.shape[1] > restart:
            q, w = u[:, :restart], au[:, :restart]
        else:
            q, w = u, au
        assert len(locked) + len(open_) == wanted
        new = orthonormal(t, q)[:, : dims - q.shape[1]]
        if not new.shape[1]:
            new = orthonormal(rng.standard_normal((dims, 1)), q)
        q, w = np.column_stack([q, new]), np.column_stack([w, times(new)])
    raise RuntimeError("the residuals did not reach double precision")


def missed_direction(times: Callable[[np.ndarray], np.ndarray], x: np.ndarray, values: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
    """A direction beside ``x`` with a larger Rayleigh quotient than the smallest of ``values``, if Lanczos finds one."""
    dims = x.shape[0]
    if x.shape[1] == dims:
        return None
    v = orthonormal(rng.standard_normal((dims, 1)), x)
    basis, images = v, np.zeros((dims, 0))
    for _ in range(min(CHECK_STEPS, dims - x.shape[1])):
        images = np.column_stack([images, times(basis[:, -1:])])
        nxt = orthonormal(images[:, -1:], np.column_stack([x, basis]))
        if not nxt.shape[1]:
            break
        basis = np.column_stack([basis, nxt])
    k = images.shape[1]
    theta, s = np.linalg.eigh((basis[:, :k].T @ images + images.T @ basis[:, :k]) / 2)
    return basis[:, :k] @ s[:, -1:] if theta[-1] > values.min() * (1 + 1e-9) else None


# ------------------------------------------------------------------ whitening


class Whitening(NamedTuple):
    """A fitted whitening: centre, eigenvalues, unit eigenvectors (columns), residual norms, trace and identity error."""

    center: Center
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (self.center.centred(x) @ self.vectors) / np.sqrt(self.values)


def _deviations(c: Center, x: np.ndarray) -> list[int]:
    """Sum over dimensions of (n*x - S)^2 for each row, exact."""
    y, rest = x - c.whole, [s - c.n * int(w) for s, w in zip(c.sums, c.whole)]
    most = c.n * int(np.abs(y).max(initial=0)) + max(map(abs, rest))
    kind = np.int64 if most * most * len(rest) < 1 << 63 else object
    d = y.astype(kind) * c.n - np.array(rest, kind)
    return (d * d).sum(axis=1).tolist()


def fit(blocks: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of the blocks' vectors; None where no direction has variance."""
    c = center(blocks, dims)
    if c.n < 2 or not dims:
        return None
    values, vectors, residuals = largest_pairs(products(blocks, c), dims, components)
    real = values > dims * EPS * values[0] if values[0] > 0 else np.zeros(len(values), bool)
    if not real.any():
        return None
    w = Whitening(c, values[real], vectors[:, real], residuals[real], 0.0, 0.0)
    k = int(real.sum())

    def add(x: np.ndarray) -> np.ndarray:
        y = w.apply(x)
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0), [float(sum(_deviations(c, x)))]])

    got = summed(blocks, dims, k * k + k + 1, add)
    mean = got[k * k : -1] / c.n
    cov = got[: k * k].reshape(k, k) / c.n - np.outer(mean, mean)
    return w._replace(trace=got[-1] / c.n**3, identity_error=float(np.abs(cov - np.eye(k)).max()))


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
WHITENED_ARROW = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
)


def _whitener(w: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        share = w.values / w.trace
        for ids, x in _each(batches, len(w.center.sums)):
            each = pa.array(np.repeat(np.arange(len(x)), k))
            deviation = pa.array([d if d < 1 << 63 else None for d in _deviations(w.center, x)], pa.int64())
            columns = [
                ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), w.center.n)), deviation.take(each),
                pa.array(w.apply(x).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(each), w.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=WHITENED_ARROW)

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component: its whitened coordinate and what was fitted."""
    blocks, dims = coded(rows, id_col, vector_col)
    w = fit(blocks, dims, components)
    if w is None:
        return rows.sparkSession.createDataFrame([], WHITENED)
    return blocks.mapInArrow(_whitener(w), WHITENED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_whitening: every usable vector of the embeddings, whitened."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
