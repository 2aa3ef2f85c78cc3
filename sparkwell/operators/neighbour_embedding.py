"""Two-dimensional neighbour embedding with landmarks, for plots.

At most LANDMARKS rows, chosen by a hash, are laid out by descent on the divergence between neighbour probabilities in the
vectors' space (Gaussians, each calibrated to the perplexity) and in the plane (heavy-tailed). Every row then gets
probabilities over its nearest landmarks, calibrated the same way, starts at their weighted mean and descends on its own
terms of the same divergence while the landmarks stay; rows never move to do so. Landmarks are a documented, bounded sample;
the plane's scale is theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embeddings import _unit

LANDMARKS, PERPLEXITY, STEPS, OWN_STEPS = 1000, 30.0, 500, 60
#: Rows placed at once in a task.
ROWS = 256


def calibrated(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Rows of probabilities exp(-beta d), beta by bisection so that each row's entropy is log(perplexity)."""
    d = d - d.min(axis=1, keepdims=True)
    low, high, beta = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    target = np.log(min(perplexity, max(1.0, d.shape[1] / 1.5)))
    for _ in range(60):
        p = np.exp(-d * beta[:, None])
        total = p.sum(axis=1)
        entropy = np.log(total) + beta * (d * p).sum(axis=1) / total
        wide = entropy > target
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return p / total[:, None]


def _nearest(x: np.ndarray, y: np.ndarray, k: int, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions and squared distances of the k nearest unit rows of y; own: leave out the row's own position."""
    s = x @ y.T
    if own:
        np.fill_diagonal(s, -np.inf)
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return at, np.maximum(0, 2 - 2 * np.take_along_axis(s, at, 1))


def laid_out(x: np.ndarray, perplexity: float = PERPLEXITY, steps: int = STEPS, seed: int = 42) -> np.ndarray:
    """Positions of unit vectors in the plane: momentum descent with early exaggeration, from the first principal directions."""
    n = len(x)
    if n < 3:
        return np.column_stack([np.arange(n, dtype=float), np.zeros(n)])
    k = min(n - 1, int(3 * perplexity))
    at, d = _nearest(x, x, k, True)
    p = np.zeros((n, n))
    p[np.arange(n)[:, None], at] = calibrated(d, perplexity)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    y = u[:, :2] * s[:2]
    y = np.column_stack([y, np.zeros((n, 2 - y.shape[1]))]) if y.shape[1] < 2 else y
    y = 1e-4 * y / max(1e-12, y.std()) + 1e-6 * np.random.default_rng(seed).standard_normal((n, 2))
    move, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 12 / 4, 50.0)
    for t in range(steps):
        heavy = t < steps // 4
        q = 1 / (1 + ((y * y).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * y @ y.T))
        np.fill_diagonal(q, 0)
        w = ((12.0 if heavy else 1.0) * p - q / q.sum()) * q
        g = 4 * (w.sum(axis=1)[:, None] * y - w @ y)
        gain = np.maximum(0.01, np.where(np.sign(g) != np.sign(move), gain + 0.2, gain * 0.8))
        move = (0.5 if heavy else 0.8) * move - rate * gain * g
        y = y + move
        y -= y.mean(axis=0)
    return y


def placed(x: np.ndarray, landmarks: np.ndarray, y: np.ndarray, perplexity: float = PERPLEXITY, steps: int = OWN_STEPS) -> np.ndarray:
    """Positions of unit rows among fixed landmarks at y; a row equal to a landmark lies beside it."""
    k = min(len(landmarks), max(1, int(perplexity)))
    at, d = _nearest(x, landmarks, k)
    p = calibrated(d, perplexity / 3)
    z = np.einsum("nk,nkd->nd", p, y[at])
    spread = max(1e-9, float(y.std()))
    for t in range(steps):
        near = z[:, None] - y[at]
        pull = np.einsum("nk,nkd->nd", p / (1 + (near * near).sum(axis=2)), near)
        far = z[:, None] - y[None]
        q = 1 / (1 + (far * far).sum(axis=2))
        push = np.einsum("nm,nmd->nd", q * q, far) / q.sum(axis=1)[:, None]
        g = 2 * (pull - push)
        size = np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12)
        z = z - g / size * np.minimum(size, 0.05) * spread * (1 - t / steps)
    return z


def embed(vectors: DataFrame, landmarks: int = LANDMARKS, perplexity: float = PERPLEXITY, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x, y) of every row with a vector; landmarks are placed where the layout put them."""
    v = vectors.where(F.col(vector).isNotNull()).select(id_col, F.col(vector).alias("v"))
    chosen = v.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(landmarks).collect()  # a parameter
    shape = f"{id_col} {v.schema[id_col].dataType.simpleString()}, x double, y double"
    if not chosen:
        return vectors.sparkSession.createDataFrame([], shape)
    marks = _unit(np.array([list(r["v"]) for r in chosen], float))
    held = v.sparkSession.sparkContext.broadcast(({r[id_col]: i for i, r in enumerate(chosen)}, marks, laid_out(marks, perplexity, seed=seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, marks, y = held.value
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                part = b.slice(s, ROWS)
                x = _unit(part.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                z = placed(x, marks, y, perplexity)
                own = [where.get(i) for i in part.column(0).to_pylist()]
                for r, i in enumerate(own):
                    if i is not None:
                        z[r] = y[i]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(z[:, 0]), pa.array(z[:, 1])], [id_col, "x", "y"])

    return v.mapInArrow(run, shape)


def trustworthiness(x: np.ndarray, y: np.ndarray, k: int = 10) -> float:
    """How far the k nearest in y are also near in x: 1 less a penalty for the ranks in x of those that are not (unit rows x)."""
    n = len(x)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    rank = np.empty((n, n), np.int64)
    np.put_along_axis(rank, np.argsort(-s, axis=1, kind="stable"), np.arange(1, n + 1)[None].repeat(n, 0), 1)
    d = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    over = np.maximum(0, np.take_along_axis(rank, near, 1) - k)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * float(over.sum())
