"""Centroid clustering of integer vectors with Elkan's bounds.

Each vector carries an upper bound of the distance to its centroid and a lower bound for every centroid. When centroids
move, bounds move by the same length; a centroid is compared again only if neither its lower bound nor half its distance to
the vector's own centroid exceeds the upper bound. Bounds are kept in 32 bits, rounded outwards, and centroids are skipped on
strictly greater bounds only, so that ties still reach the exact comparison. Comparisons themselves are of exact integers.

Vectors are kept in blocks, one row a block of at most BLOCK vectors: ids, components, clusters and bounds, written to the
shared folder once a round. Blocks stay where they are: nothing is shuffled but the blocks' component sums, k x d numbers a
task. The driver holds the k centroids and nothing that grows with the vectors. A lost executor repeats one round's blocks.

Defined results: vectors that are null, of another length or hold null or non-finite components take no part and have no row;
a null id takes part and keeps its null, but starts no centroid; rows of one id are vectors of their own, and of equal start
hashes the smaller vector (by its components) comes first; with fewer than k vectors with an id there are that many
centroids, and without one no row; a component beyond MOST_COMPONENT in magnitude raises, since distances would not fit
64 bits; other columns are ignored; empty tables give no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, drop_stored, stored
from ..sources.shared import spread

#: Vectors in a block.
BLOCK = 4096
#: Largest scaled component: the squared distance of 64 components stays below 2**62.
MOST_COMPONENT = 1 << 27
#: Up to this magnitude, products of 64 components are exact in doubles.
EXACT_DOUBLE = 1 << 22

_STATE = "ids binary, known binary, x binary, wide boolean, cluster binary, upper binary, lower binary, dist binary, sums binary, compared long"


def _up(x: np.ndarray) -> np.ndarray:
    """x in 32 bits, rounded up (and one step further, for the rounding of the double itself)."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of int64 rows to rows of c (n x k)."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT_DOUBLE and x.shape[1] <= 64:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1) if len(c) else np.zeros((len(x), 0), np.int64)


def _first(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroid (the smallest of several), its exact squared distance, upper and lower bounds, comparisons."""
    s = squares(x, c)
    a = s.argmin(axis=1)
    own = s[np.arange(len(x)), a]
    d = np.sqrt(s.astype(float))
    return a, own, _up(np.sqrt(own.astype(float))), _down(d), s.size


def _again(x: np.ndarray, c: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the centroids moved (moved: how far, rounded up; apart: half the distances of centroids, rounded down)."""
    a, n = a.copy(), 0
    upper, lower = _up(upper.astype(float) + moved[a]), _down(lower.astype(float) - moved[None])
    own = np.full(len(x), -1, np.int64)  # not calculated yet
    nearest = apart.min(axis=1) if len(c) > 1 else np.full(1, np.inf, np.float32)  # of the others; the diagonal is infinite
    todo = np.flatnonzero(upper >= nearest[a])  # all others lie farther, strictly
    for j in range(len(c)):
        may = todo[(a[todo] != j) & (lower[todo, j] <= upper[todo]) & (apart[a[todo], j] <= upper[todo])]
        fresh = may[own[may] < 0]
        if len(fresh):  # tighten the upper bound first
            own[fresh] = ((x[fresh] - c[a[fresh]]) ** 2).sum(axis=1)
            d = np.sqrt(own[fresh].astype(float))
            upper[fresh], lower[fresh, a[fresh]] = _up(d), _down(d)
            n += len(fresh)
            may = may[(lower[may, j] <= upper[may]) & (apart[a[may], j] <= upper[may])]
        if not len(may):
            continue
        s = ((x[may] - c[j]) ** 2).sum(axis=1)
        d = np.sqrt(s.astype(float))
        lower[may, j] = _down(d)
        n += len(may)
        nearer = (s < own[may]) | ((s == own[may]) & (j < a[may]))
        hit = may[nearer]
        a[hit], own[hit], upper[hit] = j, s[nearer], _up(d[nearer])
    return a, own, upper, lower, n


def _sums(x: np.ndarray, a: np.ndarray, k: int) -> bytes:
    """Count and component sums of each cluster."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    order = np.argsort(a, kind="stable")
    at = np.searchsorted(a[order], np.arange(k + 1))
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some, 0] = np.diff(at)[some]
        out[some, 1:] = np.add.reduceat(x[order], at[:-1][some], axis=0)
    return out.tobytes()


def _blocks(vectors: DataFrame, id_col: str, vector: str, d: int, scale: float) -> DataFrame:
    """Blocks of vectors without clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            flat = col.flatten()
            length = pa.compute.fill_null(pa.compute.list_value_length(col), 0).to_numpy(zero_copy_only=False)
            start = np.cumsum(length) - length
            rows = np.flatnonzero(length == d)
            for s in range(0, len(rows), BLOCK):
                r = rows[s : s + BLOCK]
                v = flat.take(pa.array((start[r][:, None] + np.arange(d)).ravel())).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)  # null: NaN
                ok = np.isfinite(v).all(axis=1)
                r, v = r[ok], np.floor(v[ok] * scale)
                if not len(r):
                    continue
                most = np.abs(v).max(initial=0)
                if most > MOST_COMPONENT:
                    raise OverflowError(f"a scaled component is {most:.0f}; distances fit 64 bits up to {MOST_COMPONENT}")
                wide = bool(most > 32767)
                ids = b.column(0).take(pa.array(r))
                known = np.array(ids.is_valid())
                yield _batch([{"ids": ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), "known": np.packbits(known).tobytes(), "x": v.astype(np.int32 if wide else np.int16).tobytes(), "wide": wide, "compared": 0}])

    return vectors.select(F.col(id_col).cast("long"), vector).where(F.size(vector) == d).mapInArrow(run, _STATE)


_ARROW = pa.schema([(n, {"boolean": pa.bool_(), "long": pa.int64()}.get(t, pa.binary())) for n, t in (x.split() for x in _STATE.split(", "))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _ARROW)


def _vectors(row: dict, d: int) -> np.ndarray:
    return np.frombuffer(row["x"], np.int32 if row["wide"] else np.int16).reshape(-1, d).astype(np.int64)


def _assigned(state: DataFrame, d: int, c: np.ndarray, moved: np.ndarray | None, apart: np.ndarray, final: bool) -> DataFrame:
    """The blocks with clusters and bounds for the centroids c; final: with exact distances instead of bounds."""
    k = len(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                x = _vectors(row, d)
                if moved is None:
                    a, own, upper, lower, n = _first(x, c)
                else:
                    a = np.frombuffer(row["cluster"], np.int32)
                    a, own, upper, lower, n = _again(x, c, a, np.frombuffer(row["upper"], np.float32), np.frombuffer(row["lower"], np.float32).reshape(-1, k), moved, apart)
                row |= {"cluster": a.astype(np.int32).tobytes(), "compared": n}
                if final:
                    left = own < 0
                    own[left] = ((x[left] - c[a[left]]) ** 2).sum(axis=1)
                    row |= {"upper": None, "lower": None, "dist": own.tobytes()}
                else:
                    row |= {"upper": upper.tobytes(), "lower": lower.tobytes(), "sums": _sums(x, a, k)}
                yield _batch([row])

    return state.mapInArrow(run, _STATE)


def _totals(state: DataFrame, k: int, d: int) -> list[tuple[int, list[int]]]:
    """Count and component sums of each cluster: summed in each task, then exactly by Spark; k x (d + 1) numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * (d + 1), np.int64)
        for b in batches:
            for s in b.column(0).to_pylist():
                total += np.frombuffer(s, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = state.select("sums").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    flat = [0] * (k * (d + 1))
    for r in rows:
        flat[r["at"]] = int(r["n"])
    return [(flat[j * (d + 1)], flat[j * (d + 1) + 1 : (j + 1) * (d + 1)]) for j in range(k)]


def _moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return _up(np.sqrt(((old - new) ** 2).sum(axis=1).astype(float))) * (old != new).any(axis=1)


def _apart(c: np.ndarray) -> np.ndarray:
    """Half the distance of each two centroids, rounded down; infinite on the diagonal."""
    h = _down(np.sqrt(squares(c, c).astype(float)) / 2) if len(c) else np.zeros((0, 0), np.float32)
    np.fill_diagonal(h, np.inf)
    return h


def starts(blocks: DataFrame, d: int, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hashes of seed:id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[int]]] = []  # of this task: k at most, and a block
        for b in batches:
            for row in b.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64), _vectors(row, d)
                known = np.unpackbits(np.frombuffer(row["known"], np.uint8))[: len(ids)]
                hashes = [(hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), i) for i in np.flatnonzero(known)]
                if hashes:
                    border = sorted(hashes)[min(k, len(hashes)) - 1][0]  # of a repeated id the smaller vectors come first
                    best = sorted(best + [(h, x[i].tolist()) for h, i in hashes if h <= border])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([v for _, v in best], pa.list_(pa.int64()))], ["h", "v"])

    rows = blocks.select("ids", "known", "x", "wide").mapInArrow(run, "h string, v array<long>").orderBy("h", "v").limit(k).collect()  # k rows, a parameter
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, d)


def centroid_clustering(spark: SparkSession, vectors: DataFrame, k: int = 40, rounds: int = 5, d: int = 64, scale: float = 256.0, seed: str = "2", id_col: str = "vec_id", vector: str = "embedding", report: list[dict] | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    report: gets for each round the comparisons made and those that comparing with all centroids would take.
    """
    bounded_batches(spark)
    state = stored(_blocks(spread(vectors.select(id_col, vector)), id_col, vector, d, scale), "blocks")
    c = starts(state, d, k, seed)
    moved = None
    for turn in range(rounds + 1):
        if not len(c):
            break
        new = stored(_assigned(state, d, c, moved, _apart(c), turn == rounds), "assigned")
        drop_stored(state)
        state = new
        if report is not None:
            report.append(state.agg(F.sum("compared").alias("compared"), (F.sum(F.octet_length("ids")) / 8 * len(c)).cast("long").alias("all")).first().asDict())
        if turn < rounds:
            old = c
            c = np.array([[s // n for s in sums] if n else old[j].tolist() for j, (n, sums) in enumerate(_totals(state, len(c), d))], np.int64)
            moved = _moved(old, c)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                known = np.unpackbits(np.frombuffer(r["known"], np.uint8))[: len(ids)].astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(np.frombuffer(r["cluster"], np.int32)), pa.array(np.frombuffer(r["dist"], np.int64))], ["vec_id", "cluster", "distance"])

    schema = T.StructType.fromDDL("vec_id long, cluster int, distance long")
    out = state.select("ids", "known", "cluster", "dist").mapInArrow(rows, schema) if len(c) else spark.createDataFrame([], schema)
    inertia = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # at most k rows
    names = spark.createDataFrame([(j, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for j, row in enumerate(c)], "cluster int, centroid_sha256 string")
    whole = inertia.agg(F.sum("cluster_inertia").alias("inertia"))  # one row
    per = inertia.crossJoin(F.broadcast(whole)).join(F.broadcast(names), "cluster")
    return out.join(F.broadcast(per), "cluster").select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
