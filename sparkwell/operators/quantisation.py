"""Product quantisation: vectors as a cell and a few bytes, distances from tables, exact re-ranking.

Unit vectors are assigned to the nearest of ``cells`` centroids; what is left is cut into subspaces, each with its codebook of
up to 256 entries. All codebooks are fitted together, one scan of a bounded sample an iteration; every vector is encoded. A
search adds, for each vector, one table entry a subspace to the query's product with the cell's centroid, and only the
``rerank`` best for each result are compared with their full vectors. How many that are grows with the table, so no list of
them is made: a first pass over the codes counts each query's estimates by size, which gives the least estimate of a candidate,
and a second one compares the vectors that reach it where they lie, beside their codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop, written
from .embeddings import _cells, _cells_of, _tiled, _unit

#: Rows that codebooks are fitted on, Lloyd iterations, and queries whose tables a task holds (8 KB each at 8 subspaces).
SAMPLE, ITERATIONS, HELD = 20_000, 12, 4096
#: Steps of estimates between -1 and 1, queries whose counts a task holds (16 KB each), and codes it scores at once.
STEPS, COUNTED, CODES = 2048, 1024, 4096


@dataclass
class Quantised:
    """Centroids (cells x d), codebooks (subspaces x entries x d / subspaces) and the encoded vectors (id, code bytes, full: the code and the vector's bytes)."""

    centroids: np.ndarray
    books: np.ndarray
    codes: DataFrame
    vectors: DataFrame
    id_col: str
    vector: str

    @property
    def bytes_per_vector(self) -> int:
        """Of a code: a byte a subspace and two for the cell; a full vector takes 4 a component."""
        return len(self.books) + 2


def _rows(b: pa.RecordBatch) -> np.ndarray:
    x = b.column(b.num_columns - 1)
    return _unit(x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))


def _kind(df: DataFrame, column: str) -> type:
    return np.float32 if df.schema[column].dataType.elementType.simpleString() == "float" else np.float64


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)


def _lloyd(rows: DataFrame, start: list[np.ndarray], cut, iterations: int) -> list[np.ndarray]:
    """Centroids of several spaces, fitted in the same scans; cut gives a batch's part of each space."""
    books = [b.copy() for b in start]
    for _ in range(iterations):

        def run(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((len(b), b.shape[1] + 1)) for b in books]
            for b in batches:
                for t, x, c in zip(total, cut(_rows(b)), books, strict=True):
                    own = _nearest(x, c)
                    np.add.at(t, own, np.column_stack([x, np.ones(len(x))]))
            flat = np.concatenate([t.ravel() for t in total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "v"])

        flat = np.zeros(sum(b.size + len(b) for b in books))
        for r in rows.select("v").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            flat[r["at"]] = r["v"]
        new, s = [], 0
        for b in books:
            t = flat[s : s + b.size + len(b)].reshape(len(b), -1)
            s += t.size
            new.append(np.where(t[:, -1:] > 0, t[:, :-1] / np.maximum(t[:, -1:], 1), b))
        books = new
    return books


def build(vectors: DataFrame, cells: int = 16, subspaces: int = 8, entries: int = 256, sample: int = SAMPLE, iterations: int = ITERATIONS, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> Quantised:
    """Fitted on at most sample rows, chosen by a hash of their ids; every row is encoded. Null vectors are left out."""
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    n = v.count()
    some = v if n <= sample else v.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    some = written(some, "sample")
    heads = some.orderBy(F.xxhash64(F.lit(seed + 1), "id")).limit(max(cells, entries)).select("v").collect()
    if not heads:
        return Quantised(np.zeros((0, 0)), np.zeros((0, 0, 0)), v.select("id", F.lit(b"").alias("code"), F.lit(b"").alias("full")), vectors, id_col, vector)
    first = _unit(np.array([list(r["v"]) for r in heads], float))
    d = first.shape[1]
    ends = np.linspace(0, d, min(subspaces, d) + 1).astype(int)
    if len(set(np.diff(ends))) > 1:
        raise ValueError(f"{d} components do not divide into {subspaces} subspaces")
    (centroids,) = _lloyd(some, [first[:cells]], lambda x: [x], iterations)
    rest = lambda x: x - centroids[_nearest(x, centroids)]
    cut = lambda x: [rest(x)[:, a:b] for a, b in zip(ends[:-1], ends[1:])]
    books = np.stack(_lloyd(some, [b[:entries] for b in cut(first)], cut, iterations))
    drop(some)
    kind = _kind(v, "v")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _rows(b)
            cell = _nearest(x, centroids)
            left = x - centroids[cell]
            code = np.column_stack([cell >> 8, cell & 255, *(_nearest(left[:, s:e], books[j]) for j, (s, e) in enumerate(zip(ends[:-1], ends[1:])))]).astype(np.uint8)
            raw = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, -1).view(np.uint8)
            blobs = [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (code, np.column_stack([code, raw]))]
            yield pa.RecordBatch.from_arrays([b.column(0), *blobs], ["id", "code", "full"])

    return Quantised(centroids, books, written(v.mapInArrow(encode, "id long, code binary, full binary"), "codes"), vectors, id_col, vector)


def _tables(index: Quantised, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of every centroid and of every entry of every codebook with each of the unit queries q."""
    width = index.books.shape[2]
    of = lambda rows, x: np.ascontiguousarray((rows @ x.T).astype(np.float32))
    return of(index.centroids, q), np.stack([of(b, q[:, j * width : (j + 1) * width]) for j, b in enumerate(index.books)])


def _estimates(held: tuple[np.ndarray, np.ndarray], code: np.ndarray) -> np.ndarray:
    """The estimated cosine of each code (a row) with each query."""
    coarse, fine = held
    s = coarse[code[:, 0].astype(np.int64) * 256 + code[:, 1]]
    for j, entries in enumerate(fine):
        s += entries[code[:, j + 2]]
    return s


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def _plain(index: Quantised) -> Quantised:
    """What tasks need of an index."""
    return Quantised(index.centroids, index.books, None, None, index.id_col, index.vector)


def candidates(index: Quantised, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the n vectors of the largest estimated cosine for each query."""
    held = _plain(index)

    def scores(tables: tuple[np.ndarray, np.ndarray], rows: np.ndarray, code: np.ndarray) -> np.ndarray:
        coarse, fine = tables
        return _estimates((coarse[:, rows], fine[:, :, rows]), code).T.astype(float)

    v = index.codes.select(F.col("id").alias(index.id_col), F.col("code").alias(index.vector))
    return _tiled(v, queries, n, index.id_col, index.vector, None, held=HELD, rows=_bytes, prepare=lambda q: _tables(held, q), product=scores)


def _least(index: Quantised, queries: DataFrame, n: int) -> DataFrame:
    """(id, least): an estimate that at least the n best vectors of each query (id, v) reach and few others do.

    Tiles of queries meet shards of codes; a cell counts its estimates by size, from the largest down to its own n-th, and a
    query's counts are added over the shards. What a task holds depends on neither n nor the table.
    """
    held, queries = _plain(index), queries.select("id", F.col("v").cast("array<double>").alias("v"))
    dealt = _cells(index.codes.select("id", F.col("code").alias("v")), queries, queries.count(), COUNTED)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for asked, scans in _cells_of(parts):
            ids = asked["id"].to_numpy()
            tables = _tables(held, _unit(np.stack(asked["v"].to_numpy()).astype(float)))
            counts, at = np.zeros(len(ids) * STEPS, np.int64), np.arange(len(ids)) * STEPS
            for df in scans:
                for a in range(0, len(df), CODES):
                    some = df.iloc[a : a + CODES]
                    s = _estimates(tables, _bytes(some["w"]))
                    step = np.clip((s + np.float32(1)) * np.float32(STEPS / 2), 0, STEPS - 1).astype(np.int64)
                    step[some["id"].to_numpy()[:, None] == ids[None]] = 0  # a query is no candidate of its own
                    counts += np.bincount((step + at).ravel(), minlength=len(counts))
            above = counts.reshape(-1, STEPS)[:, ::-1]
            far = (above.cumsum(axis=1) < n).sum(axis=1) + 1
            yield pd.DataFrame({"id": ids, "counts": [c[:f].astype(np.int64).tobytes() for c, f in zip(above, far)]})

    def added(t: pa.Table) -> pa.Table:
        total = np.zeros(STEPS, np.int64)
        for c in t["counts"]:
            c = np.frombuffer(c.as_py(), np.int64)
            total[: len(c)] += c
        # a shard's counts end at its own n-th, and the n-th of all lies no lower
        steps = int((total.cumsum() < n).sum()) + 1
        least = -np.inf if steps >= STEPS else (STEPS - steps) * 2 / STEPS - 1 - 1e-6
        return pa.table({"id": t["id"].slice(0, 1), "least": pa.array([least], pa.float64())})

    return dealt.mapInPandas(run, "id long, counts binary").groupBy("id").applyInArrow(added, "id long, least double")


def search(index: Quantised, queries: DataFrame, k: int = 10, rerank: int = 10, digits: int = 6) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best by exact cosine among the k * rerank best by their codes, and those of estimates within a step of the last."""
    q = queries.select(F.col(index.id_col).cast("long").alias("id"), F.col(index.vector).alias("v")).where("v is not null")
    least = _least(index, q, k * rerank).join(q, "id").select("id", F.concat(F.array("least"), F.col("v").cast("array<double>")).alias("v"))
    held, kind, width = _plain(index), _kind(index.vectors, index.vector), len(index.books) + 2

    def asked(column) -> np.ndarray:
        x = np.stack(column.to_numpy()).astype(float)
        return np.column_stack([x[:, :1], _unit(x[:, 1:])])

    def prepare(q: np.ndarray) -> tuple:
        return _tables(held, q[:, 1:]), q

    def scores(made: tuple, rows: np.ndarray, full: np.ndarray) -> np.ndarray:
        (coarse, fine), q = made
        if len(rows) < len(q):
            coarse, fine, q = coarse[:, rows], fine[:, :, rows], q[rows]
        v, u = np.nonzero(_estimates((coarse, fine), full[:, :width]) >= q[None, :, 0])
        x = _unit(np.ascontiguousarray(full[:, width:]).view(kind).astype(float))
        out = np.full((len(q), len(x)), -np.inf)
        for a in range(0, len(v), 1 << 16):
            i, j = u[a : a + (1 << 16)], v[a : a + (1 << 16)]
            out[i, j] = np.round(np.einsum("ij,ij->i", q[i, 1:], x[j]), digits) + 0.0
        return out

    v = index.codes.select(F.col("id").alias(index.id_col), F.col("full").alias(index.vector))
    q = written(least.toDF(index.id_col, index.vector), "least")
    return _tiled(v, q, k, index.id_col, index.vector, None, held=HELD, rows=_bytes, ask=asked, prepare=prepare, product=scores)
