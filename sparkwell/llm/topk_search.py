"""Exact top-k search by inner product.

Queries whose matrix takes at most BLOCK_BYTES are broadcast, and the candidates stay where they are. More queries are dealt
over a grid of query tiles (TILE_BYTES) by candidate shards (SHARD_BYTES), both shuffled by cell, so nothing passes the
driver; a row's place comes from its position, so no id is hot. Inside a task the scan runs as tiled matrix products (TILE
queries by SHARD candidates); each tile keeps its k best by partial selection and merges them into the task's running
lists. The lists of all tasks are then merged as a tree of FAN_IN, so no task reads a list from every other one.

Scores are exact integers: products run in float32 or float64 where every sum is below their mantissa's range, and in
Python integers (clamped to 64 bits) beyond. Ties go to the smaller id.

Defined results: vectors that are null or hold null or non-finite components take no part; only vectors of one length
are compared; a row is no candidate for the query of its own id; repeated rows are repeated candidates but one query;
different query rows of one id share that id's k best; a null id takes no part; empty tables give no row; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches

BLOCK_BYTES = 16 << 20
TILE_BYTES = 64 << 20
SHARD_BYTES = 256 << 20
TILE = 512
SHARD = 4096
FAN_IN = 16


def matrices(batch: pa.RecordBatch, ids: int = 0, vectors: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, float64 matrix) of a batch for each vector length; rows with null parts or non-finite components are left out."""
    col = batch.column(vectors)
    if not len(col):
        return
    length = np.array([-1 if n is None else n for n in pa.compute.list_value_length(col).to_pylist()])
    flat = col.flatten()
    value = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: NaN
    start = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    key = batch.column(ids)
    known = np.array(key.is_valid())
    number = key.fill_null(0).to_numpy(zero_copy_only=False)
    for d in np.unique(length[length >= 0]):
        rows = np.flatnonzero((length == d) & known)
        x = value[start[rows][:, None] + np.arange(d)]
        ok = np.isfinite(x).all(axis=1)
        if ok.any():
            yield number[rows[ok]], x[ok]


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = q.shape[1] * (np.abs(q).max(initial=0) or 1) * (np.abs(c).max(initial=0) or 1)
    if most < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(v) for v in row] for row in q], object).reshape(q.shape) @ np.array([[int(v) for v in row] for row in c], object).reshape(c.shape).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and score of each row's k best: by score, then smaller id. ids: one row for all, or one for each; negative scores marked absent are dropped by the caller."""
    n = score.shape[1]
    if ids.ndim == 1:
        ids = np.broadcast_to(ids, score.shape)
    if n > 4 * k:
        # all above the k-th score, and every tie with it
        kth = np.partition(score, n - k, axis=1)[:, n - k]
        row, at = np.nonzero(score >= kth[:, None])
    else:
        row, at = (x.ravel() for x in np.indices(score.shape))
    s, i = score[row, at], ids[row, at]
    order = np.lexsort((i, ~s, row))  # ~s falls as s rises, without overflow
    row, s, i = row[order], s[order], i[order]
    first = np.searchsorted(row, np.arange(score.shape[0]))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], i[keep], s[keep]


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest of floor(scale * x) inner products for each query row."""
    bounded_batches(spark)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q"))
    asked = v.where("q and id is not null and v is not null").select("id", "v")
    c = v.where("id is not null and v is not null").select("id", "v")
    size = v.agg(F.count(F.when(F.col("q") & F.col("v").isNotNull(), 1)).alias("n"), F.max(F.when(F.col("q"), F.size("v"))).alias("d"), F.sum(8.0 * F.size("v")).alias("bytes")).first()
    need, shape = 8 * size["n"] * max(1, size["d"] or 1), "query_id long, vec_id long, score long, part long"
    if need <= BLOCK_BYTES:
        held = spark.sparkContext.broadcast(_queries(((r["id"], np.array([np.nan if y is None else y for y in r["v"]], np.float64)) for r in asked.toLocalIterator()), scale))
        parts = max(1, v.rdd.getNumPartitions())
        found = c.mapInArrow(_scan(held, k, scale), shape)
    else:
        tiles, parts = -(-need // TILE_BYTES), max(1, -(-int(size["bytes"] or 0) // SHARD_BYTES))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        place = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("long")
        rows = asked.withColumn("tile", place(tiles)).withColumn("shard", every(parts)).withColumn("candidate", F.lit(False))
        rows = rows.unionByName(c.withColumn("shard", place(parts)).withColumn("tile", every(tiles)).withColumn("candidate", F.lit(True)))
        dealt = rows.repartition("tile", "shard").sortWithinPartitions("tile", "shard", "candidate")
        found = dealt.select("id", "v", "tile", "shard", "candidate").mapInArrow(_scan_cells(k, scale), shape)
    merged, order = found, (F.col("score").desc(), F.col("vec_id"))
    while parts > 1:
        parts = -(-parts // FAN_IN)
        merged = merged.withColumn("part", (F.col("part") / FAN_IN).cast("long"))
        w = Window.partitionBy("query_id", "part").orderBy(*order)
        merged = merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    w = Window.partitionBy("query_id").orderBy(*order)
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _queries(rows: Iterator[tuple[int, np.ndarray]], scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and scaled vectors of different finite query rows, by vector length."""
    by: dict[int, dict] = {}
    for i, x in rows:
        if np.isfinite(x).all():
            by.setdefault(len(x), {})[i, x.tobytes()] = scaled(x, scale)
    return {d: (np.array([i for i, _ in x], np.int64), np.stack([*x.values()])) for d, x in by.items()}


class _Lists:
    """The k best candidates so far of each query, from whole tiles of candidates."""

    def __init__(self, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> None:
        self.queries, self.k = queries, k
        self.lists: dict[tuple[int, int], tuple] = {}  # by vector length and tile: rows, ids, scores
        self.waiting: dict[int, list] = {}

    def add(self, ids: np.ndarray, x: np.ndarray, least: int = SHARD) -> None:
        d = x.shape[1]
        if d in self.queries:
            self.waiting.setdefault(d, []).append((ids, x))
            if sum(len(i) for i, _ in self.waiting[d]) >= least:
                ids, x = (np.concatenate(z) for z in zip(*self.waiting.pop(d), strict=True))
                for r in range(0, len(ids), SHARD):
                    self._fold(d, ids[r : r + SHARD], x[r : r + SHARD])

    def _fold(self, d: int, ids: np.ndarray, x: np.ndarray) -> None:
        qid, q = self.queries[d]
        k = self.k + int(np.max(np.unique(ids, return_counts=True)[1]))  # the query's own rows besides
        for t in range(0, len(qid), TILE):
            own = qid[t : t + TILE]
            row, i, s = best(products(q[t : t + TILE], x), ids, k)
            other = i != own[row]
            row, i, s = row[other], i[other], s[other]
            if (d, t) in self.lists:
                row, i, s = (np.concatenate(z) for z in zip(self.lists[d, t], (row, i, s), strict=True))
            order = np.lexsort((i, ~s, row))
            row, i, s = row[order], i[order], s[order]
            keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(own)))[row] < self.k
            self.lists[d, t] = row[keep], i[keep], s[keep]

    def rows(self, part: int) -> Iterator[pa.RecordBatch]:
        for rows in [r for w in self.waiting.values() for r in w]:
            self.add(rows[0][:0], rows[1][:0], 0)
        for (d, t), (row, i, s) in self.lists.items():
            yield pa.RecordBatch.from_arrays([pa.array(self.queries[d][0][t + row]), pa.array(i), pa.array(s), pa.array(np.full(len(i), part, np.int64))], ["query_id", "vec_id", "score", "part"])


def _scan(held, k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lists = _Lists(held.value, k)
        for b in batches:
            for ids, x in matrices(b):
                lists.add(ids, scaled(x, scale))
        yield from lists.rows(TaskContext.get().partitionId())

    return run


def _scan_cells(k: int, scale: float):
    """The lists of each cell of the grid: its queries come first, and then its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, lists = None, [], None
        for b in batches:
            tile, shard, candidate = (b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4))
            new = np.flatnonzero((np.diff(tile, prepend=-1) != 0) | (np.diff(shard, prepend=-1) != 0) | np.diff(candidate.astype(int), prepend=-1).astype(bool))
            for s, e in zip(new, np.append(new[1:], b.num_rows), strict=True):
                if (tile[s], shard[s]) != at:
                    if lists is not None:
                        yield from lists.rows(at[1])
                    at, asked, lists = (tile[s], shard[s]), [], None
                for ids, x in matrices(b.slice(s, e - s)):
                    if not candidate[s]:
                        asked += zip(ids.tolist(), x, strict=True)
                        continue
                    if lists is None:
                        lists, asked = _Lists(_queries(iter(asked), scale), k), []
                    lists.add(ids, scaled(x, scale))
        if lists is not None:
            yield from lists.rows(at[1])

    return run
