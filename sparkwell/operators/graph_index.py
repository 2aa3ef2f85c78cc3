"""A navigable graph in each shard of the vectors: greedy search along stored neighbours, lists merged over shards.

Vectors are dealt by a hash of their ids to shards of about SHARD. In a shard every vector is linked with near vectors in
different directions (one that is closer to an already linked vector than to the vector itself is passed over), with those
that link it, and with a few random ones; the shard's adjacency, ids and vectors are stored as one row. A search starts at
the best of some entry points and always expands the nearest vectors that it has met and not expanded, until none of them can
improve its list of ``beam``; all queries of a task advance together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .analytics import top
from .embeddings import _unit

#: Vectors of a shard (on average), nearest ones considered, kept, linked back, and random links of a vector; entry points.
SHARD, NEAREST, LINKS, BACK, RANDOM, ENTRIES = 8192, 48, 12, 12, 2, 32
#: Queries of a task, vectors expanded in a step, and rows of a product.
TILE, STEP, ROWS = 4096, 2, 512


@dataclass
class Graph:
    """shards (shard, ids, vectors, links, entries), a row each, and the names of the vectors' columns."""

    shards: DataFrame
    n: int
    id_col: str
    vector: str


def neighbours(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(n, LINKS + BACK + RANDOM) positions linked with each unit vector, -1 where there are fewer."""
    n = len(x)
    c = min(NEAREST, n - 1)
    kept = np.full((n, LINKS), -1, np.int32)
    for s in range(0, n, ROWS):
        own = np.arange(s, min(n, s + ROWS))
        sims = x[own] @ x.T
        sims[np.arange(len(own)), own] = -np.inf
        near = np.argpartition(-sims, c - 1, axis=1)[:, :c] if c else np.zeros((len(own), 0), int)
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        close = np.take_along_axis(sims, near, 1)
        taken, passed = np.zeros(len(own), int), np.ones(near.shape, bool)
        r = np.arange(len(own))
        for j in range(c):
            v = x[near[:, j]]
            held = np.where(kept[own] >= 0, np.einsum("nd,nkd->nk", v, x[np.maximum(kept[own], 0)]), -np.inf)
            ok = (taken < LINKS) & (held.max(axis=1, initial=-np.inf) < close[:, j])
            kept[own[ok], taken[ok]] = near[ok, j]
            passed[r[ok], j] = False
            taken += ok
        for j in range(c):  # places left go to the nearest that were passed over
            ok = passed[:, j] & (taken < LINKS)
            kept[own[ok], taken[ok]] = near[ok, j]
            taken += ok
    back = np.full((n, BACK), -1, np.int32)
    a, j = np.nonzero(kept >= 0)
    to = kept[a, j]
    order = np.lexsort((j, to))  # the closest links first
    a, to = a[order], to[order]
    place = np.arange(len(to)) - np.searchsorted(to, to)
    ok = place < BACK
    back[to[ok], place[ok]] = a[ok]
    far = rng.integers(0, n, (n, RANDOM)).astype(np.int32) if n > 1 else np.full((n, RANDOM), -1, np.int32)
    return np.hstack([kept, back, far])


def walk(x: np.ndarray, links: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (queries x beam, -1: none) and similarities found for unit queries, and how many vectors each compared."""
    n, m = len(x), len(q)
    beam = min(beam, n)
    met = np.zeros((m, n), bool)
    met[:, entries] = True
    s = q @ x[entries].T
    width = beam + STEP * links.shape[1] + len(entries)
    at, sim, done = np.full((m, width), -1, np.int64), np.full((m, width), -np.inf, np.float32), np.ones((m, width), bool)
    at[:, : len(entries)], sim[:, : len(entries)], done[:, : len(entries)] = entries, s, False
    active = np.arange(m)
    while len(active):
        # keep the best of the list
        order = np.argsort(-sim[active], axis=1, kind="stable")
        for a in (at, sim, done):
            a[active] = np.take_along_axis(a[active], order, 1)
        at[active, beam:], sim[active, beam:], done[active, beam:] = -1, -np.inf, True
        waiting = ~done[active, :beam]
        active = active[waiting.any(axis=1)]
        if not len(active):
            break
        waiting = ~done[active, :beam]
        rank = np.cumsum(waiting, axis=1)
        r, p = np.nonzero(waiting & (rank <= STEP))  # the nearest that wait
        done[active[r], p] = True
        who = active[r]
        step = rank[r, p] - 1
        to = links[at[who, p]]
        ok = to >= 0
        row, col = np.nonzero(ok)
        qi, ti = who[row], to[row, col]
        new = ~met[qi, ti]
        row, col, qi, ti = row[new], col[new], qi[new], ti[new]
        key = qi.astype(np.int64) * n + ti  # a vector may be linked by both that are expanded
        _, first = np.unique(key, return_index=True)
        row, col, qi, ti = row[first], col[first], qi[first], ti[first]
        met[qi, ti] = True
        place = beam + step[row] * links.shape[1] + col
        at[qi, place], done[qi, place] = ti, False
        sim[qi, place] = np.einsum("ij,ij->i", q[qi], x[ti])
    return at[:, :beam], sim[:, :beam], met.sum(axis=1)


def build(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", seed: int = 42) -> Graph:
    """A graph of every shard. Null vectors are left out."""
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    n = v.count()
    shards = max(1, round(n / SHARD))

    def link(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = _unit(t["v"].combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)).astype(np.float32)
        rng = np.random.default_rng([seed, t["shard"][0].as_py()])
        entries = np.sort(rng.permutation(len(x))[:ENTRIES]).astype(np.int32)
        blob = lambda a: pa.array([a.tobytes()], pa.binary())
        return pa.table({"shard": t["shard"].slice(0, 1), "ids": blob(t["id"].to_numpy()), "vectors": blob(x), "links": blob(neighbours(x, rng)), "entries": blob(entries)})

    dealt = v.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(shards)).cast("int"))
    made = dealt.groupBy("shard").applyInArrow(link, "shard int, ids binary, vectors binary, links binary, entries binary")
    return Graph(written(made, "graph"), n, id_col, vector)


def search(graph: Graph, queries: DataFrame, k: int = 10, beam: int = 32, digits: int = 6, compared=None) -> DataFrame:
    """(query_id, rank, vec_id, score): approximate cosine search; ties of the rounded score go to the smaller id.

    Every query goes to every shard, in tiles. compared: an accumulator of the vectors compared.
    """
    q = queries.where(F.col(graph.vector).isNotNull()).select(F.col(graph.id_col).cast("long").alias("query_id"), F.col(graph.vector).alias("q"))
    tiles = max(1, -(-q.count() // TILE))
    links = LINKS + BACK + RANDOM

    def run(asked: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if asked.num_rows and shard.num_rows:
            read = lambda name, kind: np.frombuffer(shard[name][0].as_py(), kind)
            ids = read("ids", np.int64)
            x, near, entries = read("vectors", np.float32).reshape(len(ids), -1), read("links", np.int32).reshape(len(ids), links), read("entries", np.int32)
            who = asked["query_id"].to_numpy()
            u = _unit(asked["q"].combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(who), -1)).astype(np.float32)
            for s in range(0, len(who), ROWS):
                at, sim, n = walk(x, near, entries, u[s : s + ROWS], max(beam, k + 1))
                if compared is not None:
                    compared.add(int(n.sum()))
                sim = np.where((at >= 0) & (ids[at] != who[s : s + ROWS, None]), sim, -np.inf)
                order = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                r, c = np.nonzero(np.take_along_axis(sim, order, 1) > -np.inf)
                place = at[r, order[r, c]]
                exact = np.einsum("ij,ij->i", u[s + r].astype(float), x[place].astype(float))
                out.append((who[s + r], ids[place], exact))
        q_, v_, s_ = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": q_, "vec_id": v_, "score": s_})

    tile = F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int")
    shards = graph.shards.select("shard").collect()  # their numbers
    every = F.array(*(F.lit(r["shard"]) for r in shards)) if shards else F.array().cast("array<int>")
    asked = q.select(tile.alias("tile"), F.explode(every).alias("shard"), "query_id", "q")
    held = graph.shards.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("t"), F.col("shard").alias("s"), "ids", "vectors", "links", "entries")
    found = asked.groupBy("shard", "tile").cogroup(held.groupBy("s", "t")).applyInArrow(run, "query_id long, vec_id long, score double")
    found = found.withColumn("score", F.round("score", digits) + F.lit(0.0))
    return top(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")
