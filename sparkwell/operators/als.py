"""Implicit alternating least squares in blocks: confidence-weighted normal equations with a shared Gram matrix.

Of a row u with stored pairs (u, i, c) the factors solve (G + sum (c - 1) y y' + lambda I) x = sum c y, where y are the other
side's factors and G = Y'Y is summed once a half-step: unstored pairs have confidence 1 and preference 0, and lambda is the
same for every row. A row with fewer pairs than the rank is solved in the space of its pairs (the same equations by Woodbury).

Pairs are dealt in blocks of rows once, rows with near partners together, so that a block needs few of the other side's
factors; every row carries the numbers of the blocks that need it, and in a half-step its factors go once to each, in one
shuffle. A row with more than MOST_PAIRS pairs is dealt over several blocks, whose sums are added before it is solved. Several
ranks are fitted side by side in the same half-steps, and every iteration's loss over all stored pairs comes with its last
half-step.

Factors travel as 32-bit floats, but for those of the last iteration, and are computed with in 64 bits. Users are written to
the shared folder after their half-step; items are kept by the executors, in memory or on disk, and follow from the stored
users, so a lost executor repeats one half-step at most. The driver holds the Gram matrices alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import drop, written

#: Pairs of a block (on average), and pairs of one row that stay together.
BLOCK_PAIRS, MOST_PAIRS = 50_000, 100_000
#: Numbers of the systems solved at once in a task.
CELLS = 2_000_000


def _places(rows: DataFrame, total: int, most: int) -> DataFrame:
    """(id, near, block, parts) of rows (id, near, n): blocks of about as many pairs, rows in the order of near; parts of rows above most, else null."""
    spark = rows.sparkSession
    n = max(-(-total // BLOCK_PAIRS), min(spark.sparkContext.defaultParallelism, total // 2000), 1)
    ranged = written(rows.repartitionByRange("near", "id").withColumn("part", F.spark_partition_id()), "als-ranges")
    light = F.when(F.col("n") <= most, F.col("n")).otherwise(0)
    starts = ranged.groupBy("part").agg(F.sum(light).alias("m"))
    starts = starts.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    before = F.coalesce(F.sum(light).over(Window.partitionBy("part").orderBy("near", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    block = F.floor((F.col("start") + F.col("before")) / F.lit(max(1, -(-total // n))))
    placed = ranged.withColumn("before", before).join(F.broadcast(starts), "part")  # a row a partition
    out = written(placed.select("id", "near", block.alias("block"), F.when(F.col("n") > most, F.ceil(F.col("n") / most)).alias("parts")), "als-places")
    drop(ranged)
    return out


def _block(key: str, other: str, block: str, parts: str):
    """A pair's block: its row's, or of a row with many pairs one of its own, below zero."""
    apart = -1 - F.shiftrightunsigned(F.xxhash64(key, F.pmod(F.xxhash64(other), F.col(parts))), 1)
    return F.when(F.col(parts).isNull(), F.col(block)).otherwise(apart)


def _deal(pairs: DataFrame, total: int, most: int) -> DataFrame:
    """Pairs with the user's and the item's block (u, i, c, bu, bi). Users lie by their least item, items by the least such item of their users."""
    users = _places(pairs.groupBy(F.col("u").alias("id")).agg(F.min("i").alias("near"), F.count("*").alias("n")), total, most)
    near = pairs.join(users.select(F.col("id").alias("u"), "near"), "u")
    items = _places(near.groupBy(F.col("i").alias("id")).agg(F.min("near").alias("near"), F.count("*").alias("n")), total, most)
    p = pairs.join(users.select(F.col("id").alias("u"), F.col("block").alias("b"), F.col("parts").alias("p")), "u")
    p = p.select("u", "i", "c", _block("u", "i", "b", "p").alias("bu"))
    p = p.join(items.select(F.col("id").alias("i"), F.col("block").alias("b"), F.col("parts").alias("p")), "i")
    out = written(p.select("u", "i", "c", "bu", _block("i", "u", "b", "p").alias("bi")), "als-dealt")
    drop(users)
    drop(items)
    return out


def _side(dealt: DataFrame, key: str, other: str) -> tuple[DataFrame, DataFrame, bool]:
    """Blocks (block, key, other, c, ids, to), routes (id, to, block) and whether a row is dealt over several blocks.

    to: the other side's blocks that need the row's factors; ids and to of a block are those of its rows.
    """
    block = f"b{key}"
    routes = written(dealt.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set(f"b{other}")).alias("to"), F.max(block).alias("block")), "als-routes")
    sent = routes.where("block >= 0").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "to"))).alias("r"))
    rows = dealt.groupBy(F.col(block).alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(other).alias("other"), "c"))).alias("p"))
    blocks = rows.join(sent, "block", "left").select("block", "p.key", "p.other", "p.c", F.col("r.id").alias("ids"), F.col("r.to").alias("to"))
    return written(blocks, "als-blocks"), routes, not routes.where("block < 0").isEmpty()


def _slices(ranks: tuple[int, ...]) -> list[slice]:
    ends = np.cumsum(ranks)
    return [slice(int(e - r), int(e)) for e, r in zip(ends, ranks)]


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _numbers(t: pa.Table, column: str) -> np.ndarray:
    """The numbers of all lists of a column, one after another."""
    return t[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _rows_solved(y: np.ndarray, at: np.ndarray, c: np.ndarray, start: np.ndarray, size: np.ndarray, gram: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Factors and squared errors of rows with pairs start .. start + size: other's place in y and confidence; rows of one size together."""
    r = len(gram)
    base = gram + penalty * np.eye(r)
    x, sse = np.zeros((len(start), r)), np.zeros(len(start))
    inverse = white = None
    for m in np.unique(size):
        inside = penalty > 0 and m < r
        if inside and white is None:
            inverse = np.linalg.inv(np.linalg.cholesky(base))
            white = y @ inverse.T
        rows, step = np.flatnonzero(size == m), max(1, CELLS // int(max(m, r) * max(min(m, r), 1)))
        for z in range(0, len(rows), step):
            some = rows[z : z + step]
            pair = start[some][:, None] + np.arange(m)
            w = c[pair]
            v = (white if inside else y)[at[pair]]
            if inside:
                k = v @ v.transpose(0, 2, 1)
                a = np.linalg.solve(np.eye(m) + (w - 1)[..., None] * k, w[..., None])
                x[some] = (a.transpose(0, 2, 1) @ v)[:, 0] @ inverse
                told = (k @ a)[..., 0]
            else:
                a = base + (v * (w - 1)[..., None]).transpose(0, 2, 1) @ v
                x[some] = np.linalg.solve(a, (w[:, None, :] @ v).transpose(0, 2, 1))[..., 0]
                told = (v @ x[some][..., None])[..., 0]
            sse[some] = ((told - w) ** 2).sum(axis=1)
    return x, sse


def _solved(side: tuple[DataFrame, DataFrame, bool], factors: DataFrame, gram: list[np.ndarray], ranks: tuple[int, ...], penalty: float, kind: str) -> DataFrame:
    """(id, f, sse, to) of the side's rows: factors of all ranks one after another, and each rank's squared error over the row's pairs."""
    blocks, routes, hot = side
    parts, width = _slices(ranks), sum(ranks)
    upper = [np.triu_indices(r) for r in ranks]
    made_kind = "double" if hot else kind  # parts of a row stay sums
    number = {"double": (pa.float64(), np.float64), "float": (pa.float32(), np.float32)}
    schema = pa.schema([("id", pa.int32()), ("hot", pa.bool_()), ("f", pa.list_(number[made_kind][0])), ("sse", pa.list_(pa.float64())), ("to", pa.list_(pa.int64()))])

    def solve(block: pa.Table, sent: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        # a block has one row
        key, other, c = (_numbers(block, n) for n in ("key", "other", "c"))
        ids = sent["other"].to_numpy()
        order = np.argsort(ids)
        y = _numbers(sent, "f").reshape(-1, width)[order].astype(float)
        at = np.searchsorted(ids[order], other)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        if block["block"][0].as_py() >= 0:
            x, sse = np.zeros((len(start), width)), np.zeros((len(start), len(ranks)))
            for n, (w, g) in enumerate(zip(parts, gram)):
                x[:, w], sse[:, n] = _rows_solved(y[:, w], at, c, start, size, g, penalty)
            to = block["to"].combine_chunks().flatten()  # rows' ids in order, as the keys are
            return pa.Table.from_arrays([pa.array(key[start]), pa.array(np.zeros(len(start), bool)), _lists(x.astype(number[made_kind][1])), _lists(sse), to], schema=schema)
        out: dict[str, list] = {"id": [], "f": []}
        for s, e in zip(start, start + size):  # sums only
            sums = []
            for w, u in zip(parts, upper):
                v = y[at[s:e], w]
                sums += [((v.T * (c[s:e] - 1)) @ v)[u], (v.T @ v)[u], v.T @ c[s:e], [(c[s:e] ** 2).sum()]]
            out["id"].append(int(key[s]))
            out["f"].append(np.concatenate(sums))
        out |= {"hot": [True] * len(start), "sse": [[]] * len(start), "to": [[]] * len(start)}
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in schema}, schema)

    def together(t: pa.Table) -> pa.Table:
        """A dealt row from the sums of its parts."""
        total = np.zeros(t.num_rows)
        total[t["pos"].to_numpy()] = t["v"].to_numpy()
        x, sse, z = np.zeros(width), np.zeros(len(ranks)), 0
        for n, (w, u, g) in enumerate(zip(parts, upper, gram)):
            r, m = len(g), len(u[0])
            a, p = np.zeros((r, r)), np.zeros((r, r))
            a[u], p[u] = total[z : z + m], total[z + m : z + 2 * m]
            b, squares = total[z + 2 * m : z + 2 * m + r], total[z + 2 * m + r]
            a, p = (v + v.T - np.diag(np.diag(v)) for v in (a, p))
            x[w] = np.linalg.solve(g + a + penalty * np.eye(r), b)
            sse[n] = squares - 2 * x[w] @ b + x[w] @ p @ x[w]
            z += 2 * m + r + 1
        return pa.table({"id": t["id"].slice(0, 1), "f": pa.array([x]), "sse": pa.array([sse])})

    sent = factors.select(F.explode("to").alias("block"), F.col("id").alias("other"), "f")
    made = blocks.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(solve, f"id int, hot boolean, f array<{made_kind}>, sse array<double>, to array<bigint>")
    if not hot:
        return made.select("id", "f", "sse", "to")
    made = written(made, "als-parts")
    sums = made.where("hot").select("id", F.posexplode("f").alias("pos", "v")).groupBy("id", "pos").agg(F.sum("v").alias("v"))
    whole = sums.groupBy("id").applyInArrow(together, "id int, f array<double>, sse array<double>").join(routes.select("id", "to"), "id")
    out = made.where("not hot").select("id", "f", "sse", "to").union(whole).withColumn("f", F.col("f").cast(f"array<{kind}>"))
    out._parts = made
    return out


def _gram(factors: DataFrame, ranks: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Y'Y of each rank and the summed squared errors: one task's sums first, then Spark's."""
    parts, width = _slices(ranks), sum(ranks)
    ends = np.append(0, np.cumsum([r * r for r in ranks]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ends[-1] + len(ranks))
        for b in batches:
            f = b.column(0).flatten().to_numpy().reshape(-1, width).astype(float)
            for w, s, e in zip(parts, ends[:-1], ends[1:]):
                total[s:e] += (f[:, w].T @ f[:, w]).ravel()
            sse = b.column(1).flatten().to_numpy()
            if len(sse):
                total[ends[-1] :] += sse.reshape(-1, len(ranks)).sum(axis=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "v"])

    got = np.zeros(ends[-1] + len(ranks))
    for r in factors.select("f", "sse").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        got[r["at"]] = r["v"]
    return [got[s:e].reshape(r, r) for s, e, r in zip(ends[:-1], ends[1:], ranks)], got[ends[-1] :]


def _start(routes: DataFrame, width: int, seed: int) -> DataFrame:
    """(id, f, sse, to): small random factors that depend on the id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([np.random.default_rng([seed, i]).random(width) for i in b.column(0).to_numpy()]) * 0.01 if b.num_rows else np.zeros((0, width))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(x.astype(np.float32)), pa.array([[]] * b.num_rows, pa.list_(pa.float64())), b.column(1)], ["id", "f", "sse", "to"])

    return routes.select("id", "to").mapInArrow(run, "id int, f array<float>, sse array<double>, to array<bigint>")


def als(pairs: DataFrame, ranks: tuple[int, ...] = (128,), iterations: int = 15, penalty: float = 0.01, seed: int = 42, most: int = MOST_PAIRS) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Users and items (id, f with all ranks one after another) of pairs (u int, i int, c double), and each iteration's loss.

    The history has for each iteration and rank: the mean squared difference of predictions from the confidences over all
    stored pairs, and the norms of both factor matrices.
    """
    pairs = written(pairs.select("u", "i", F.col("c").cast("double").alias("c")), "als-pairs")
    n = pairs.count()
    dealt = _deal(pairs, n, most)
    by_user, by_item = _side(dealt, "u", "i"), _side(dealt, "i", "u")
    for x in (pairs, dealt):
        drop(x)
    items = _start(by_item[1], sum(ranks), seed)
    if not iterations:
        items = written(items.select("id", "f", "sse"), "als-items")
    gram, _ = _gram(items, ranks)
    users, history = None, []
    for turn in range(1, iterations + 1):
        last = turn == iterations
        kind, old_users, old_items = "double" if last else "float", users, items
        solved = _solved(by_user, items, gram, ranks, penalty, kind)
        users = written(solved, "als-users")
        drop(getattr(solved, "_parts", None))
        old_items.unpersist()
        gram, _ = _gram(users, ranks)
        size = [float(np.sqrt(np.trace(g))) for g in gram]
        solved = _solved(by_item, users, gram, ranks, penalty, kind)
        parts = getattr(solved, "_parts", None)
        if last or parts is not None:
            items = written(solved, "als-items")
            drop(parts)
        else:
            items = solved.persist(StorageLevel.MEMORY_AND_DISK)
        gram, sse = _gram(items, ranks)
        drop(old_users)
        history += [{"iterations": turn, "rank": r, "reconstruction_loss": float(s) / max(1, n), "item_factor_norm": float(np.sqrt(np.trace(g))), "user_factor_norm": u} for r, s, g, u in zip(ranks, sse, gram, size)]
    for x in (*by_user[:2], *by_item[:2]):
        drop(x)
    return users, items, history
