"""Implicit-feedback collaborative filtering on the interaction matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.shared import written
from .als import als
from .analytics import als_cold_items, index_of, top

ITERATIONS = (1, 3, 5, 10, 15, 20, 25, 30)
SIZES = (32, 64, 128, 256)


#: Users of a cell (on average) and items of a block: a user is sent once to each block it needs, an item once to each tile, so both
#: are large (of 128 factors 34 and 67 MB). The first block, which every user meets, is small, and tiles are no larger than all cores ask for.
TILE_USERS, BLOCK_ITEMS, FIRST_ITEMS, LEAST_TILE = 65536, 131072, 8192, 4096
#: Scores that a task holds at once, and items of one product.
MOST_SCORES, STRIP_ITEMS = 1_000_000, 4096
#: What a product in 32 bits may be off, as a share of both norms.
SLACK = 5e-5


def _best_of_cell(k: int):
    """The k best unseen items of a block for each user of a tile (rows with f are users, those with doc_id are seen pairs).

    Users with a score to reach (least) get the items that reach it, or the best of them: products in 32 bits leave few pairs, and those
    are computed in 64 bits.
    """

    def run(users: pa.Table, items: pa.Table) -> pa.Table:
        asked = users.filter(pc.is_valid(users["f"]))
        ids, who = items["doc_id"].combine_chunks(), asked["physician_id"].combine_chunks()
        matrix = lambda t: t["f"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        if not len(ids) or not len(who):
            return pa.table({"physician_id": who.slice(0, 0), "doc_id": ids.slice(0, 0), "score": pa.array([], pa.float64())})
        seen = users.filter(pc.is_null(users["f"]))
        row, col = (pc.index_in(seen[n], v).to_numpy() for n, v in (("physician_id", who), ("doc_id", ids)))
        order = np.lexsort((row, col // STRIP_ITEMS))
        row, col = row[order], col[order]
        ends = np.searchsorted(col // STRIP_ITEMS, np.arange(-(-len(ids) // STRIP_ITEMS) + 1))
        least = np.full(len(who), -np.inf)
        if "least" in asked.column_names:
            least = pc.fill_null(asked["least"].combine_chunks(), -np.inf).to_numpy(zero_copy_only=False)
        dots = lambda a, b: np.einsum("ij,ij->i", a.astype(float), b.astype(float))  # noqa: E731 equal items get equal scores
        x, y = matrix(asked), matrix(items)
        found = []
        for c, z0 in enumerate(range(0, len(ids), STRIP_ITEMS)):
            strip = y[z0 : z0 + STRIP_ITEMS]
            exact, rough = strip.astype(float).T, strip.astype(np.float32).T
            r, o = row[ends[c] : ends[c + 1]], col[ends[c] : ends[c + 1]] - z0
            far = SLACK * np.sqrt((exact * exact).sum(axis=0).max())
            m, step = min(k, len(strip)), max(1, MOST_SCORES // len(strip))
            for z in range(0, len(x), step):
                f, least_ = x[z : z + step], least[z : z + step]
                a, b = np.searchsorted(r, [z, z + len(f)])
                if np.isfinite(least_).all():
                    s = f.astype(np.float32) @ rough
                    s[r[a:b] - z, o[a:b]] = -np.inf
                    u, i = np.divmod(np.flatnonzero(s >= (least_ - far * np.linalg.norm(f.astype(float), axis=1))[:, None].astype(np.float32)), len(strip))
                    if len(u) <= 4 * k * len(f):
                        got = dots(f[u], strip[i])
                        stay = got >= least_[u] - 1e-9 * np.abs(least_[u])
                        found.append((u[stay] + z, i[stay] + z0, got[stay]))
                        continue
                s = f.astype(float) @ exact
                s[r[a:b] - z, o[a:b]] = -np.inf
                best = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                u, i = np.nonzero((s >= best[:, None]) & (s > -np.inf))  # ties at the border included
                found.append((u + z, i + z0, dots(f[u], strip[i])))
        u, i, s = (np.concatenate(x) for x in zip(*found))
        return pa.table({"physician_id": who.take(pa.array(u)), "doc_id": ids.take(pa.array(i)), "score": pa.array(s)})

    return run


@dataclass
class Factors:
    """users (physician_id, factors), items (doc_id, factors) and the documents below the cold-start threshold."""

    users: DataFrame
    items: DataFrame
    cold: DataFrame
    rank: int

    def zeros(self):
        return F.array_repeat(F.lit(0.0).cast("float"), self.rank)

    def item_factors(self, ids: DataFrame | None = None) -> DataFrame:
        """(doc_id, factors): zeros for cold and unknown documents. Without ids, all documents of the matrix."""
        warm = self.items.join(self.cold.select("doc_id"), "doc_id", "left_anti")
        ids = self.items.select("doc_id") if ids is None else ids.select("doc_id")
        return ids.join(warm, "doc_id", "left").select("doc_id", F.coalesce("factors", self.zeros()).alias("factors"))

    def user_factors(self, ids: DataFrame) -> DataFrame:
        """(physician_id, factors): zeros for unknown physicians."""
        return ids.select("physician_id").join(self.users, "physician_id", "left").select("physician_id", F.coalesce("factors", self.zeros()).alias("factors"))

    def augmented(self, content: DataFrame, column: str = "features") -> DataFrame:
        """content (doc_id, features) with the item factors appended."""
        return content.join(self.item_factors(content.select("doc_id").distinct()), "doc_id").withColumn(column, F.concat(F.col(column), F.transform("factors", lambda x: x.cast("double")))).drop("factors")

    def recommend(self, users: DataFrame, k: int = 10, seen: DataFrame | None = None) -> DataFrame:
        """(physician_id, rank, doc_id, score) by raw factors, cold documents included; unknown physicians get no row.

        seen: interactions whose pairs are left out. Items lie in blocks by falling norm. Every user meets the first block;
        its k-th score is what an item of a further block must reach, and by Cauchy-Schwarz a user's scan ends where the
        product of norms falls below it. Users are sent to the blocks they still need, in tiles, with their seen pairs of the
        block; no user's seen items are ever in one list.
        """
        kinds = f"physician_id {self.users.schema['physician_id'].dataType.simpleString()}, doc_id {self.items.schema['doc_id'].dataType.simpleString()}, score double"
        length = F.sqrt(F.aggregate("factors", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        u = users.select("physician_id").distinct().join(self.users, "physician_id").select("physician_id", F.col("factors").alias("f"), length.alias("norm"))
        u = written(u, "users")
        n = u.count()
        tiles = max(1, -(-n // TILE_USERS), min(u.sparkSession.sparkContext.defaultParallelism, n // LEAST_TILE))
        u = u.withColumn("tile", F.pmod(F.xxhash64("physician_id"), F.lit(tiles)))
        items = written(self.items.select("doc_id", F.col("factors").alias("f"), length.alias("norm")), "items")
        first_items = min(FIRST_ITEMS, BLOCK_ITEMS)
        place = index_of(items.select(F.struct((-F.col("norm")).alias("n"), "doc_id").alias("x")), "x").select(F.col("x.doc_id").alias("doc_id"), F.when(F.col("idx") < first_items, 0).otherwise(1 + F.floor((F.col("idx") - first_items) / BLOCK_ITEMS)).cast("int").alias("block"))
        items = written(items.join(place, "doc_id"), "blocks")
        bounds = np.array([r["n"] for r in items.groupBy("block").agg(F.max("norm").alias("n")).orderBy("block").collect()])  # one number a block
        pairs = None
        if seen is not None:
            pairs = written(seen.select("physician_id", "doc_id").distinct().join(items.select("doc_id", "block"), "doc_id"), "seen")

        def met(need: DataFrame) -> DataFrame:
            """Scores of the users in need (physician_id, f, least, tile, block) with their blocks' items."""
            cell = ["block", "tile"]
            side = need.select(*cell, "physician_id", "f", "least", F.lit(None).cast(items.schema["doc_id"].dataType).alias("doc_id"))
            if pairs is not None:
                left = pairs.join(need.select(*cell, "physician_id"), ["physician_id", "block"])
                side = side.union(left.select(*cell, "physician_id", F.lit(None).cast(items.schema["f"].dataType), F.lit(None).cast("double"), "doc_id"))
            block = need.select(*cell).distinct().join(items.select("block", "doc_id", "f"), "block").toDF("b", "t", "doc_id", "f")
            return side.groupBy(*cell).cogroup(block.groupBy("b", "t")).applyInArrow(_best_of_cell(k), kinds)

        first = written(met(u.withColumns({"block": F.lit(0), "least": F.lit(None).cast("double")})), "first")
        kth = top(first, ["physician_id"], [F.col("score").desc(), F.col("doc_id")], k).groupBy("physician_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The number of blocks whose items can reach a user's k-th score; all, where fewer than k are found."""
            for b in batches:
                norm, least = b.column(3).to_numpy(), pc.fill_null(b.column(4), -np.inf).to_numpy(zero_copy_only=False)
                n = [len(bounds) if t <= 0 else int(np.searchsorted(-bounds * v * (1 + 1e-9), -t, "right")) for v, t in zip(norm, least)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(4), pa.array(n, pa.int32())], ["physician_id", "f", "tile", "least", "n"])

        open_ = u.join(kth, "physician_id", "left").select("physician_id", "f", "tile", "norm", "least")
        open_ = open_.mapInArrow(reach, f"{kinds.split(',')[0]}, f {items.schema['f'].dataType.simpleString()}, tile long, least double, n int").where("n > 1")
        more = met(open_.withColumn("block", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).drop("n"))
        return top(first.union(more), ["physician_id"], [F.col("score").desc(), F.col("doc_id")], k).select("physician_id", "rank", "doc_id", "score")

    def reconstruction(self, matrix: DataFrame) -> DataFrame:
        """One row: the mean squared difference of predictions from the confidences over all stored pairs, and factor norms."""
        p = matrix.join(self.users.withColumnRenamed("factors", "u"), "physician_id").join(self.items.withColumnRenamed("factors", "v"), "doc_id")
        loss = p.agg(F.avg(F.pow(S.dot(F.col("u"), F.col("v")) - F.col("confidence"), 2)).alias("reconstruction_loss"))
        size = lambda df, name: df.agg(F.sqrt(F.sum(F.pow(S.norm(F.col("factors")), 2))).alias(name))
        return loss.crossJoin(size(self.items, "item_factor_norm")).crossJoin(size(self.users, "user_factor_norm"))


def _fitted(matrix: DataFrame, ranks: tuple[int, ...], iterations: int, regularization: float, alpha: float, seed: int, cold_threshold: int) -> tuple[list[Factors], list[dict]]:
    """Factors of each rank from one fit, and its history."""
    u, i = (written(index_of(matrix, k).withColumnRenamed("idx", n), "als-ids") for k, n in (("physician_id", "u"), ("doc_id", "i")))
    data = matrix.join(u, "physician_id").join(i, "doc_id").select("u", "i", (1 + alpha * F.col("weighted_score").cast("double")).alias("c"))
    users, items, history = als(data, ranks, iterations, regularization, seed)
    cold, out, start = als_cold_items(matrix, cold_threshold), [], 1
    for r in ranks:
        f = F.transform(F.slice("f", start, r), lambda x: x.cast("float")).alias("factors")
        out.append(Factors(users.join(u, F.col("id") == F.col("u")).select("physician_id", f), items.join(i, F.col("id") == F.col("i")).select("doc_id", f), cold, r))
        start += r
    return out, history


def fit_als(matrix: DataFrame, rank: int = 128, iterations: int = 15, regularization: float = 0.01, alpha: float = S.ALPHA, seed: int = 42, cold_threshold: int = S.COLD_START) -> Factors:
    """Factors of an interaction matrix (physician_id, doc_id, weighted_score, ...), whose confidence is 1 + alpha * weighted_score."""
    return _fitted(matrix, (rank,), iterations, regularization, alpha, seed, cold_threshold)[0][0]


def convergence(matrix: DataFrame, most: int = 30, rank: int = 128, iterations: tuple[int, ...] = ITERATIONS) -> DataFrame:
    """(iterations, reconstruction_loss, item_factor_norm, user_factor_norm) after those iterations of one fit."""
    asked = [n for n in iterations if n <= most]
    _, history = _fitted(matrix, (rank,), max(asked, default=0), 0.01, S.ALPHA, 42, S.COLD_START)
    rows = [(h["iterations"], h["reconstruction_loss"], h["item_factor_norm"], h["user_factor_norm"]) for h in history if h["iterations"] in asked]
    return matrix.sparkSession.createDataFrame(rows, "iterations int, reconstruction_loss double, item_factor_norm double, user_factor_norm double")


def factor_sizes(matrix: DataFrame, sizes: tuple[int, ...] = SIZES, iterations: int = 15) -> DataFrame:
    """(factors, reconstruction_loss, memory_mb) of several ranks, fitted side by side."""
    _, history = _fitted(matrix, sizes, iterations, 0.01, S.ALPHA, 42, S.COLD_START)
    loss = {h["rank"]: h["reconstruction_loss"] for h in history if h["iterations"] == iterations}
    n = matrix.agg((F.count_distinct("physician_id") + F.count_distinct("doc_id")).alias("n")).first()["n"]
    return matrix.sparkSession.createDataFrame([(k, loss[k], n * k * 4 / 1048576) for k in sizes], "factors int, reconstruction_loss double, memory_mb double")
