"""Embedding near-dedup with randomised-rotation binary codes.

A vector o of unit length is rotated by a random orthogonal matrix P; the signs of P o are its code, the unit vector
o' = sign(P o) / sqrt(D), and f = <o', P o> is the stored correction factor. For another unit vector q,
<o', P q> / f estimates <o, q> without bias, and its error is below EPSILON * sqrt((1 - f*f) / (f*f * (D - 1))) with high
probability. Only pairs whose estimate plus that bound reaches the threshold are recomputed exactly in double precision.

Candidates are found by the codes too: code bits (of as many rotations as needed) are cut into bands, and vectors of
one label that agree on a band meet in its bucket. A bit differs with probability angle / pi, so the band's width, from
the largest label's size, and the number of bands, from RECALL at the threshold itself, follow from the input. A pair
that meets in several bands is counted in the first only. Buckets over HOT_BUCKET vectors are dealt over a grid of
cells. Equal vectors collapse to one representative first (equal by a 128-bit digest).

The bands are shuffled twice. First go codes, factors and the rotated vector in one byte a component, whose rounding
error is added to the bound; this finds the rows of each bucket that are in some pair to recompute. Only these rows fetch
their vectors, and their buckets recompute the same pairs in double precision. A bucket returns link counts and a
spanning forest of its links, never its pairs.

Defined results: vectors that are null, empty or zero or hold null or non-finite components, and those with a null
label, link with nothing; only vectors of one length are compared; rows with one vec_id are one node, each returned; a
null vec_id links with nothing and keeps a null component; extra columns are ignored; empty tables give no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, components, runs, stored
from .topk_search import matrices

EPSILON = 3.5
RECALL = 0.998
HOT_BUCKET = 4096
TILE = 1024
PER_BUCKET = 16
#: Buckets up to this size are taken together, pair by pair; larger ones in tiles.
SMALL = 48
PAIRS = 1 << 17


def rotation(d: int, turn: int) -> np.ndarray:
    """A random orthogonal d x d matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([d, turn]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def signs(x: np.ndarray, bits: int) -> np.ndarray:
    """bits code bits of each row, from as many rotations as needed."""
    d = x.shape[1]
    return np.concatenate([x @ rotation(d, t).T > 0 for t in range(-(-bits // d))], axis=1)[:, :bits]


def bands_for(largest: int, threshold: float) -> tuple[int, int]:
    """Width in bits and number of bands, for the size of the largest label."""
    agree = 1 - math.acos(threshold) / math.pi
    width = max(4, math.ceil(math.log2(max(2, largest) / PER_BUCKET)))
    return width, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree**width)))


def _keys(code: np.ndarray, width: int, bands: int) -> np.ndarray:
    """The band keys (rows x bands) of codes."""
    c = code[:, : width * bands].reshape(len(code), bands, width)
    return (c * (1 << np.arange(width, dtype=np.int64))).sum(axis=2)


def unit_vectors(vectors: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, dim, f1, f2, v) of the vectors that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column(1)], ["i", "v"])
            for at, x in matrices(index):
                scale = np.abs(x).max(axis=1, initial=0)
                at, x = at[scale > 0], x[scale > 0] / scale[scale > 0][:, None]  # no overflow in the norm
                if not len(at) or not x.shape[1]:
                    continue
                fp = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r.tobytes()) for r in x), np.int64).reshape(-1, 2)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), pa.array(np.full(len(at), x.shape[1])), pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "label", "dim", "f1", "f2", "v"])

    v = vectors.select(F.col(id_col).cast("long"), vector, F.col(label).cast("string")).where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & F.col(vector).isNotNull())
    return v.mapInArrow(run, "vec_id long, label string, dim long, f1 long, f2 long, v binary")


def _coded(reps: DataFrame, width: int, bands: int) -> DataFrame:
    """reps with code (bits), f and the rotated vector in bytes: q and its unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(dim):
                rows = b.take(pa.array(np.flatnonzero(dim == d)))
                for s in range(0, rows.num_rows, 512):
                    part = rows.slice(s, 512)
                    x = np.frombuffer(b"".join(part.column("v").to_pylist())).reshape(part.num_rows, d)
                    packed = [r.tobytes() for r in np.packbits(signs(x, max(width * bands, int(d))), axis=1)]
                    turned = x @ rotation(int(d), 0).T
                    f = np.abs(turned).sum(axis=1) / math.sqrt(d)
                    unit = np.abs(turned).max(axis=1) / 127
                    q = [r.tobytes() for r in np.rint(turned / unit[:, None]).astype(np.int8)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(packed, pa.binary()), pa.array(f), pa.array(unit), pa.array(q, pa.binary())], [*part.schema.names, "code", "f", "unit", "q"])

    return reps.mapInArrow(run, "label string, dim long, f1 long, f2 long, uid long, rep long, copies long, v binary, code binary, f double, unit double, q binary")


def _banded(coded: DataFrame, width: int, bands: int) -> DataFrame:
    """A row for each band of each vector: (label, dim, band, key, uid, code, f, unit, q)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                n = part.num_rows
                key = _keys(_bits(part.column("code").to_pylist(), width * bands), width, bands)
                take = pa.array(np.repeat(np.arange(n), bands))
                yield pa.RecordBatch.from_arrays([part.column(c).take(take) for c in SENT] + [pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), pa.array(key.ravel())], [*SENT, "band", "key"])

    return coded.select(*SENT).mapInArrow(run, "label string, dim long, uid long, code binary, f double, unit double, q binary, band int, key long")


SENT = ("label", "dim", "uid", "code", "f", "unit", "q")


def _bits(code: list[bytes], most: int) -> np.ndarray:
    """The first bits of codes (which may be of several lengths)."""
    n = -(-most // 8)
    return np.unpackbits(np.frombuffer(b"".join(c[:n] for c in code), np.uint8).reshape(len(code), -1), axis=1)[:, :most]


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest row linked with each of n rows, by repeated minima."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[u], low[v])
        new = low.copy()
        np.minimum.at(new, u, m)
        np.minimum.at(new, v, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


class _Buckets:
    """The pairs to recompute of a run of buckets: estimate plus bound reaches the threshold, and no earlier band holds both."""

    def __init__(self, c: dict[str, np.ndarray], threshold: float, width: int, bands: int) -> None:
        self.c, self.threshold = c, threshold
        self.keys = _keys(_bits(list(c["code"]), width * bands), width, bands).astype(np.int32 if width < 31 else np.int64)
        f, d = c["f"], c["dim"].astype(float)
        self.bound = EPSILON * np.sqrt(np.maximum(0, 1 - f * f) / (f * f * np.maximum(1, d - 1))) + 1e-5

    def vectors(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated vectors and code vectors (their products estimate) of rows of one dimension."""
        d = int(self.c["dim"][rows[0]])
        q = np.frombuffer(b"".join(self.c["q"][rows]), np.int8).reshape(len(rows), d) * (self.c["unit"][rows, None].astype(np.float32) / math.sqrt(d))
        return q, 2.0 * _bits(list(self.c["code"][rows]), d).astype(np.float32) - 1

    def reach(self, estimate: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Of estimates (the product with v's code) of rows u and v, which can reach the threshold."""
        d, f = self.c["dim"][v], self.c["f"][v]
        return (estimate + self.c["unit"][u] * np.sqrt(d) / 2) / f + self.bound[v] >= self.threshold

    def small(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the small buckets, many at once."""
        length = np.diff(at)
        start = at[:-1]
        for d in np.unique(self.c["dim"][start]):
            take = (length > 1) & (length <= SMALL) & (self.c["dim"][start] == d)
            if not take.any():
                continue
            rows = np.concatenate([np.arange(s, s + n) for s, n in zip(start[take], length[take], strict=True)])
            after = np.concatenate([np.arange(n - 1, -1, -1) for n in length[take]])  # rows after each in its bucket
            q, sign = self.vectors(rows)
            ends = np.cumsum(after)
            a = 0
            while a < len(rows):
                z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS)))
                u = np.repeat(np.arange(a, z), after[a:z])
                v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(after[a:z]) - after[a:z], after[a:z])
                near = self.reach(np.einsum("ij,ij->i", q[u], sign[v]), rows[u], rows[v])
                u, v = rows[u[near]], rows[v[near]]
                c = self.c
                ok = (c["i"][u] == c["j"][u]) | (c["b"][u] != c["b"][v])
                ok &= ~((self.keys[u] == self.keys[v]) & (np.arange(self.keys.shape[1]) < c["band"][u, None])).any(axis=1)
                if ok.any():
                    yield u[ok], v[ok]
                a = z

    def tiles(self, s: int, e: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row ranges of tiles of a large bucket, and which of their pairs to recompute."""
        c, rows = self.c, np.arange(s, e)
        q, sign = self.vectors(rows)
        for p in range(0, e - s, TILE):
            for r in range(p, e - s, TILE):
                u, v = rows[p : p + TILE], rows[r : r + TILE]
                near = self.reach(q[p : p + TILE] @ sign[r : r + TILE].T, u[:, None], v[None])
                if p == r:
                    near = np.triu(near, 1)
                if c["i"][s] != c["j"][s]:
                    near &= c["b"][u][:, None] != c["b"][v][None]
                if near.any():
                    for k in range(int(c["band"][s])):
                        near &= self.keys[u, k][:, None] != self.keys[v, k][None]
                    if near.any():
                        yield u, v, near


KEY = ["label", "dim", "band", "key", "i", "j"]


def _hopeful(cells: DataFrame, threshold: float, width: int, bands: int) -> DataFrame:
    """The rows of cells that are in a pair to recompute."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, at in runs(batches, KEY):
            found = np.zeros(at[-1], bool)
            buckets = _Buckets(c, threshold, width, bands)
            for u, v in buckets.small(at):
                found[u] = found[v] = True
            for s, e in zip(at[:-1], at[1:], strict=True):
                if e - s > SMALL:
                    for u, v, near in buckets.tiles(s, e):
                        found[u] |= near.any(axis=1)
                        found[v] |= near.any(axis=0)
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[found], pa.binary() if n in ("code", "q") else None) for n, x in c.items()], list(c))

    return cells.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(run, cells.schema)


def _links(cells: DataFrame, threshold: float, width: int, bands: int) -> DataFrame:
    """(uid, rep, links, root): for each cell the link counts and a spanning forest, from vectors in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, at in runs(batches, KEY):
            n, rep, copies = int(at[-1]), c["rep"], c["copies"].astype(float)
            links, us, vs = np.zeros(n), [], []
            buckets = _Buckets(c, threshold, width, bands)
            matrix = lambda rows: np.frombuffer(b"".join(c["v"][rows])).reshape(len(rows), -1)
            for u, v in buckets.small(at):
                for z in range(0, len(u), 16384):
                    uu, vv = u[z : z + 16384], v[z : z + 16384]
                    ok = np.empty(len(uu), bool)
                    for d in np.unique(c["dim"][uu]):
                        w = np.flatnonzero(c["dim"][uu] == d)
                        ok[w] = np.einsum("ij,ij->i", matrix(uu[w]), matrix(vv[w])) >= threshold
                    ok &= rep[uu] != rep[vv]
                    us.append(uu[ok])
                    vs.append(vv[ok])
                    links += np.bincount(uu[ok], copies[vv[ok]], n) + np.bincount(vv[ok], copies[uu[ok]], n)
            for s, e in zip(at[:-1], at[1:], strict=True):
                if e - s > SMALL:
                    x = matrix(np.arange(s, e))
                    for u, v, near in buckets.tiles(s, e):
                        near &= x[u[0] - s : u[-1] + 1 - s] @ x[v[0] - s : v[-1] + 1 - s].T >= threshold
                        near &= rep[u][:, None] != rep[v][None]
                        links[u] += near @ copies[v]
                        links[v] += copies[u] @ near
                        a, b = np.nonzero(near)
                        low = _forest(e - s, u[a] - s, v[b] - s)  # of the tile's links, a forest is enough
                        joined = np.flatnonzero(low != np.arange(e - s))
                        us.append(s + joined)
                        vs.append(s + low[joined])
            if not links.any():
                continue
            low = _forest(n, np.concatenate(us), np.concatenate(vs))
            has = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(c["uid"][has]), pa.array(rep[has]), pa.array(links[has].astype(np.int64)), pa.array(rep[low[has]])], ["uid", "rep", "links", "root"])

    dealt = cells.repartition(*KEY).sortWithinPartitions(*KEY)
    return dealt.mapInArrow(run, "uid long, rep long, links long, root long")


def near_dedup(spark: SparkSession, vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; links are pairs of one label with cosine >= threshold."""
    bounded_batches(spark)
    units = stored(unit_vectors(vectors, id_col, vector, label), "units")
    size = units.count()
    same = ["label", "dim", "f1", "f2"]
    classes = stored(units.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies")), "classes", size)
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    width, bands = bands_for(largest, threshold)
    reps = units.join(classes.withColumnRenamed("rep", "vec_id"), [*same, "vec_id"]).dropDuplicates([*same, "vec_id"])
    coded = stored(_coded(reps.select(*same, F.monotonically_increasing_id().alias("uid"), F.col("vec_id").alias("rep"), "copies", "v"), width, bands), "coded")
    banded = _banded(coded, width, bands)
    bucket = ["label", "dim", "band", "key"]
    hot = banded.groupBy(*bucket).count().where(F.col("count") > HOT_BUCKET).select(*bucket, F.ceil(F.col("count") / HOT_BUCKET).cast("int").alias("parts"))
    hot = stored(hot, "hot", size * bands // HOT_BUCKET, summed=True)
    b = banded.join(hot, bucket, "left")
    b = b.withColumn("b", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("uid"), F.col("parts"))).cast("int"))
    b = b.withColumn("x", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    cells = b.select(*bucket, F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"), "b", "uid", "code", "f", "unit", "q")
    hopeful = stored(_hopeful(cells, threshold, width, bands), "hopeful").join(coded.select("uid", "rep", "copies", "v"), "uid")
    found = stored(_links(hopeful, threshold, width, bands), "links")
    nodes = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "component")
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    per_class = coded.select(*same, "uid", "rep", "copies").join(links, "uid", "left").join(nodes, "rep", "left")
    per_class = stored(per_class.select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "per_class", size)
    known = units.select("vec_id", *same).join(per_class, same).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(known, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
