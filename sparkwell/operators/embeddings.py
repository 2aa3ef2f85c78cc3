"""Embedding operators: structured encoding, exact search, contrastive loss and alignment, forward passes of encoders."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..sources.bridge import ICD_CODES
from ..sources.shared import bounded_batches, drop, written

# The lab and biomarker vocabularies, in the order of the vector's components.
LABS = ("creatinine", "ALT", "AST", "bilirubin", "albumin", "hemoglobin", "platelet_count", "neutrophil_count", "TSH", "free_T4", "troponin", "BNP", "LDH", "CEA", "CA-125", "PSA", "AFP")
MARKERS = ("PD-L1", "EGFR", "ALK", "KRAS", "BRAF_V600E", "HER2", "BRCA1/2", "MSI-H", "TMB", "NTRK", "ROS1", "MET", "RET", "PIK3CA", "TP53", "IDH1", "FGFR", "CDK4", "BCL-2", "BTK")
LAB_SCALE, MARKER_SCALE = 15.0, 100.0
ICD_DIM, WIDTH, IMAGE_WIDTH, IMAGE_HIDDEN, TEXT_WIDTH = 16, 128, 2048, 512, 768
TEMPERATURE = 0.07
#: Words whose hashes a task remembers.
WORDS = 1 << 18


# ------------------------------------------------------------------ structured metadata


def icd_indices(codes: Column) -> Column:
    """1-based vocabulary positions of trimmed codes; 0 for unknown ones. Duplicates stay."""
    vocabulary = F.array(*map(F.lit, ICD_CODES))
    return F.transform(codes, lambda c: F.coalesce(F.array_position(vocabulary, F.trim(c)), F.lit(0)).cast("int"))


def icd_table(dim: int = ICD_DIM, seed: int = 1) -> np.ndarray:
    """A seeded embedding table, one row per code."""
    return np.random.default_rng(seed).standard_normal((len(ICD_CODES), dim)).round(4)


def pooled_codes(indices: Column, table: np.ndarray) -> Column:
    """The mean embedding of the known codes; zeros without any. The table is a constant of the plan (26 rows)."""
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in table))
    known = F.filter(indices, lambda i: i > 0)
    zero = F.array_repeat(F.lit(0.0), table.shape[1])
    total = F.aggregate(known, zero, lambda s, i: F.zip_with(s, F.element_at(rows, i), lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.greatest(F.size(known), F.lit(1)))


def _by_name(values: Column, names: tuple[str, ...], scale: float, ignore_case: bool) -> Column:
    """One component per name: the first entry whose key matches (underscores as spaces), over scale; else 0."""
    norm = (lambda c: F.lower(F.replace(c, F.lit("_"), F.lit(" ")))) if ignore_case else (lambda c: F.replace(c, F.lit("_"), F.lit(" ")))
    entries = F.transform(F.map_entries(values), lambda e: F.struct(norm(e["key"]).alias("k"), e["value"].cast("double").alias("v")))

    def one(name: str) -> Column:
        want = name.replace("_", " ")
        want = want.lower() if ignore_case else want
        return F.coalesce(F.get(F.filter(entries, lambda e: e["k"] == want), F.lit(0))["v"] / scale, F.lit(0.0))

    return F.array(*map(one, names))


def lab_vector(values: Column) -> Column:
    return _by_name(values, LABS, LAB_SCALE, True)


def marker_vector(values: Column) -> Column:
    return _by_name(values, MARKERS, MARKER_SCALE, False)


def structured_input(codes: Column, labs: Column, markers: Column, table: np.ndarray | None = None) -> Column:
    """The 53 inputs of the structured encoder: pooled codes, labs, markers."""
    return F.concat(pooled_codes(icd_indices(codes), icd_table() if table is None else table), lab_vector(labs), marker_vector(markers))


# ------------------------------------------------------------------ encoders (numpy forward passes)


@dataclass
class Dense:
    """Layers of (weight, bias); ReLU between them; unit length at the end unless normalize is off. A batch norm at inference is folded into its layer."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    normalize: bool = True
    frozen: int = field(default=0)  # of the first layers

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if i < len(self.layers) - 1:
                x = np.maximum(x, 0)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if self.normalize else x

    def parameters(self) -> dict[str, int]:
        """Trainable and frozen parameter counts."""
        n = [w.size + b.size for w, b in self.layers]
        return {"trainable": sum(n[self.frozen :]), "frozen": sum(n[: self.frozen])}


def random_dense(*widths: int, seed: int = 0, normalize: bool = True) -> Dense:
    rng = np.random.default_rng(seed)
    return Dense([(rng.standard_normal((a, b)) * np.sqrt(2 / a), np.zeros(b)) for a, b in zip(widths, widths[1:])], normalize)


def structured_encoder(seed: int = 0) -> Dense:
    return random_dense(ICD_DIM + len(LABS) + len(MARKERS), WIDTH, WIDTH, seed=seed)


def folded(w: np.ndarray, b: np.ndarray, gamma: np.ndarray, beta: np.ndarray, mean: np.ndarray, var: np.ndarray, eps: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """A layer followed by a batch norm with fixed statistics, as one layer."""
    g = gamma / np.sqrt(var + eps)
    return w * g, (b - mean) * g + beta


def image_encoder(seed: int = 0) -> Dense:
    return random_dense(IMAGE_WIDTH, IMAGE_HIDDEN, WIDTH, seed=seed)


def early_fusion(text: int = 512, image: int = IMAGE_WIDTH, structured: int = 53, seed: int = 0) -> Dense:
    """The single network over concatenated raw features, kept for comparison."""
    return random_dense(text + image + structured, 512, WIDTH, seed=seed)


def encode(df: DataFrame, column: str, model: Dense, out: str = "vec", batch: int = 256) -> DataFrame:
    """Adds model(column) for array columns, batch rows at a time; null input gives null."""
    bounded_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)  # a fixed-size network

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            for a in range(0, len(s), batch):  # given back at once: a batch of ids or texts may be far smaller than its vectors
                x = s.iloc[a : a + batch].tolist()
                got: list = [None] * len(x)
                rows = [i for i, v in enumerate(x) if v is not None]
                if rows:
                    for i, v in zip(rows, held.value(np.stack([np.asarray(x[i], float) for i in rows]))):
                        got[i] = v
                yield pd.Series(got, dtype=object)

    return df.withColumn(out, run(F.col(column)))


def hashed_text_features(text: Column, width: int = TEXT_WIDTH) -> Column:
    """A deterministic stand-in for a language model's text features: signed counts of hashed tokens."""
    t = S.tokens(text)
    at = F.transform(t, lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int"))
    sign = F.transform(t, lambda w: F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    pairs = F.zip_with(at, sign, lambda a, s: F.struct(a.alias("a"), s.alias("s")))
    summed = F.aggregate(pairs, F.create_map().cast("map<int,double>"), lambda m, p: F.map_zip_with(m, F.map_from_arrays(F.array(p["a"]), F.array(p["s"])), lambda k, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at(summed, i), F.lit(0.0)))


class Places(dict):
    """The component of a word; those of words that count down lie behind all others."""

    def __init__(self, width: int = TEXT_WIDTH) -> None:
        self.width = width

    def __missing__(self, w: str) -> int:
        import xxhash

        if len(self) >= WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(w)
        self[w] = at = h % self.width + (0 if h >> 63 else self.width)
        return at


def hashed_counts(texts, places: Places, max_tokens: int | None = None) -> np.ndarray:
    """Signed counts of the hashed tokens of each text."""
    import re

    width = places.width
    x = np.zeros((len(texts), width))
    for i, t in enumerate(texts):
        words = re.findall("[a-z0-9]+", (t or "").lower())[:max_tokens]
        n = np.bincount(np.fromiter(map(places.__getitem__, words), np.int64, len(words)), minlength=2 * width)
        x[i] = n[:width] - n[width:]
    return x


def encode_texts(df: DataFrame, text: str, model: Dense | None = None, width: int = TEXT_WIDTH, max_tokens: int | None = None, out: str = "vec", batch: int = 32) -> DataFrame:
    """Text to unit vectors by hashed token features and a projection, in Arrow batches. max_tokens: only so many first tokens, as a model with a window reads."""
    bounded_batches(df.sparkSession)
    model = model or random_dense(width, WIDTH, seed=7)
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places = Places(width)
        for s in parts:
            for a in range(0, len(s), batch):
                x = hashed_counts(s.iloc[a : a + batch], places, max_tokens)
                yield pd.Series(list(held.value(x)), dtype=object)

    return df.withColumn(out, run(F.col(text)))


# ------------------------------------------------------------------ contrastive loss and alignment


def _batches(pairs: DataFrame, batch: int | None) -> DataFrame:
    """pairs (i, anchor, positive) with the batch number and normalised vectors."""
    b = F.floor(F.col("i") / batch).cast("long") if batch else F.lit(0).cast("long")
    return pairs.select("i", b.alias("batch"), S.l2_normalized(F.col("anchor")).alias("a"), S.l2_normalized(F.col("positive")).alias("p"))


def similarities(pairs: DataFrame, batch: int | None = 64) -> DataFrame:
    """(batch, i, j, sim) of every anchor with every positive of its batch; batches bound the pairs."""
    p = _batches(pairs, batch)
    return p.select("batch", "i", "a").join(p.select("batch", F.col("i").alias("j"), "p"), "batch").select("batch", "i", "j", S.dot(F.col("a"), F.col("p")).alias("sim"))


def info_nce(pairs: DataFrame, temperature: float = TEMPERATURE, batch: int = 64) -> DataFrame:
    """(batch, n, loss): mean cross-entropy of similarity / temperature against the own positive, anchor to positive."""
    s = similarities(pairs, batch).withColumn("z", F.col("sim") / temperature)
    top = F.max("z").over(Window.partitionBy("batch", "i"))
    s = s.withColumn("m", top)
    g = s.groupBy("batch", "i").agg((F.first("m") + F.log(F.sum(F.exp(F.col("z") - F.col("m")))) - F.sum(F.when(F.col("i") == F.col("j"), F.col("z")))).alias("l"))
    return g.groupBy("batch").agg(F.count("*").alias("n"), F.avg("l").alias("loss"))


def alignment(pairs: DataFrame, batch: int | None = None) -> DataFrame:
    """One row: mean similarity of matching and of other pairs, and how often the own positive is the best (ties to the smaller j).

    The means need only the sums of all anchors and of all positives, by component; the best positives are a search for
    one neighbour, in tiles. With a batch, each batch is compared within itself.
    """
    if batch is not None:
        s = similarities(pairs, batch)
        per = s.groupBy("batch", "i").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("sim"))).alias("own"), F.sum(F.when(F.col("i") != F.col("j"), F.col("sim"))).alias("rest"), (F.count("*") - 1).alias("others"), F.max_by("j", F.struct("sim", -F.col("j"))).alias("best"))
        return per.agg(F.count("*").alias("n"), F.avg("own").alias("positive_sim"), (F.sum("rest") / F.when(F.sum("others") > 0, F.sum("others"))).alias("negative_sim"), F.avg((F.col("best") == F.col("i")).cast("double")).alias("top1_accuracy"))
    p = _batches(pairs, None)
    own = p.agg(F.count("*").alias("n"), F.sum(S.dot(F.col("a"), F.col("p"))).alias("own"))
    sums = p.select(F.posexplode(F.arrays_zip("a", "p")).alias("at", "x")).groupBy("at").agg(F.sum("x.a").alias("a"), F.sum("x.p").alias("p"))
    every = sums.agg(F.sum(F.col("a") * F.col("p")).alias("every"))
    best = _tiled(p.select("i", "p"), p.select("i", "a"), 1, "i", "p", None, True, asked="a")
    right = best.agg(F.count("*").alias("found"), F.avg((F.col("vec_id") == F.col("query_id")).cast("double")).alias("top1_accuracy"))
    one = own.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(right))  # a row each
    others = F.col("n") * (F.col("n") - 1)
    return one.select("n", (F.col("own") / F.col("n")).alias("positive_sim"), ((F.col("every") - F.col("own")) / F.when(others > 0, others)).alias("negative_sim"), "top1_accuracy")


# ------------------------------------------------------------------ search


#: Queries and vectors of one matrix product, queries that are broadcast or held by a task, and vectors of a grid's column.
TILE_ROWS, VECTOR_ROWS, HELD_QUERIES, SHARD_ROWS = 4096, 1024, 32_768, 1 << 20


def flat_search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, rank, vec_id, score): exact cosine search; ties of the rounded score go to the smaller id.

    Up to HELD_QUERIES queries are broadcast and the vectors stay where they are. More are dealt over a grid of tiles of
    queries by shards of vectors, both shuffled. A task runs matrix products with partial selection and keeps the k best
    of each of its queries.
    """
    return _tiled(vectors, queries, k, id_col, vector, digits)


class _Lists:
    """The k best vectors so far for each of the unit queries q; product scores rows of what prepare made of q."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int, digits: int | None, own: bool, blocks, prepare=None, product=None) -> None:
        self.qid, self.q, self.k, self.digits, self.own = qid, prepare(q) if prepare else q, k, digits, own
        self.product = product or (lambda held, rows, v: held[rows] @ v.T)
        self.blocks = blocks(q) if blocks else lambda v: [(np.arange(len(q)), np.arange(len(v)))]
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        got = [(self.row, self.id, self.score)]
        for rows, cols in self.blocks(v):
            for a in range(0, len(rows), TILE_ROWS):
                r = rows[a : a + TILE_ROWS]
                s = self.product(self.q, r, v[cols])
                s = s if self.digits is None else np.round(s, self.digits) + 0.0
                if not self.own:
                    s[self.qid[r][:, None] == ids[cols][None]] = -np.inf
                ok = np.isfinite(s)
                if s.shape[1] > self.k and np.count_nonzero(ok) > 4 * self.k * len(r):
                    ok &= s >= np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k, None]
                i, j = np.nonzero(ok)
                got.append((r[i], ids[cols[j]], s[i, j]))
        row, ids, s = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((ids, -s, row))
        row, ids, s = row[order], ids[order], s[order]
        stay = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        self.row, self.id, self.score = row[stay], ids[stay], s[stay]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.qid[self.row], "vec_id": self.id, "score": self.score})


def wide_enough(search, vectors: DataFrame, width: int, goal: float = 0.95, probes: int = 100, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> int:
    """The width, doubled as often as needed, at which search(queries, width) finds the goal's share of the exact neighbours.

    It is measured with at most probes of the vectors as queries (chosen by a hash of their ids) against all vectors.
    """
    v = vectors.where(F.col(vector).isNotNull())
    n = v.count()
    asked = written(v.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(probes), "probes")
    exact = written(flat_search(v, asked, id_col=id_col, vector=vector).select("query_id", "vec_id"), "exact")
    while width < n:
        found = search(asked, width).select("query_id", "vec_id").withColumn("found", F.lit(1))
        r = exact.join(found, ["query_id", "vec_id"], "left").agg(F.count("found").alias("found"), F.count("*").alias("n")).first()
        if r["found"] >= goal * r["n"]:
            break
        width *= 2
    drop(asked)
    drop(exact)
    return width


def _cells(vectors: DataFrame, queries: DataFrame, n: int, most: int) -> DataFrame:
    """(tile, shard, asked, id, v, w) of n queries (id, v; asked 0) and vectors (id, v as w; asked 1), dealt and sorted by cell.

    A cell has at most about most queries and SHARD_ROWS vectors; there are several for each core.
    """
    spark = vectors.sparkSession
    tiles = max(1, -(-n // most))
    shards = max(1, -(-vectors.count() // SHARD_ROWS), -(-4 * spark.sparkContext.defaultParallelism // tiles))
    place = F.monotonically_increasing_id()
    q = queries.withColumn("tile", F.pmod(place, F.lit(tiles))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    v = vectors.withColumn("shard", F.pmod(place, F.lit(shards))).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    q = q.withColumn("w", F.lit(None).cast(vectors.schema["v"].dataType))
    v = v.withColumnRenamed("v", "w").withColumn("v", F.lit(None).cast(queries.schema["v"].dataType))
    both = q.withColumn("asked", F.lit(0)).unionByName(v.withColumn("asked", F.lit(1)))
    dealt = both.repartition(2 * tiles * shards, "tile", "shard").sortWithinPartitions("tile", "shard", "asked")
    return dealt.select("tile", "shard", "asked", "id", "v", "w")


def _cells_of(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, Iterator[pd.DataFrame]]]:
    """Of a task of _cells: each cell's queries, and its vectors as they come. Cells without queries or vectors are left out."""
    runs = ((key, asked, rows) for df in parts for (*key, asked), rows in df.groupby(["tile", "shard", "asked"], sort=True))
    for _, cell in itertools.groupby(runs, key=lambda r: r[0]):
        waiting = []
        for _, asked, rows in cell:
            if asked:
                if waiting:
                    yield pd.concat(waiting), itertools.chain([rows], (r for _, _, r in cell))
                break
            waiting.append(rows)


def _tiled(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str, digits: int | None, own: bool = False, blocks=None, asked: str | None = None, held: int | None = None, rows=None, prepare=None, product=None, ask=None) -> DataFrame:
    """The k best unit vectors of each unit query; own: also of the query's own id.

    blocks, made for a task's queries, gives for a tile of vectors the rows of queries and vectors that are compared. rows
    reads the vectors' column, where it holds something else, and ask the queries'; prepare and product say how they are
    scored, held how many queries a task holds.
    """
    spark = vectors.sparkSession
    queries = queries.select(F.col(id_col).cast("long").alias("id"), F.col(asked or vector).alias("v")).where("v is not null")
    vectors = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where("v is not null")
    n, shape = queries.count(), "query_id long, vec_id long, score double"
    matrix = lambda col: _unit(np.stack(col.to_numpy()).astype(float))
    read, ask, most = rows or matrix, ask or matrix, held or HELD_QUERIES

    def scan(lists: _Lists, df: pd.DataFrame) -> None:
        for a in range(0, len(df), VECTOR_ROWS):
            lists.add(df["id"].to_numpy()[a : a + VECTOR_ROWS], read(df["v"].iloc[a : a + VECTOR_ROWS]))

    if n <= most:
        all_ = queries.toPandas()
        if all_.empty:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        sent = spark.sparkContext.broadcast((all_["id"].to_numpy(), ask(all_["v"])))

        def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lists = _Lists(*sent.value, k, digits, own, blocks, prepare, product)
            for df in parts:
                scan(lists, df)
            yield lists.frame()

        found = vectors.mapInPandas(whole, shape)
    else:
        dealt = _cells(vectors, queries, n, most)

        def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for every, scans in _cells_of(parts):
                lists = _Lists(every["id"].to_numpy(), ask(every["v"]), k, digits, own, blocks, prepare, product)
                for rows in scans:
                    scan(lists, rows.assign(v=rows["w"]))
                yield lists.frame()

        found = dealt.mapInPandas(cells, shape)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Cells:
    """An inverted-file index: centroids and the vectors with their cells."""

    centroids: np.ndarray
    vectors: DataFrame  # id, vector, cell


def build_cells(vectors: DataFrame, cells: int = 16, sample: int = 20_000, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> Cells:
    """K-means centroids fitted on at most sample rows (by hash); every row is indexed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.where(F.col(vector).isNotNull()).withColumn("u", S.l2_normalized(F.col(vector)))
    fit = v.orderBy(F.xxhash64(F.lit(seed), id_col)).limit(sample).select(array_to_vector("u").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(fit)
    out = model.transform(v.withColumn("features", array_to_vector("u"))).withColumnRenamed("prediction", "cell").drop("features", "u")
    return Cells(np.array(model.clusterCenters()), out)


def cell_search(index: Cells, queries: DataFrame, k: int = 10, probes: int = 4, id_col: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, rank, vec_id, score): approximate cosine search in each query's probes nearest cells.

    A tile of vectors is cut by cell, and each cell is one matrix product with the queries that probe it; no cell is shuffled.
    """
    centroids = index.centroids

    def near_cells(x: np.ndarray, n: int) -> np.ndarray:
        far = (centroids * centroids).sum(axis=1)[None] - 2 * x @ centroids.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]

    def blocks(q: np.ndarray):
        asked = near_cells(q, probes)

        def near(v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            cell = near_cells(v, 1)[:, 0]
            for c in np.unique(cell):
                rows = np.flatnonzero((asked == c).any(axis=1))
                if len(rows):
                    yield rows, np.flatnonzero(cell == c)

        return near

    return _tiled(index.vectors, queries, k, id_col, vector, digits, blocks=blocks)


def hash_search(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = 4, width: float = 1.0, id_col: str = "vec_id", vector: str = "embedding", digits: int = 6, seed: int = 42) -> DataFrame:
    """(query_id, rank, vec_id, score): approximate cosine search among the vectors that share a bucket with the query.

    Each table's buckets are the projections of unit vectors on one random unit vector, in steps of width. Queries of
    equal buckets share their candidates, so each such group is one matrix product with its candidates in a tile; no
    bucket is shuffled, however full it is.
    """

    def codes(x: np.ndarray) -> np.ndarray:
        return np.floor(x @ _unit(np.random.default_rng(seed).standard_normal((tables, x.shape[1]))).T / width).astype(np.int64)

    def blocks(q: np.ndarray):
        buckets, group = np.unique(codes(q), axis=0, return_inverse=True)
        members = [np.flatnonzero(group.ravel() == g) for g in range(len(buckets))]

        def near(v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            at = codes(v)
            for b, rows in zip(buckets, members, strict=True):
                cols = np.flatnonzero((at == b).any(axis=1))
                if len(cols):
                    yield rows, cols

        return near

    return _tiled(vectors, queries, k, id_col, vector, digits, blocks=blocks)


def projected(df: DataFrame, column: str = "embedding", k: int = 2) -> DataFrame:
    """Adds pca, the first k principal components, for plots."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = df.withColumn("__v", array_to_vector(F.transform(F.col(column), lambda x: x.cast("double"))))
    return PCA(k=k, inputCol="__v", outputCol="__p").fit(d).transform(d).withColumn("pca", vector_to_array("__p")).drop("__v", "__p")


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, anchor, positive): vectors 2i and 2i + 1."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    half = F.floor(F.col("vec_id") / 2).cast("long")
    return v.where("vec_id % 2 = 0").select(half.alias("i"), F.col("embedding").alias("anchor")).join(v.where("vec_id % 2 = 1").select(half.alias("i"), F.col("embedding").alias("positive")), "i")
