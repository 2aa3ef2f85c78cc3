"""Linear rankers: logistic regression and squared-hinge SVM with grid search, ablation, TF-IDF vectors and SVD."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import drop, written
from .analytics import index_of
from .gradients import PIECES, pieces, tree
from .newton import Fit, areas, decisions, newton
from .ranking import FEATURES

# The grid of inverse regularisation strengths.
GRID = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
DIRECTIONS = 512
BLOCK_TERMS = 1024


@dataclass
class LinearRanker:
    """A linear score over standardised features."""

    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    logistic: bool
    c: float
    auc: float

    def decision(self) -> Column:
        parts = [(F.col(f) - float(m)) / float(s) * float(w) for f, m, s, w in zip(self.features, self.mean, self.scale, self.weight)]
        return sum(parts[1:], parts[0]) + float(self.bias)

    def score(self) -> Column:
        """A probability for the logistic model, the decision value for the SVM."""
        return 1 / (1 + F.exp(-self.decision())) if self.logistic else self.decision()

    def rank(self, pairs: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, score) of the k best documents of each query."""
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
        s = pairs.select("query_id", "doc_id", self.score().alias("score"))
        return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def folds(df: DataFrame, label: str = "label", n: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold, dealt evenly inside each label in the order of a hash, by positions over all tasks (index_of)."""
    keys = F.struct(F.col(label).alias("s"), F.xxhash64(F.lit(seed), "query_id", "doc_id").alias("h"), "query_id", "doc_id")
    ordered = index_of(df.select(keys.alias("k")), "k").select("k.s", "k.query_id", "k.doc_id", "idx")
    first = ordered.groupBy("s").agg(F.min("idx").alias("first"))
    dealt = ordered.join(F.broadcast(first), "s").select(F.col("s").alias(label), "query_id", "doc_id", F.pmod(F.col("idx") - F.col("first"), F.lit(n)).cast("int").alias("fold"))  # a row a label
    return df.join(dealt, [label, "query_id", "doc_id"])


def _moments(df: DataFrame, features: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    r = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(features)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features))).first()
    mean = np.array([r[f"m{i}"] or 0.0 for i in range(len(features))])
    scale = np.array([r[f"s{i}"] or 0.0 for i in range(len(features))])
    return mean, np.where(scale > 1e-12, scale, 1.0)


def _prepared(df: DataFrame, features: tuple[str, ...], mean: np.ndarray, scale: np.ndarray, cv: int, label: str) -> DataFrame:
    """(label, fold, standardised features), stored: every scan reads it. A missing feature counts as its mean."""
    z = [F.coalesce((F.col(f) - float(m)) / float(s), F.lit(0.0)).alias(f"x{i}") for i, (f, m, s) in enumerate(zip(features, mean, scale, strict=True))]
    d = df.withColumn("label", F.col(label).cast("int")).where("label is not null")
    d = folds(d, n=cv) if cv > 1 else d.withColumn("fold", F.lit(0))
    return written(d.select("label", "fold", *z), "pairs")


def _fit(df: DataFrame, features: tuple[str, ...], grid: tuple[float, ...], cv: int, label: str, logistic: bool) -> LinearRanker:
    """Grid search by the mean AUC over cv folds, all of the grid's models, held-out and whole, fitted in the same scans."""
    mean, scale = _moments(df, features)
    search = cv > 1 and len(grid) > 1
    rows = _prepared(df, features, mean, scale, cv if search else 1, label)
    held = [Fit(c, len(features), f) for c in grid for f in range(cv)] if search else []
    whole = [Fit(c, len(features)) for c in (grid if search else grid[:1])]
    w = newton(rows, held + whole, logistic)
    best, auc = 0, 0.0
    if search:
        area = areas(decisions(rows, w[: len(held)], held, True))
        means = [float(np.mean([area.get(i * cv + f, 0.5) for f in range(cv)])) for i in range(len(grid))]
        best = int(np.argmax(means))
        auc = means[best]
    final = w[len(held) + best]
    drop(rows)
    return LinearRanker(features, mean, scale, final[:-1], float(final[-1]), logistic, grid[best], auc)


def fit_logistic(df: DataFrame, features: tuple[str, ...] = FEATURES, grid: tuple[float, ...] = GRID, cv: int = 5, label: str = "label") -> LinearRanker:
    """Logistic regression: C times the losses against half the squared weights."""
    return _fit(df, features, grid, cv, label, True)


def fit_svm(df: DataFrame, features: tuple[str, ...] = FEATURES, grid: tuple[float, ...] = GRID, cv: int = 5, label: str = "label") -> LinearRanker:
    """Squared-hinge linear SVM."""
    return _fit(df, features, grid, cv, label, False)


def ablation(df: DataFrame, features: tuple[str, ...] = FEATURES, c: float = 1.0, label: str = "label") -> DataFrame:
    """(n_features, last_feature, train_accuracy) of SVMs on growing prefixes of the features, fitted in the same scans."""
    mean, scale = _moments(df, features)
    rows = _prepared(df, features, mean, scale, 1, label)
    fits = [Fit(c, n) for n in range(1, len(features) + 1)]
    d = decisions(rows, newton(rows, fits, False), fits, False)
    right = {r["model"]: r["a"] for r in d.groupBy("model").agg(F.avg(((F.col("raw") > 0).cast("int") == F.col("label")).cast("double")).alias("a")).collect()}
    drop(rows)
    return df.sparkSession.createDataFrame([(n, features[n - 1], float(right.get(n - 1, 0.0))) for n in range(1, len(features) + 1)], "n_features int, last_feature string, train_accuracy double")


def tfidf_vectors(weights: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc_id, i, w) of retrieval.tfidf rows, positions of terms and their weights, and the terms in that order (at most max_features)."""
    terms = [r["term"] for r in weights.select("term").distinct().orderBy("term").collect()]
    at = F.broadcast(weights.sparkSession.createDataFrame(list(enumerate(terms)), "i int, term string"))
    v = weights.join(at, "term").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", F.col("weight").alias("w")))).alias("x"))
    return v.select("doc_id", "x.i", "x.w"), terms


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and weights of each row of a batch (.., i, w)."""
    i, w = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    at, i, w = i.offsets.to_numpy(), i.values.to_numpy(), w.values.to_numpy()
    return ((i[a:b], w[a:b]) for a, b in zip(at[:-1], at[1:], strict=True))


def truncated_svd(vectors: DataFrame, terms: int, k: int = DIRECTIONS, passes: int = 5, seed: int = 42) -> tuple[DataFrame, float]:
    """(doc_id, features array) of the first k singular directions of sparse vectors (doc_id, i, w) over terms positions (fewer
    directions where the rank is smaller), and the share of variance they explain.

    Subspace iteration from a random start: each pass is one scan in Arrow batches; each partition gives its part of the matrix
    of terms x (k + 10) in blocks of BLOCK_TERMS terms, which are added as a tree.
    """
    sc = vectors.sparkSession.sparkContext

    def times(q: np.ndarray) -> np.ndarray:
        held = sc.broadcast(q)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z = np.zeros(held.value.shape)
            for batch in batches:
                for i, w in _rows(batch):
                    z[i] += w[:, None] * (w @ held.value[i])
            yield pieces(z.ravel(), BLOCK_TERMS * z.shape[1])

        total = tree(rows.mapInArrow(add, PIECES), rows.rdd.getNumPartitions())
        return np.zeros_like(q) if total is None else total.reshape(q.shape)  # the matrix itself, once

    rows = vectors.select("i", "w").coalesce(sc.defaultParallelism)  # a matrix a core is shuffled, not a partition
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, min(k + 10, terms))))[0]
    for _ in range(passes):
        q = np.linalg.qr(times(q))[0]
    size, turn = np.linalg.eigh(q.T @ times(q))
    best = [j for j in np.argsort(-size)[:k] if size[j] > 1e-12 * size.max()]
    v = q @ turn[:, best]
    held = sc.broadcast(v)  # terms x k

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [w @ held.value[i] for i, w in _rows(batch)]
            flat = np.concatenate(x) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * v.shape[1], pa.int32()), pa.array(flat))], ["doc_id", "features"])

    kind = vectors.schema["doc_id"].dataType.simpleString()
    out = vectors.select("doc_id", "i", "w").mapInArrow(project, f"doc_id {kind}, features array<double>")
    total = vectors.select(F.explode(F.arrays_zip("i", "w")).alias("s")).groupBy("s.i").agg(F.sum("s.w").alias("s"), F.sum(F.col("s.w") * F.col("s.w")).alias("q")).toArrow()  # a row a term
    n = max(1, vectors.count())
    mean = np.zeros(terms)
    mean[total["i"].to_numpy()] = total["s"].to_numpy() / n
    var = float(total["q"].to_numpy().sum() / n - (mean * mean).sum())
    kept = float(size[best].sum() / n - ((mean @ v) ** 2).sum())  # a direction's sum of squares is its eigenvalue: the features need not be made for it
    return out, float(kept / var) if var else 0.0
