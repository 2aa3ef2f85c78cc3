"""Quality classification by hierarchical empirical Bayes.

1. Evidence: a logistic classifier on FEATURES of the whole text (shares of character kinds, repeated lines, distinct
   words and the like), fitted in numpy on at most MOST_LABELLED labelled documents (the bound; chosen by a hash of the
   doc_id). Each document gets p, the classifier's probability of good quality.
2. Sites: hosts and the paths under them. Grouped sums of p over all documents give each site's mean, its variance
   between sites, and from that by moments the strength of the prior: host means shrink toward the global mean and
   path means toward their host's posterior, the sparser the more. A hot host is summed before the shuffle.
3. Posterior: logit(p) + logit(path posterior) - logit(global mean); a document is kept at THRESHOLD or more.

Defined results: null or blank text scores 0 and is not kept, nor counted for its site; a null host or path is a site of
its own; labels that are null are ignored and a document with several has their mean's class; where the labels hold one
class or none, p is the labelled share of good (1 without labels); a null doc_id is scored; repeated rows are scored each;
columns named like the results are replaced; empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop_stored, stored, text_chunks, words_of

MOST_LABELLED = 20_000
MOST_SITES, HOT_SITES = 200_000, 10_000
THRESHOLD = 0.5
RIDGE = 1.0
STRONGEST = 1e6
OWN = ("evidence", "host_posterior", "path_posterior", "quality", "kept")

FEATURES = ("upper", "lower", "digit", "space", "stop", "bang", "bar", "symbol", "other_mark", "high", "log_size", "word_size", "distinct_words", "repeated_lines", "line_size", "marked_words")

# Kinds of bytes, in the order of the first ten features.
_KIND = np.full(256, 8, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[[32, 9, 10, 11, 12, 13]] = 0, 1, 2, 3
_KIND[[ord(c) for c in ".,;:'\"-()"]] = 4
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[[ord(c) for c in "|<>{}[]\\/"]] = 6
_KIND[[ord(c) for c in "#$%&*+=@^_~`"]] = 7
_KIND[128:] = 9
_KINDS = 10


def features(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row ranges with their feature rows; a blank text's are all 0 but for its size."""
    for i, j, data, off in text_chunks(col):
        rows = j - i
        size = np.diff(off)
        out = np.zeros((rows, len(FEATURES)))
        doc = np.repeat(np.arange(rows), size)
        out[:, :_KINDS] = np.bincount(doc * _KINDS + _KIND[data], minlength=rows * _KINDS).reshape(rows, _KINDS) / np.maximum(1, size)[:, None]
        out[:, 10] = np.log1p(size)
        s, e, h, first = words_of(data, off)
        count = np.diff(first)
        letters = np.concatenate([[0], np.cumsum(e - s)])
        out[:, 11] = np.minimum(50, (letters[first[1:]] - letters[first[:-1]]) / np.maximum(1, count)) / 10
        marked = np.concatenate([[0], np.cumsum((_KIND[data[e - 1]] >= 5) & (_KIND[data[e - 1]] <= 8))]) if len(s) else np.zeros(1, np.int64)
        out[:, 15] = (marked[first[1:]] - marked[first[:-1]]) / np.maximum(1, count)
        raw = data.tobytes()
        for r in range(rows):
            if count[r]:
                out[r, 12] = len(np.unique(h[first[r] : first[r + 1]])) / count[r]
                lines = raw[off[r] : off[r + 1]].split(b"\n")
                out[r, 13] = 1 - len(set(lines)) / len(lines)
                out[r, 14] = np.log1p(size[r] / len(lines))
        yield i, j, out


@dataclass
class Classifier:
    """Standardised logistic regression."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weight + self.bias, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Classifier:
    """Newton steps on the ridge-penalised likelihood; constant where y has one class or none."""
    k = len(FEATURES)
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6)
        return Classifier(np.zeros(k), np.ones(k), np.zeros(k), float(np.log(p / (1 - p))))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.column_stack([np.clip((x - mean) / scale, -20, 20), np.ones(len(x))])
    w = np.zeros(k + 1)
    penalty = np.append(np.full(k, RIDGE), 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean, scale, w[:-1], float(w[-1]))


def _clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))


def _logit(p: Column) -> Column:
    return F.log(_clip(p) / (1 - _clip(p)))


def _site(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string")))


def _strength(sites: DataFrame, prior: Column) -> float:
    """Prior strength by moments: how much site means vary around their prior beyond what sampling explains."""
    d = sites.select("n", prior.alias("m"), (F.col("s") / F.col("n")).alias("mean"))
    r = d.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("mean") - F.col("m"), 2)).alias("v"), F.sum(F.col("m") * (1 - F.col("m"))).alias("q"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("qn")).first()
    if not r["n"] or not r["qn"]:
        return STRONGEST
    between = (r["v"] - r["q"]) / r["n"]
    spread = r["qn"] / r["n"]
    return STRONGEST if between <= spread / STRONGEST else min(STRONGEST, max(1.0, spread / between - 1))


@dataclass
class QualityModel:
    classifier: Classifier
    mean: float
    host_strength: float
    path_strength: float
    sites: DataFrame  # (host, path, n, host_posterior, path_posterior)
    n_sites: int


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of at most MOST_LABELLED documents, those of the smallest hashes among labelled ids that occur.

    Of several rows of one id the one with the smallest features counts.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    ids = known.join(d.select("id").distinct(), "id").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "id").limit(MOST_LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, x in features(b.column(1)):
                worded = np.flatnonzero(x[:, 11] > 0)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(worded) + 1) * len(FEATURES), pa.int32()), pa.array(x[worded].ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i).take(pa.array(worded)) for c in (0, 2)), rows], ["id", "y", "x"])

    ids = stored(ids, "labelled", MOST_LABELLED)
    rows = d.join(F.broadcast(ids), "id").select("id", "text", "y").mapInArrow(run, "id long, y int, x array<double>")  # MOST_LABELLED ids
    sample = sorted(rows.groupBy("id").agg(F.min(F.struct("x", "y")).alias("r")).select("id", "r.x", "r.y").collect())  # MOST_LABELLED rows at most
    drop_stored(ids)
    return np.array([r["x"] for r in sample]).reshape(len(sample), len(FEATURES)), np.array([r["y"] for r in sample], float)


def evidence(spark: SparkSession, docs: DataFrame, classifier: Classifier, host: Column | str, path: Column | str, keep: list[str], text: str = "text") -> DataFrame:
    """docs' columns named in keep, with __host, __path and evidence (0 for texts without a word)."""
    bounded_batches(spark)
    own = [c for c in keep if c not in OWN]
    d = docs.select(F.col(text).alias("__text"), _site(host).alias("__host"), _site(path).alias("__path"), *own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [np.where(x[:, 11] > 0, classifier.probability(x), 0.0) for _, _, x in features(b.column(0))]
            if p:
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.concatenate(p))], ["__host", "__path", *own, "evidence"])

    return d.mapInArrow(run, d.drop("__text").schema.add("evidence", "double"))


def site_model(scored: DataFrame, classifier: Classifier) -> QualityModel:
    """Posteriors of all sites from the documents' evidence."""
    paths = scored.where("evidence > 0").groupBy(F.col("__host").alias("host"), F.col("__path").alias("path")).agg(F.count("*").alias("n"), F.sum("evidence").alias("s"))
    paths = stored(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    g = paths.agg((F.sum("s") / F.sum("n")).alias("mean"), F.count("*").alias("sites")).first()
    mean = 0.5 if g["mean"] is None else float(g["mean"])
    host_strength = _strength(hosts, F.lit(mean))
    hosts = hosts.select("host", ((F.col("s") + host_strength * mean) / (F.col("n") + host_strength)).alias("host_posterior"))
    both = paths.join(hosts, "host")
    path_strength = _strength(both, F.col("host_posterior"))
    sites = both.select("host", "path", "n", "host_posterior", ((F.col("s") + path_strength * F.col("host_posterior")) / (F.col("n") + path_strength)).alias("path_posterior"))
    sites = stored(sites, "sites", g["sites"])
    drop_stored(paths)
    return QualityModel(classifier, mean, host_strength, path_strength, sites, g["sites"])


def posterior(scored: DataFrame, model: QualityModel) -> DataFrame:
    """Adds the sites' posteriors, quality and kept to rows of evidence().

    Up to MOST_SITES sites are broadcast. Of more, the HOT_SITES with the most documents are, and the rest are joined by
    shuffle, where each has few rows: those of broadcast sites are dealt by number.
    """
    own = [c for c in scored.columns if c not in ("__host", "__path", "evidence")]
    sites = model.sites.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "host_posterior", "path_posterior", "n")
    if model.n_sites <= MOST_SITES:
        d = scored.join(F.broadcast(sites.drop("n")), ["__host", "__path"], "left")
    else:
        largest = sites.orderBy(F.col("n").desc(), "__host", "__path").limit(HOT_SITES).drop("n")
        d = scored.join(F.broadcast(largest.withColumnsRenamed({"host_posterior": "__h", "path_posterior": "__p"})), ["__host", "__path"], "left")
        d = d.withColumn("__host", F.when(F.col("__h").isNull(), F.col("__host")).otherwise(F.concat(F.lit("="), (F.monotonically_increasing_id() % 65536).cast("string"))))
        d = d.join(sites.drop("n"), ["__host", "__path"], "left")
        d = d.withColumn("host_posterior", F.coalesce("__h", "host_posterior")).withColumn("path_posterior", F.coalesce("__p", "path_posterior"))
    d = d.withColumn("host_posterior", F.coalesce("host_posterior", F.lit(model.mean))).withColumn("path_posterior", F.coalesce("path_posterior", F.lit(model.mean)))
    score = 1 / (1 + F.exp(-(_logit(F.col("evidence")) + _logit(F.col("path_posterior")) - _logit(F.lit(model.mean)))))
    d = d.withColumn("quality", F.when(F.col("evidence") > 0, score).otherwise(0.0))
    return d.select(*own, "evidence", "host_posterior", "path_posterior", "quality", (F.col("quality") >= THRESHOLD).alias("kept"))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, host: Column | str, path: Column | str, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """The classifier of the labels and the posteriors of docs' sites."""
    c = fit(*_sample(docs, labels, id_col, text, label))
    return site_model(evidence(spark, docs, c, host, path, [], text), c)


def classify(spark: SparkSession, docs: DataFrame, model: QualityModel, host: Column | str, path: Column | str, keep: list[str], text: str = "text") -> DataFrame:
    """docs' columns named in keep, with evidence, host_posterior, path_posterior, quality and kept."""
    return posterior(evidence(spark, docs, model.classifier, host, path, keep, text), model)


def assess(spark: SparkSession, docs: DataFrame, labels: DataFrame, host: Column | str, path: Column | str, keep: list[str], id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """learn and classify in one: each text is read once for its evidence, which is stored with the columns to keep."""
    c = fit(*_sample(docs, labels, id_col, text, label))
    scored = stored(evidence(spark, docs, c, host, path, keep, text), "evidence")
    return posterior(scored, site_model(scored, c))
