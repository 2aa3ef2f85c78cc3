"""LambdaRank: a small scoring network in numpy, trained on groups of judged documents."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from .gradients import flat, summed, unflat
from .ranking import ndcg, trainable_groups

HIDDEN = (256, 128)


def pair_weights(labels: np.ndarray, scores: np.ndarray, k: int = 10) -> np.ndarray:
    """|change of NDCG| for swapping i and j where label_i > label_j; k cuts the ideal DCG only. Ties keep their order."""
    n = len(labels)
    rank = np.empty(n)
    rank[np.argsort(-scores, kind="stable")] = np.arange(1, n + 1)
    gain, discount = 2.0**labels - 1, 1 / np.log2(rank + 1)
    ideal = np.sort(gain)[::-1][:k]
    best = float((ideal / np.log2(np.arange(2, len(ideal) + 2))).sum())
    if best == 0:
        return np.zeros((n, n))
    change = np.abs(np.subtract.outer(gain, gain) * np.subtract.outer(discount, discount)) / best
    return np.where(np.greater.outer(labels, labels), change, 0.0)


def group_lambdas(labels: np.ndarray, scores: np.ndarray, k: int = 10) -> np.ndarray:
    """For each document, what its pairs push it up or down."""
    push = pair_weights(labels, scores, k) / (1 + np.exp(np.clip(np.subtract.outer(scores, scores), -500, 500)))
    return push.sum(axis=1) - push.sum(axis=0)


@dataclass
class Network:
    """A multi-layer scorer with ReLU and (in training) dropout."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]

    @classmethod
    def random(cls, inputs: int, hidden: tuple[int, ...] = HIDDEN, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        widths = [inputs, *hidden, 1]
        bound = [1 / math.sqrt(a) for a in widths[:-1]]
        return cls([rng.uniform(-b, b, (a, c)) for a, b, c in zip(widths, bound, widths[1:])], [rng.uniform(-b, b, c) for b, c in zip(bound, widths[1:])])

    def forward(self, x: np.ndarray, drop: float = 0.0, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        saved = []
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            out = x @ w + b
            mask = None
            if i < len(self.weights) - 1:
                mask = (out > 0).astype(float)
                if drop:
                    mask *= (rng.random(out.shape) >= drop) / (1 - drop)
                out = out * mask
            saved.append((x, mask))
            x = out
        return x[:, 0], saved

    def backward(self, saved: list, d: np.ndarray) -> list[np.ndarray]:
        """Gradients of sum(d * score): weights, then biases."""
        gw, gb = [None] * len(self.weights), [None] * len(self.weights)
        d = d[:, None]
        for i in range(len(self.weights) - 1, -1, -1):
            x, mask = saved[i]
            if mask is not None:
                d = d * mask
            gw[i], gb[i] = x.T @ d, d.sum(axis=0)
            d = d @ self.weights[i].T
        return gw + gb

    def parameters(self) -> list[np.ndarray]:
        return self.weights + self.biases


@dataclass
class Trainer:
    """Adam with gradient clipping and a cosine learning rate.

    mode local: one step per query in the order of query_id, on the driver, for data that fits there.
    mode sync: partitions sum the gradients of all their queries for the same parameters; one step per pass over a
    hashed part of the queries (parts of them an epoch).
    """

    network: Network
    rate: float = 1e-3
    decay: float = 1e-4
    dropout: float = 0.1
    k: int = 10
    clip: float = 1.0
    seed: int = 0
    steps: int = 0
    moments: list = field(default_factory=list)

    def step(self, grads: list[np.ndarray], rate: float) -> None:
        p = self.network.parameters()
        if not self.moments:
            self.moments = [(np.zeros_like(x), np.zeros_like(x)) for x in p]
        norm = math.sqrt(sum(float((g * g).sum()) for g in grads))
        scale = min(1.0, self.clip / (norm + 1e-6))
        self.steps += 1
        for x, g, (m, v) in zip(p, grads, self.moments):
            g = g * scale + self.decay * x
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)

    def rate_at(self, epoch: int, epochs: int) -> float:
        return self.rate * (1 + math.cos(math.pi * epoch / max(1, epochs))) / 2

    def _gradient(self, x: np.ndarray, labels: np.ndarray, rng: np.random.Generator | None) -> tuple[list[np.ndarray], float]:
        scores, saved = self.network.forward(x, self.dropout if rng is not None else 0.0, rng)
        push = group_lambdas(labels, scores, self.k)
        return self.network.backward(saved, -push), -float((scores * push).sum())

    def train(self, groups: DataFrame, validation: DataFrame | None = None, epochs: int = 20, mode: str = "sync", parts: int = 4, label: str = "relevance_score") -> list[dict]:
        """groups: (query_id, doc_id, label, features array). Returns loss and validation NDCG by epoch.

        mode "sync": the groups are stored once, a row a query, and each epoch takes a step on each of parts random shares of
        them, from the sum of their gradients. mode "local": a step a query on the driver, for sets that fit it.
        """
        rows = trainable_groups(groups, label).select("query_id", "doc_id", F.col(label).cast("double").alias("l"), "features")
        history, rng = [], np.random.default_rng(self.seed)
        local = None
        if mode == "local":
            d = rows.orderBy("query_id", "doc_id").toPandas()
            local = [(np.stack(g["features"].to_numpy()).astype(float), g["l"].to_numpy(float)) for _, g in d.groupby("query_id", sort=True)]
        else:
            whole = F.array_sort(F.collect_list(F.struct("doc_id", "l", "features")))  # a query's judgments
            rows = written(rows.groupBy(F.col("query_id").cast("string").alias("query_id")).agg(whole.alias("r")).select("query_id", F.col("r.l").alias("l"), F.col("r.features").alias("x")), "groups")
        for epoch in range(epochs):
            rate, loss, n = self.rate_at(epoch, epochs), 0.0, 0
            if local is not None:
                for x, labels in local:
                    g, lost = self._gradient(x, labels, rng if self.dropout else None)
                    self.step(g, rate)
                    loss, n = loss + lost, n + 1
            else:
                for part in range(parts):
                    share = rows.where(F.pmod(F.xxhash64(F.lit(self.seed), "query_id"), F.lit(parts)) == part)
                    g, lost, count = self._summed(share, epoch)
                    if count:
                        self.step([x / count for x in g], rate)
                    loss, n = loss + lost, n + count
            entry = {"epoch": epoch, "loss": loss / max(1, n)}
            if validation is not None:
                entry["ndcg"] = self.evaluate(validation, label)
            history.append(entry)
        return history

    def _summed(self, rows: DataFrame, epoch: int) -> tuple[list[np.ndarray], float, int]:
        """Gradients, losses and number of the groups (query_id, l, x), summed."""
        like = self.network.parameters()
        trainer = Trainer(self.network, dropout=self.dropout, k=self.k, seed=self.seed)

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in frames:
                total = np.zeros(sum(x.size for x in like) + 2)
                for query, labels, x in zip(d["query_id"], d["l"], d["x"], strict=True):
                    rng = np.random.default_rng([trainer.seed, epoch, zlib.crc32(str(query).encode())]) if trainer.dropout else None
                    g, lost = trainer._gradient(np.stack(x).astype(float), np.asarray(labels, float), rng)
                    total += flat(g, lost, 1.0)
                yield pd.DataFrame({"g": [total]})

        total = summed(rows.mapInPandas(each, "g array<double>"))
        if total is None:
            return [np.zeros_like(x) for x in like], 0.0, 0
        return unflat(total, like), float(total[-2]), int(total[-1])

    def predict(self, df: DataFrame, column: str = "features", out: str = "score") -> DataFrame:
        """Adds the network's score, in Arrow batches."""
        held = df.sparkSession.sparkContext.broadcast(self.network)

        @F.pandas_udf("double")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in parts:
                yield pd.Series(held.value.forward(np.stack(s.to_numpy()).astype(float))[0] if len(s) else [], dtype=float)

        return df.withColumn(out, run(F.col(column)))

    def evaluate(self, groups: DataFrame, label: str = "relevance_score") -> float:
        """Mean NDCG over the groups that could be trained on."""
        scored = self.predict(trainable_groups(groups, label).select("query_id", "doc_id", F.col(label).alias("relevance_score"), "features"))
        return float(ndcg(scored, self.k).agg(F.avg("ndcg")).first()[0] or 0.0)

    def save(self, spark: SparkSession, path: str) -> None:
        """Network and optimizer state as one row of JSON text, on any file system Spark writes."""
        state = {"weights": [w.tolist() for w in self.network.weights], "biases": [b.tolist() for b in self.network.biases], "moments": [[m.tolist(), v.tolist()] for m, v in self.moments]}
        state |= {n: getattr(self, n) for n in ("rate", "decay", "dropout", "k", "clip", "seed", "steps")}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trainer:
        s = json.loads(spark.read.text(str(Path(path)) if "://" not in path else path).first()[0])
        net = Network([np.array(w) for w in s.pop("weights")], [np.array(b) for b in s.pop("biases")])
        moments = [(np.array(m), np.array(v)) for m, v in s.pop("moments")]
        return cls(net, moments=moments, **s)
