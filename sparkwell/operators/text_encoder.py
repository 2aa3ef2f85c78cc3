"""A text encoder learned from the corpus: word vectors from factored co-occurrences, weighted and centred sums, a projection.

Co-occurrences of the most frequent terms within a window are counted in each task and summed by pair; their positive
pointwise mutual information is factored by the distributed truncated SVD. A text is the sum of its words' vectors, weighted
by inverse document frequency, at unit length and less the corpus mean of such vectors. The word table stays frozen; the
projection behind it is what further training (contrastive, say) changes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop, spread, written
from .embeddings import Dense, _unit
from .gradients import PIECES, pieces, tree
from .linear import truncated_svd
from .retrieval import counted

VOCABULARY, WIDTH, WINDOW = 4096, 128, 5
#: A counting task's words at once, pairs that it merges at least, and pairs that it holds at most when it has merged.
WORDS, MERGE, MOST_HELD = 1 << 16, 1 << 20, 1 << 21
_TOKEN = re.compile("[a-z0-9]+")


@dataclass
class TextEncoder:
    """terms, their frozen table (weighted vectors), the corpus mean, and the projection."""

    terms: list[str]
    table: np.ndarray
    centre: np.ndarray
    projection: Dense = field(default_factory=lambda: Dense([], True))

    def parameters(self) -> dict[str, int]:
        """Trainable and frozen parameter counts: the table and the mean are frozen."""
        p = self.projection.parameters()
        return {"trainable": p["trainable"], "frozen": p["frozen"] + self.table.size + self.centre.size}

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """Unit sums of the known words' vectors; zeros for texts without any."""
        at = getattr(self, "_at", None)
        if at is None:
            at = self._at = {t: i for i, t in enumerate(self.terms)}
        out = np.zeros((len(texts), self.table.shape[1]))
        for r, t in enumerate(texts):
            known = [at[w] for w in _TOKEN.findall((t or "").lower()) if w in at]
            if known:
                word, n = np.unique(known, return_counts=True)
                out[r] = n @ self.table[word]
        return _unit(out)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """What the projection gets."""
        x = self.sums(texts)
        return np.where((x != 0).any(axis=1)[:, None], x - self.centre, 0.0)

    def encode(self, df: DataFrame, text: str, out: str = "vec", batch: int = 64) -> DataFrame:
        """Adds the unit vector of a text column, in Arrow batches; whole texts are read."""
        held = df.sparkSession.sparkContext.broadcast(self)  # terms x width numbers, both parameters

        @F.pandas_udf("array<double>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in parts:
                for a in range(0, len(s), batch):
                    yield pd.Series(list(held.value.projection(held.value.features(s.iloc[a : a + batch].tolist()))), dtype=object)

        return df.withColumn(out, run(F.col(text)))


def co_occurrences(docs: DataFrame, terms: list[str], text: str, window: int = WINDOW) -> DataFrame:
    """(i, j, n), i and j positions of terms: pairs at most window words apart, each weighted by one over its distance, both ways.

    Counted one way (i <= j) and mirrored after the sums. A task merges what it has counted when as much again is new, so that
    its time follows its words, and gives its sums away when they are more than MOST_HELD pairs.
    """
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size = {t: i for i, t in enumerate(held.value)}, max(1, len(held.value))
        keys, weights, new, merged = [np.zeros(0, np.int64)], [np.zeros(0)], 0, 0
        for words in _runs(batches, at, window):
            for d in range(1, window + 1):
                x, y = words[:-d], words[d:]
                ok = (x >= 0) & (y >= 0)
                x, y = x[ok], y[ok]
                keys.append(np.minimum(x, y) * size + np.maximum(x, y))
                weights.append(np.where(x == y, 2.0, 1.0) / d)
                new += len(x)
            if new > max(MERGE, merged):
                keys, weights = _merged(keys, weights)
                new, merged = 0, len(keys[0])
                if merged > MOST_HELD:
                    yield _pairs(keys[0], weights[0], size)
                    keys, weights, merged = [np.zeros(0, np.int64)], [np.zeros(0)], 0
        (key,), (n,) = _merged(keys, weights)
        yield _pairs(key, n, size)

    one = docs.select(text).mapInArrow(run, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both = F.array(F.struct("i", "j", "n"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "n"))
    return one.select(F.explode(F.when(F.col("i") == F.col("j"), F.slice(both, 1, 1)).otherwise(both)).alias("p")).select("p.*")


def _runs(batches: Iterator[pa.RecordBatch], at: dict[str, int], window: int) -> Iterator[np.ndarray]:
    """Positions of the words of about WORDS words' texts at a time, -1 for others; window of these part two texts."""
    words: list[int] = []
    for b in batches:
        for t in b.column(0):
            words.extend(at.get(w, -1) for w in _TOKEN.findall((t.as_py() or "").lower()))
            words.extend([-1] * window)
            if len(words) > WORDS:
                yield np.array(words, np.int64)
                words = []
    yield np.array(words, np.int64)


def _pairs(key: np.ndarray, n: np.ndarray, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array((key // size).astype(np.int32)), pa.array((key % size).astype(np.int32)), pa.array(n)], ["i", "j", "n"])


def _merged(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return [key], [np.bincount(at, np.concatenate(weights), len(key))]


def learn(docs: DataFrame, text: str = "body_text", vocabulary: int = VOCABULARY, width: int = WIDTH, window: int = WINDOW, seed: int = 42) -> TextEncoder:
    """Word vectors of the most frequent terms (ties by term), from whole texts of all rows."""
    d = spread(docs.select(text))
    rows = counted(d.withColumn("one", F.lit(0)), "one", text).select("dl", "terms", "tfs")
    found = rows.select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.tfs").alias("total"), F.count("*").alias("df"))
    top = found.orderBy(F.col("total").desc(), "term").limit(vocabulary).collect()  # a parameter
    n = d.count()
    terms = [r["term"] for r in top]
    idf = np.array([math.log((1 + n) / (1 + r["df"])) + 1 for r in top])
    pairs = written(co_occurrences(d, terms, text, window), "co-occurrences")
    totals = np.zeros(len(terms))
    for r in pairs.groupBy("i").agg(F.sum("n").alias("n")).collect():
        totals[r["i"]] = r["n"]
    whole = float(totals.sum())
    sums = F.broadcast(pairs.sparkSession.createDataFrame([(i, float(t)) for i, t in enumerate(totals)], "k int, t double"))  # a row a term
    p = pairs.join(sums.withColumnsRenamed({"k": "i", "t": "ti"}), "i").join(sums.withColumnsRenamed({"k": "j", "t": "tj"}), "j")
    p = p.withColumn("w", F.log(F.col("n") * whole / (F.col("ti") * F.col("tj")))).where("w > 0")
    vectors = p.groupBy(F.col("i").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("j").alias("i"), "w"))).alias("x")).select("doc_id", "x.i", "x.w")
    vectors = written(vectors, "information")
    table = np.zeros((len(terms), 1))
    if terms and vectors.count():
        out, _ = truncated_svd(vectors, len(terms), width, seed=seed)
        got = {r["doc_id"]: r["features"] for r in out.collect()}  # terms x width numbers
        table = np.zeros((len(terms), len(next(iter(got.values())))))
        for i, x in got.items():
            table[i] = x
    drop(pairs)
    drop(vectors)
    encoder = TextEncoder(terms, idf[:, None] * table, np.zeros(table.shape[1]))
    held = d.sparkSession.sparkContext.broadcast(encoder)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(held.value.table.shape[1] + 1)
        for b in batches:
            x = held.value.sums(b.column(0).to_pylist())
            total += np.append(x.sum(axis=0), (x != 0).any(axis=1).sum())
        yield pieces(total)

    total = tree(d.mapInArrow(add, PIECES), d.rdd.getNumPartitions())
    if total is not None and total[-1]:
        encoder.centre = total[:-1] / total[-1]
    return encoder
