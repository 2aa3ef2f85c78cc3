"""Many linear models in one pass: Newton steps for all strengths, held-out folds and feature prefixes at once.

One scan gives every model's loss, gradient and Hessian, as sums of a task's rows first and of tasks then; the driver solves
models x (features + 1) small systems, and steps that raise a model's loss are halved. Areas under the curve of all models
come from one distributed rank sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import drop, written

#: Rows that are multiplied at once in a task, and scans at most.
ROWS, SCANS = 8192, 60


@dataclass(frozen=True)
class Fit:
    """A model to fit: strength c of the losses against half the squared weights, the fold left out, the first features used."""

    c: float
    width: int
    held: int = -1


def _matrix(b: pa.RecordBatch, s: int) -> np.ndarray:
    """Features and a one of a slice of rows (label, fold, features ..)."""
    x = [b.column(j).slice(s, ROWS).to_numpy(zero_copy_only=False).astype(float) for j in range(2, b.num_columns)]
    return np.column_stack([*x, np.ones(len(x[0]) if x else min(ROWS, b.num_rows - s))])


def sums(rows: DataFrame, w: np.ndarray, fits: list[Fit], logistic: bool) -> np.ndarray:
    """A row for each model: loss, gradient and upper triangle of the Hessian of its rows at the weights w (models x features + 1)."""
    k = w.shape[1]
    held, (i, j) = np.array([f.held for f in fits]), np.triu_indices(k)
    width = 1 + k + len(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(w), width))
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                x = _matrix(b, s)
                y = 2 * b.column(0).slice(s, ROWS).to_numpy(zero_copy_only=False).astype(float)[:, None] - 1
                use = b.column(1).slice(s, ROWS).to_numpy(zero_copy_only=False)[:, None] != held
                m = y * (x @ w.T)
                if logistic:
                    p = (1 - np.tanh(m / 2)) / 2
                    loss, slope, curve = np.logaddexp(0, -m), -y * p, p * (1 - p)
                else:
                    h = np.maximum(0, 1 - m)
                    loss, slope, curve = h * h, -2 * y * h, 2.0 * (h > 0)
                total[:, 0] += (loss * use).sum(axis=0)
                total[:, 1 : k + 1] += (slope * use).T @ x
                total[:, k + 1 :] += (curve * use).T @ (x[:, i] * x[:, j])
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["at", "v"])

    out = np.zeros(len(w) * width)
    for r in rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # models x width numbers
        out[r["at"]] = r["v"]
    return out.reshape(len(w), width)


def newton(rows: DataFrame, fits: list[Fit], logistic: bool, tolerance: float = 1e-12) -> np.ndarray:
    """Weights and bias (last, unpenalised) of every model, from rows (label, fold, features ..); label is 0 or 1."""
    k = len(rows.columns) - 1
    w = np.zeros((len(fits), k))
    trial, value, step, turn = w.copy(), np.full(len(fits), np.inf), np.ones(len(fits)), np.zeros_like(w)
    open_ = list(range(len(fits)))
    i, j = np.triu_indices(k)
    for _ in range(SCANS):
        if not open_:
            break
        got = sums(rows, trial[open_], [fits[m] for m in open_], logistic)
        for m, r in zip(list(open_), got, strict=True):
            fit, x = fits[m], trial[m]
            now = 0.5 * float(x[:-1] @ x[:-1]) + fit.c * r[0]
            if now <= value[m] + 1e-12 * abs(now):
                h = np.zeros((k, k))
                h[i, j] = h[j, i] = r[k + 1 :]
                on = np.append(np.arange(fit.width), k - 1)
                ridge = np.append(np.ones(fit.width), 1e-9)
                g = fit.c * r[1 : k + 1][on] + np.append(x[: fit.width], 0.0)
                d = np.linalg.solve(fit.c * h[np.ix_(on, on)] + np.diag(ridge), -g)
                w[m], value[m], step[m] = x, now, 1.0
                turn[m], gain = 0.0, -float(g @ d)
                turn[m][on] = d
                if gain <= tolerance * (1 + abs(now)):
                    w[m] = w[m] + turn[m]  # the last step is too small to be worth a scan
                    open_.remove(m)
                    continue
            else:
                step[m] /= 2
                if step[m] < 1e-8:
                    open_.remove(m)
                    continue
            trial[m] = w[m] + step[m] * turn[m]
    return w


def decisions(rows: DataFrame, w: np.ndarray, fits: list[Fit], held_out: bool) -> DataFrame:
    """(model, label, raw) of every row for every model, or for those that its fold was left out of."""
    held = np.array([f.held for f in fits])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                z = _matrix(b, s) @ w.T
                fold = b.column(1).slice(s, ROWS).to_numpy(zero_copy_only=False)[:, None]
                r, m = np.nonzero(fold == held) if held_out else np.nonzero(np.ones(z.shape, bool))
                label = b.column(0).slice(s, ROWS).to_numpy(zero_copy_only=False).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array(label[r]), pa.array(z[r, m])], ["model", "label", "raw"])

    return rows.mapInArrow(run, "model int, label int, raw double")


def areas(scored: DataFrame) -> dict[int, float]:
    """The area under the ROC curve of each model in (model, label, raw): ties count half; 0.5 where a class is missing.

    Rows are summed by score, dealt in ranges of (model, score) and counted up inside a range from where the last one ended.
    """
    by = scored.groupBy("model", "raw").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    ranged = written(by.repartitionByRange("model", "raw").withColumn("part", F.spark_partition_id()), "scores")
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part", "model").agg(F.sum("n").alias("n"))
    starts = starts.select("part", "model", F.coalesce(F.sum("n").over(before("model").orderBy("part")), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("n").over(before("part", "model").orderBy("raw")), F.lit(0))
    counted = ranged.withColumn("below", inside).join(F.broadcast(starts), ["part", "model"])  # a row a range and model
    total = counted.groupBy("model").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * (F.col("start") + F.col("below") + F.col("n") / 2)).alias("s"))
    out = {r["model"]: r["s"] / (r["p"] * r["n"]) if r["p"] and r["n"] else 0.5 for r in total.collect()}
    drop(ranged)
    return out
