"""Sums of gradients over partitions, for synchronous training."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Values of one piece of a vector, and sums that one task adds.
PIECE, FAN = 1 << 14, 32


PIECES = "piece int, slot int, g binary"


def pieces(total: np.ndarray, size: int | None = None) -> pa.RecordBatch:
    """The rows (PIECES) of a task's sum: pieces of size values, marked with the task's number."""
    cut = [total[s : s + (size or PIECE)] for s in range(0, len(total), size or PIECE)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut), dtype=np.int32)), pa.array(np.full(len(cut), TaskContext.get().partitionId(), np.int32)), pa.array([c.tobytes() for c in cut], pa.binary())], ["piece", "slot", "g"])


def tree(rows: DataFrame, partitions: int) -> np.ndarray | None:
    """The sum of all tasks' pieces (PIECES): each level adds the same piece of FAN tasks, in their order; the driver gets
    every piece once, however many partitions there are."""

    def level(t: pa.Table) -> pa.Table:
        t = t.sort_by("slot")
        total = np.array(np.frombuffer(t["g"][0].as_py()))
        for g in t["g"][1:]:
            total += np.frombuffer(g.as_py())
        return pa.table({"piece": t["piece"].slice(0, 1), "slot": pa.array([t["slot"][0].as_py() // FAN], pa.int32()), "g": pa.array([total.tobytes()], pa.binary())})

    while partitions > 1:
        partitions = -(-partitions // FAN)
        rows = rows.groupBy("piece", (rows["slot"] / FAN).cast("int")).applyInArrow(level, PIECES)
    found = sorted((r["piece"], bytes(r["g"])) for r in rows.collect())
    return np.concatenate([np.frombuffer(g) for _, g in found]) if found else None


def summed(vectors: DataFrame, partitions: int | None = None) -> np.ndarray | None:
    """The sum of column g (array<double>, of one length), as a tree over the partitions (their number, where the caller knows it)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for g in b.column(0):
                total = np.array(g.values) if total is None else total + np.asarray(g.values)
        if total is not None:
            yield pieces(total)

    return tree(vectors.select("g").mapInArrow(add, PIECES), partitions or vectors.rdd.getNumPartitions())


def flat(arrays: list[np.ndarray], *more: float) -> np.ndarray:
    return np.concatenate([*(x.ravel() for x in arrays), np.array(more, float)])


def unflat(total: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays that flat() joined, in the shapes of like; what follows them is left out."""
    ends = np.cumsum([x.size for x in like])
    return [total[e - x.size : e].reshape(x.shape) for e, x in zip(ends, like, strict=True)]
