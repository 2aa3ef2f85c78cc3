"""Contrastive training of the three encoders' projection networks, in numpy."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import LARGE_ROWS, bounded_batches, drop, written
from .embeddings import TEMPERATURE, Dense
from .gradients import PIECES, flat, pieces, tree, unflat


#: Rows of one stored part, and of one stored block at least (twice as many at most).
ROWS, BLOCK = 10_000, 1024
INPUTS = ("text", "image", "structured")


def forward(model: Dense, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Unit-length outputs and what the backward pass needs."""
    saved = []
    for i, (w, b) in enumerate(model.layers):
        out = x @ w + b
        mask = (out > 0) if i < len(model.layers) - 1 else None
        saved.append((x, mask))
        x = out if mask is None else out * mask
    size = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x / size, [*saved, (x / size, size)]


def backward(model: Dense, saved: list, d: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    unit, size = saved[-1]
    d = (d - unit * (d * unit).sum(axis=1, keepdims=True)) / size
    grads = [None] * len(model.layers)
    for i in range(len(model.layers) - 1, -1, -1):
        x, mask = saved[i]
        if mask is not None:
            d = d * mask
        grads[i] = (x.T @ d, d.sum(axis=0))
        if i:  # nothing asks for the inputs' gradient
            d = d @ model.layers[i][0].T
    return grads


def nce(a: np.ndarray, b: np.ndarray, temperature: float = TEMPERATURE) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss from anchors a to positives b, and its gradients."""
    z = a @ b.T / temperature
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    n = len(a)
    loss = -float(np.log(np.maximum(p[np.arange(n), np.arange(n)], 1e-300)).mean())
    p[np.arange(n), np.arange(n)] -= 1
    p /= n * temperature
    return loss, p @ b, p.T @ a


def _cut(seed: list[int], n: int, part: int, parts: int, size: int) -> list[np.ndarray]:
    """One share of the batches of n rows in a random order, without those below two rows."""
    order = np.random.default_rng(seed).permutation(n)
    return [take for b, take in enumerate(np.array_split(order, max(1, round(n / size)))) if b % parts == part and len(take) > 1]


def _packed(x: np.ndarray) -> bytes:
    """The numbers' bytes; one or two each where all are small whole numbers, as counts are."""
    for kind in (np.int8, np.int16):
        with np.errstate(invalid="ignore"):
            small = x.astype(kind)
        if np.array_equal(small, x):
            return small.tobytes()
    return x.tobytes()


def _unpacked(values: pa.Scalar, count: int, width: int, kind: type) -> np.ndarray:
    """count rows of width numbers, as _packed stored them."""
    b = values.as_buffer()
    return np.frombuffer(b, {1: np.int8, 2: np.int16}.get(b.size // (count * width), kind)).reshape(count, -1)


def _of(model: Dense, kind: type) -> Dense:
    """The network in the precision of its inputs."""
    return Dense([(w.astype(kind), b.astype(kind)) for w, b in model.layers], model.normalize, model.frozen)


def _arrays(rows: pa.Table) -> list[np.ndarray]:
    return [np.asarray(rows[c].combine_chunks().flatten()) for c in INPUTS]


def _blocks(kinds: list, features: Callable[[pa.Table], list[np.ndarray]] = _arrays):
    """Rows (i, text, image, structured), or of what features makes of them, as blocks of their numbers, in the order of i: a reader copies them whole."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by("i").combine_chunks()
        values = [_packed(np.asarray(x, k)) for x, k in zip(features(rows), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([rows.num_rows], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], ["n", *INPUTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n > 2 * BLOCK:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, BLOCK))
                held, n = rows.slice(BLOCK).to_batches(), n - BLOCK
        if n:
            yield block(pa.Table.from_batches(held))

    return run


@dataclass
class ContrastiveTrainer:
    """One Adam optimizer for the text, image and structured networks; the loss sums the three pairs of modalities."""

    text: Dense
    image: Dense
    structured: Dense
    rate: float = 1e-3
    temperature: float = TEMPERATURE
    seed: int = 0

    def __post_init__(self) -> None:
        self.steps = 0
        self.moments = [[(np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)) for w, b in m.layers] for m in self.models()]

    def models(self) -> list[Dense]:
        return [self.text, self.image, self.structured]

    def batch(self, xs: list[np.ndarray]) -> tuple[float, list]:
        return self.batches(xs, [len(xs[0])])

    def batches(self, xs: list[np.ndarray], sizes: list[int]) -> tuple[float, list]:
        """The summed losses and gradients of consecutive batches of those sizes: only the loss parts them, the layers take all rows at once."""
        out = [forward(m, x) for m, x in zip(self.models(), xs)]
        d = [np.zeros_like(o) for o, _ in out]
        loss, ends = 0.0, np.cumsum(sizes)
        for s, e in zip(ends - sizes, ends):
            for i, j in ((0, 1), (0, 2), (1, 2)):
                lost, di, dj = nce(out[i][0][s:e], out[j][0][s:e], self.temperature)
                loss += lost
                d[i][s:e] += di
                d[j][s:e] += dj
        return loss, [backward(m, s, g) for m, (_, s), g in zip(self.models(), out, d)]

    def step(self, grads: list) -> None:
        self.steps += 1
        a, b = 1 - 0.9**self.steps, 1 - 0.999**self.steps
        for m, gs, held in zip(self.models(), grads, self.moments):
            for i, ((w, bias), (gw, gb), (mw, vw, mb, vb)) in enumerate(zip(m.layers, gs, held)):
                if i < m.frozen:
                    continue
                for x, g, mo, v in ((w, gw, mw, vw), (bias, gb, mb, vb)):
                    mo += 0.1 * (g - mo)
                    v += 0.001 * (g * g - v)
                    x -= self.rate * (mo / a) / (np.sqrt(v / b) + 1e-8)

    def train_epoch(self, xs: list[np.ndarray], epoch: int = 0, size: int = 64) -> dict:
        """Random batches; a last batch below two rows is left out."""
        order = np.random.default_rng([self.seed, epoch]).permutation(len(xs[0]))
        losses = []
        for s in range(0, len(order), size):
            rows = order[s : s + size]
            if len(rows) < 2:
                continue
            loss, grads = self.batch([x[rows] for x in xs])
            self.step(grads)
            losses.append(loss)
        return {"loss": float(np.mean(losses)) if losses else 0.0, "n_batches": len(losses)}

    def train(self, data: DataFrame, epochs: int = 10, size: int = 64, mode: str = "sync", parts: int = 4, features: Callable[[pa.Table], list[np.ndarray]] | None = None) -> list[dict]:
        """data: (i, text, image, structured) arrays, or rows with i of which features makes these matrices. Returns losses by epoch.

        mode "sync": the rows are dealt by hash, before features makes their vectors, and stored once, in blocks. Every task cuts
        each block, in a new random order each epoch, into batches of about size, and each epoch takes a step on each of parts
        shares of the batches, from the sum of their gradients; no vector is shuffled, and of gradients each core's sum is. Where
        every core has several blocks of each share, a share is whole blocks, stored apart, and an epoch reads every row once. A
        network computes in the precision of its inputs; sums are in 64 bits. mode "local": a step a batch on the driver, for sets that fit it.
        """
        if mode == "local":
            if features:
                xs = [x.astype(float) for x in features(data.orderBy("i").toArrow())]
            else:
                d = data.orderBy("i").toPandas()
                xs = [np.stack(d[c].to_numpy()).astype(float) for c in INPUTS]
            return [{"epoch": e, **self.train_epoch(xs, e, size)} for e in range(epochs)]
        spark = data.sparkSession
        bounded_batches(spark)
        cores, n = spark.sparkContext.defaultParallelism, data.count()
        apart = n >= 2 * cores * parts * BLOCK
        if features:
            kinds = [np.float32 if x.dtype == np.float32 else np.float64 for x in features(data.limit(1).toArrow())]
        else:
            data = data.select("i", *INPUTS)
            kinds = [np.float32 if data.schema[c].dataType.elementType.simpleString() == "float" else np.float64 for c in INPUTS]
        dealt = data.repartition(max(1, min(n // (4 * size), n // ROWS + cores)), F.xxhash64(F.lit(self.seed), "i"))
        made = dealt.mapInArrow(_blocks(kinds, features or _arrays), "n int, " + ", ".join(f"{c} binary" for c in INPUTS))
        made = made.withColumn("share", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(parts if apart else 1)).cast("int"))
        stored = written(made, "pairs", options=LARGE_ROWS | {"compression": "none"}, by=["share"])
        shares = [stored.where(F.col("share") == p).drop("share").coalesce(cores) for p in range(parts if apart else 1)]
        tasks, history = [rows.rdd.getNumPartitions() for rows in shares], []
        like = [x for m in self.models() for layer in m.layers for x in layer]
        for epoch in range(epochs):
            loss, n = 0.0, 0
            for part in range(parts):
                held = spark.sparkContext.broadcast(self.models())
                at, cut = (part, (0, 1)) if apart else (0, (part, parts))
                total = tree(shares[at].mapInArrow(self._sums(held, kinds, epoch, *cut, size), PIECES), tasks[at])
                held.destroy()
                if total is not None and total[-1]:
                    g = iter(unflat(total / total[-1], like))
                    self.step([[(next(g), next(g)) for _ in m.layers] for m in self.models()])
                    loss, n = loss + float(total[-2]), n + int(total[-1])
            history.append({"epoch": epoch, "loss": loss / max(1, n), "n_batches": n})
        drop(stored)
        return history

    def _share(self, epoch: int, part: int, parts: int, size: int):
        """Flat gradients, losses and numbers of one share of the batches; those below two rows are left out."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in frames:
                d = d.sort_values("i")
                for take in _cut([self.seed, epoch, len(d)], len(d), part, parts, size):
                    loss, grads = self.batch([np.stack(d[c].to_numpy()[take]).astype(float) for c in INPUTS])
                    yield pd.DataFrame({"g": [flat([x for model in grads for layer in model for x in layer], loss, 1.0)]})

        return run

    def _sums(self, held, kinds: list, epoch: int, part: int, parts: int, size: int):
        """What _share gives, of stored blocks and summed over a task (PIECES)."""
        seed, temperature = self.seed, self.temperature

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = ContrastiveTrainer(*(_of(m, kind) for m, kind in zip(held.value, kinds, strict=True)), temperature=temperature)
            total, loss, n = [np.zeros(x.shape) for m in t.models() for layer in m.layers for x in layer], 0.0, 0
            for b in batches:
                for r in range(b.num_rows):
                    count = b.column(0)[r].as_py()
                    takes = _cut([seed, epoch, count], count, part, parts, size)
                    if not takes:
                        continue
                    xs = [_unpacked(b.column(c + 1)[r], count, len(m.layers[0][0]), kind) for c, (m, kind) in enumerate(zip(t.models(), kinds, strict=True))]
                    rows = np.concatenate(takes)
                    lost, grads = t.batches([x[rows].astype(kind, copy=False) for x, kind in zip(xs, kinds, strict=True)], [len(x) for x in takes])
                    loss, n = loss + lost, n + len(takes)
                    for x, g in zip(total, (x for model in grads for layer in model for x in layer), strict=True):
                        x += g
            if n:
                yield pieces(flat(total, loss, n))

        return run

    def save_all(self, spark: SparkSession, path: str) -> None:
        rows = [(n, json.dumps([[w.tolist(), b.tolist()] for w, b in m.layers])) for n, m in zip(("text", "image", "structured"), self.models())]
        spark.createDataFrame(rows, "name string, layers string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load_all(cls, spark: SparkSession, path: str) -> ContrastiveTrainer:
        rows = {r["name"]: Dense([(np.array(w), np.array(b)) for w, b in json.loads(r["layers"])]) for r in spark.read.parquet(path).collect()}
        return cls(rows["text"], rows["image"], rows["structured"])
