"""Helpers that the training-data operators share: shared storage, word hashing, components."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path

# ---------------------------------------------------------------- shared storage


#: Small tables are written with this many rows a file (and LEAST_FILES at least), not one file a shuffle partition.
FILE_ROWS = 500_000
LEAST_FILES = 8


def stored(df: DataFrame, name: str, rows: int | None = None, summed: bool = False) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. rows: an upper bound of its rows, where known.

    summed: df is an aggregate of many more rows than it has; it runs in all its tasks, and its few rows are dealt to the files
    after it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        files = max(LEAST_FILES, rows // FILE_ROWS)
        df = df.repartition(files) if summed else df.coalesce(files)
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def kept(df: DataFrame) -> DataFrame:
    """Keep a small table that is read several times. Lost parts are computed again from the inputs, which is cheap for these."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def release(spark: SparkSession) -> None:
    """Let the driver notice plans that are no longer used: executors keep a plan's shuffle files until it has."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by stored() that no later plan reads."""
    path = getattr(df, "_stored_at", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of rows in one Arrow batch: bounds what a task holds outside the JVM's heap, however long the texts are.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(key).rstrip("b"))
    except ValueError:  # in a larger unit: set by hand
        return
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


# ---------------------------------------------------------------- word hashing

_U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, A-Z as a-z.
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
SEGMENT = 1 << 19
_K = _rng.integers(1, 2**64, 64, dtype=np.uint64) | _U(1)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, SEGMENT)
        _powers[:] = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(n, _U(b), dtype=np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _hashes(data: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of words; heads: where a text begins (no word spans it)."""
    w = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[heads] = True
    cut[0] = cut[-1] = True
    edge = w.copy()
    edge[1:] &= ~w[:-1] | cut[1:-1]
    starts = np.flatnonzero(edge)
    edge = w
    last = edge.copy()
    last[:-1] &= ~edge[1:] | cut[1:-1]
    ends = np.flatnonzero(last) + 1
    power, inverse = _tables(len(data))
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=c[1:])
    return starts, ends, mix((c[ends] - c[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of several texts, and each text's first word's index.

    data: the texts' bytes; offsets: where each begins, and the end. Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased.
    Long inputs go in segments cut at white space.
    """
    n = len(data)
    if n <= SEGMENT:
        s, e, h = _hashes(data, offsets[:-1]) if n else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    else:
        parts, at = [], 0
        while at < n:
            to = min(n, at + SEGMENT)
            if to < n:
                back = np.flatnonzero(_SPACE[data[at:to]])
                heads = offsets[(offsets > at) & (offsets <= to)]
                best = max(at + back[-1] + 1 if len(back) else 0, heads[-1] if len(heads) else 0)
                if best > at:
                    to = int(best)
                else:  # one word longer than a segment
                    ahead = np.flatnonzero(_SPACE[data[to:]])
                    later = offsets[offsets > to]
                    to = int(min(to + ahead[0] if len(ahead) else n, later[0] if len(later) else n))
            inside = offsets[(offsets >= at) & (offsets < to)] - at
            s, e, h = _hashes(data[at:to], inside)
            parts.append((s + at, e + at, h))
            at = to
        s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return s, e, h, np.searchsorted(s, offsets)


def text_chunks(col: pa.Array, limit: int = SEGMENT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string column of about limit bytes: first row, end, bytes, offsets. Null counts as empty."""
    col = col.cast(pa.large_string()).fill_null("")
    if len(col) == 0:
        return
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text; with fewer words, of the whole sequence."""
    n = len(words)
    if n == 0:
        return words
    m = min(n, k)
    g = np.zeros(n - m + 1, np.uint64)
    for i in range(m):
        g += words[i : n - m + 1 + i] * _K[i]
    return np.unique(mix(g + _U(m)))


def row_shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of several texts, in text order, repeats included, and where each text's begin.

    first: each text's first word's index, and the end. A text with fewer words has its whole sequence as one.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.append(0, np.cumsum(count))
    out = np.empty(at[-1], np.uint64)
    long = n >= k
    if long.any():
        full = len(words) - k + 1
        g = words[:full] * _K[0]
        for i in range(1, k):
            g += words[i : i + full] * _K[i]
        inside = np.repeat(long, count)
        if inside.all() and at[-1] == full:
            out = mix(g + _U(k))
        else:
            spot = np.arange(at[-1]) - np.repeat(at[:-1], count) + np.repeat(first[:-1], count)
            out[inside] = mix(g[spot[inside]] + _U(k))
    for r in np.flatnonzero((n > 0) & ~long):
        m = int(n[r])
        out[at[r]] = mix((words[first[r] : first[r] + m] * _K[:m]).sum(keepdims=True, dtype=np.uint64) + _U(m))[0]
    return out, at


# ---------------------------------------------------------------- runs of sorted rows


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns of consecutive rows, cut so that no run of equal keys is split, and the runs' bounds."""
    held: dict[str, np.ndarray] | None = None
    for b in batches:
        if b.num_rows == 0:
            continue
        cols = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
        if held is not None:
            cols = {n: np.concatenate([held[n], c]) for n, c in cols.items()}
        new = np.zeros(len(cols[key[0]]), bool)
        new[0] = True
        for n in key:
            new[1:] |= cols[n][1:] != cols[n][:-1]
        at = np.flatnonzero(new)
        held = {n: c[at[-1] :] for n, c in cols.items()}
        if len(at) > 1:
            yield {n: c[: at[-1]] for n, c in cols.items()}, at
    if held is not None:
        yield held, np.array([0, len(held[key[0]])])


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for the nodes of edges (a long, b long), a stored table.

    Alternating large-star and small-star rounds. Each round's edges and minima are written to the shared
    folder, so a lost executor repeats one round at most and a hub's join can be split by the optimizer.
    Nodes without an edge (or only with themselves) are not returned.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e = stored(e, "cc", edges.count())
    seen = _digest(e)
    rows = 2 * seen[0]
    for _ in range(most_rounds):
        if seen[0] == 0:
            break
        old = e
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc", rows)
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        e = stored(e, "cc", rows)
        low2 = stored(e.groupBy("u").agg(F.min("v").alias("m")), "cc", rows)
        small = e.join(low2, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low2.select("u", F.col("m").alias("v")))
        nxt = stored(nxt.distinct(), "cc", rows)
        for x in (old, low, e, low2):
            drop_stored(x)
        e = nxt
        now = _digest(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixed point after {most_rounds} rounds")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(e.select("v", "v").distinct())


def _digest(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
