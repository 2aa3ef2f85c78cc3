"""Language identification by language-bitmask n-gram filters.

Learning counts the 4-byte windows of lower-cased letters of every learned document by language, in whole texts. A window
belongs to the languages in which its rate is at least 1 / RATIO of its rate in the language that uses it most and at
least LEAST_RATE of the language's windows: rates, not counts, so a larger corpus gives the same filter, and a language has
at most 1 / LEAST_RATE windows in it. One
bit-sliced Bloom filter holds all of them: each cell is a mask with a bit for each language, and the AND of a window's
HASHES cells is the set of languages that contain it, found by one lookup whatever the number of languages. The filter has
2**CELL_BITS cells however large the corpus is; what it gets wrong follows from its fill, language by language.

Prediction counts each language's bits over a document's windows. With n windows, h hits and a false-positive rate f, the
corrected share is (h / n - f) / (1 - f). The largest share decides; the score is its part of all shares. The largest
share itself and the number of windows are given as ``known`` and ``windows``.

At most MOST_LANGUAGES languages are learned (their masks take 8 MB for each 64); more raise an error.

Defined results: a text that is null or has no letter is ``und`` with score 0; a text with letters but no known window
gets the most frequent learned language with its share of learned documents; without any learned document every text is
``und``; a null doc_id is kept (and not learned from, where the caller's rule for learning is null); rows repeat as they
come; clashing extra columns are ignored; empty tables give no row; ties go to the smaller language name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, kept, mix

CELL_BITS = 20
HASHES = 2
RATIO = 4
LEAST_RATE = 1e-5
MOST_LANGUAGES = 4096
UNKNOWN = "und"
OWN = ("lang_pred", "score", "known", "windows")
CHUNK = 1 << 18

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def windows(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges, with their windows as uint32 and each row's first window.

    A window is 4 bytes; its inner two must be letters, so it covers word ends. Other bytes count as one separator.
    """
    i = 0
    lowered = [t.lower().encode() if t else b"" for t in texts]
    while i < len(lowered):
        j, size = i, 0
        while j < len(lowered) and (j == i or size + len(lowered[j]) + 2 <= CHUNK):
            size += len(lowered[j]) + 2
            j += 1
        raw = np.frombuffer(b" " + b"  ".join(lowered[i:j]) + b" ", np.uint8)
        length = np.array([len(x) + 2 for x in lowered[i:j]])
        ok = _LETTER[raw]
        b = np.where(ok, raw, 32).astype(np.uint32)
        if len(b) >= 4:
            keep = ok[1:-2] & ok[2:-1]
            w = (b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24)[keep]
            at = np.flatnonzero(keep)
        else:
            w, at = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        yield i, j, w, np.searchsorted(at, np.cumsum(length) - length)
        i = j


def cells(w: np.ndarray) -> list[np.ndarray]:
    """The filter cells of windows, one array for each hash."""
    h = mix(w.astype(np.uint64) + np.uint64(0x51ED27))
    return [((h >> np.uint64(i * CELL_BITS)) & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class LanguageModel:
    languages: list[str]
    share: list[float]  # of learned documents
    filters: np.ndarray  # words x cells, uint64

    def __post_init__(self) -> None:
        fill = [((self.filters[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        self.wrong = np.array(fill) ** HASHES

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], np.ndarray, np.ndarray]:
        """Languages, scores, the largest corrected shares and the numbers of windows."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        largest, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if not self.languages:
            return names, scores, largest, size
        common = max(range(len(self.languages)), key=lambda i: (self.share[i], -i))
        for i, j, w, first in windows([t or "" for t in texts]):
            at = cells(w)
            bound = np.append(first, len(w))
            hits = np.zeros((len(self.languages), j - i))
            for word, f in enumerate(self.filters):
                m = f[at[0]]
                for c in at[1:]:
                    m &= f[c]
                for bit in range(min(64, len(self.languages) - 64 * word)):
                    total = np.concatenate([[0], np.cumsum((m >> np.uint64(bit)).astype(np.uint8) & 1, dtype=np.int64)])
                    hits[64 * word + bit] = total[bound[1:]] - total[bound[:-1]]
            n = np.diff(bound)
            share = np.maximum(0, (hits / np.maximum(1, n) - self.wrong[:, None]) / np.maximum(1e-9, 1 - self.wrong[:, None]))
            best, total = share.argmax(axis=0), share.sum(axis=0)
            largest[i:j], size[i:j] = share.max(axis=0), n
            for r in range(i, j):
                t = texts[r]
                if not t or not any(map(str.isalpha, t)):  # Unicode's letters alone, no digits of any kind
                    continue
                k = r - i
                known = total[k] > 0
                names[r] = self.languages[best[k] if known else common]
                scores[r] = float(share[best[k], k] / total[k]) if known else float(self.share[common])
        return names, scores, largest, size


def learn(spark: SparkSession, docs: DataFrame, learned: Column, text: str = "text", lang: str = "lang") -> LanguageModel:
    """The model of all documents for which learned holds and lang and text are not null."""
    bounded_batches(spark)
    d = docs.where(learned & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        docs_of: dict[str, int] = {}

        def merged(parts: list) -> list:
            w = np.concatenate([p[0] for p in parts])
            n = np.concatenate([p[1] for p in parts])
            u, inverse = np.unique(w, return_inverse=True)
            return [(u, np.bincount(inverse, n, len(u)).astype(np.int64))]

        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            by: dict[str, list[str]] = {}
            for name, t in zip(langs, texts, strict=True):
                by.setdefault(name, []).append(t)
            for name, ts in by.items():
                docs_of[name] = docs_of.get(name, 0) + len(ts)
                parts = held.setdefault(name, [])
                for *_, w, _first in windows(ts):
                    parts.append(np.unique(w, return_counts=True))
                if sum(len(p[0]) for p in parts[1:]) > 1_000_000:
                    held[name] = merged(parts)
        for name, parts in held.items():
            ((u, n),) = merged(parts)
            for s in range(0, len(u), 50_000):
                k = len(u[s : s + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([name] * k, pa.string()), pa.array(u[s : s + 50_000].astype(np.int64)), pa.array(n[s : s + 50_000])], ["lang", "w", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([-1], pa.int64()), pa.array([docs_of[name]], pa.int64())], ["lang", "w", "n"])

    counts = d.mapInArrow(count, "lang string, w long, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    counts = kept(counts)
    totals = counts.groupBy("lang").agg(F.sum(F.when(F.col("w") < 0, F.col("n"))).alias("docs"), F.sum(F.when(F.col("w") >= 0, F.col("n"))).alias("windows"))
    rows = sorted(totals.limit(MOST_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = [r["lang"] for r in rows]
    every = sum(r["docs"] for r in rows)
    words = -(-len(languages) // 64)
    filters = np.zeros((words, 1 << CELL_BITS), np.uint64)
    if languages:
        number = spark.createDataFrame([(r["lang"], i, float(r["windows"] or 0)) for i, r in enumerate(rows)], "lang string, i int, windows double")
        rate = counts.where("w >= 0").join(F.broadcast(number), "lang")  # at most MOST_LANGUAGES rows
        rate = rate.select("w", "i", (F.col("n") / F.col("windows")).alias("rate"))
        by = rate.groupBy("w").agg(F.max("rate").alias("top"), F.collect_list(F.struct("i", "rate")).alias("in"))
        member = by.select("w", "top", F.explode("in").alias("x")).where(f"x.rate * {RATIO} >= top and x.rate >= {LEAST_RATE}").select("w", "x.i")

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                i = b.column(1).to_numpy()
                for at in cells(b.column(0).to_numpy().astype(np.uint32)):
                    yield pa.RecordBatch.from_arrays([pa.array((i // 64).astype(np.int32)), pa.array(at), pa.array((np.uint64(1) << (i % 64).astype(np.uint64)).view(np.int64))], ["word", "cell", "mask"])

        for r in member.mapInArrow(put, "word int, cell long, mask long").groupBy("word", "cell").agg(F.expr("bit_or(mask)").alias("mask")).toLocalIterator():
            filters[r["word"], r["cell"]] = np.int64(r["mask"]).view(np.uint64)  # at most words * 2**CELL_BITS rows
    counts.unpersist()
    return LanguageModel(languages, [r["docs"] / every for r in rows], filters)


def identify(spark: SparkSession, docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """docs' columns named in keep, with OWN: lang_pred, score, known and windows."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)
    own = [c for c in keep if c not in OWN]
    shape = docs.select(*own).schema.add("lang_pred", "string").add("score", "double").add("known", "double").add("windows", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, *numbers = held.value.predict(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(names, pa.string()), pa.array(numbers[0], pa.float64()), *map(pa.array, numbers[1:])], [*own, *OWN])

    return docs.select(F.col(text).alias("__text"), *own).mapInArrow(run, shape)
