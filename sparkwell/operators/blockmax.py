"""An inverted index in segments of documents, with score bounds for blocks of documents.

A segment is one row: its documents in BLOCK-sized blocks, its sorted terms, and for each term an entry for every block that
holds it: where its postings lie, the largest frequency and the shortest document of the block. From these a block's score
for any query, any k1 and any b is bounded. Top k takes a query's blocks in the order of their bounds and stops where the
bound falls below the k-th best score so far, which a task carries from segment to segment. Similar documents (by their
least hashed term) are laid side by side, so that terms fall into few blocks.

Segments are made where the index's rows lie, without a shuffle, and have at most POSTINGS postings and DOCUMENTS documents
(or one document, however long); every segment can be searched on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Documents in a block; postings and documents in a segment.
BLOCK, POSTINGS, DOCUMENTS = 16, 1 << 19, 1 << 15
#: Blocks of the first step of a search; every further step takes four times as many.
FIRST_BLOCKS = 8

_NUMBERS = ("dl", "first", "at_block", "most_tf", "least_dl", "start", "slot", "tf")


def schema(id_type: str) -> str:
    return f"ids array<{id_type}>, terms array<string>, dfs array<int>, " + ", ".join(f"{n} binary" for n in _NUMBERS)


def _segment(rows: pa.Table) -> pa.RecordBatch:
    """One segment of (doc_id, dl, terms, tfs) rows."""
    rows = rows.combine_chunks()
    lists = rows["terms"].combine_chunks() if isinstance(rows["terms"], pa.ChunkedArray) else rows["terms"]
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()  # terms in their order
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    term = rank[coded.indices.to_numpy()]
    tf = rows["tfs"].combine_chunks().flatten().to_numpy().astype(np.int32)
    dl = rows["dl"].to_numpy().astype(np.int32)
    count = lists.value_lengths().to_numpy()
    doc = np.repeat(np.arange(len(dl)), count)

    least = np.full(len(dl), len(order))  # a random term of each document, the same for similar ones
    np.minimum.at(least, doc, np.random.default_rng(7).permutation(len(order))[term])
    by = np.lexsort((dl, least))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    dl, slot = dl[by], place[doc]

    o = np.lexsort((slot, term))
    term, slot, tf = term[o], slot[o], tf[o]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (slot[1:] // BLOCK != slot[:-1] // BLOCK)
    at = np.flatnonzero(new)  # an entry for each term and block
    bound = lambda f, x: f.reduceat(x, at) if len(at) else x[:0]
    number = {
        "dl": dl, "first": np.searchsorted(term[at], np.arange(len(order) + 1)), "at_block": slot[at] // BLOCK, "most_tf": bound(np.maximum, tf), "least_dl": bound(np.minimum, dl[slot]),
        "start": np.append(at, len(term)), "slot": slot, "tf": tf,
    }
    dfs = np.bincount(term, minlength=len(order)).astype(np.int32)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    ids = rows["doc_id"].combine_chunks().take(pa.array(by))
    return pa.RecordBatch.from_arrays([one(ids), one(coded.dictionary.take(pa.array(order))), one(pa.array(dfs)), *(pa.array([number[n].astype(np.int32).tobytes()], pa.binary()) for n in _NUMBERS)], ["ids", "terms", "dfs", *_NUMBERS])


def segments(docs: DataFrame) -> DataFrame:
    """Segments of index rows (doc_id, dl, terms, tfs), a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = m = 0
        for b in batches:
            count = b.column(2).value_lengths().to_numpy()
            start = 0
            while start < b.num_rows:  # as many rows as fit
                fit = int(np.searchsorted(np.cumsum(count[start:]), POSTINGS - n, "right"))
                fit = min(max(fit, 0 if held else 1), DOCUMENTS - m, b.num_rows - start)
                if fit:
                    held.append(b.slice(start, fit))
                    n, m, start = n + int(count[start : start + fit].sum()), m + fit, start + fit
                if start < b.num_rows:
                    yield _segment(pa.Table.from_batches(held))
                    held, n, m = [], 0, 0
        if held:
            yield _segment(pa.Table.from_batches(held))

    d = docs.select("doc_id", "dl", "terms", "tfs")
    return d.mapInArrow(run, schema(d.schema["doc_id"].dataType.simpleString()))


class Segment:
    """A segment's arrays, and the weights of its postings for given parameters."""

    def __init__(self, row: pa.RecordBatch, avgdl: float) -> None:
        name = lambda n: row.column(row.schema.get_field_index(n))
        self.ids, self.terms = name("ids").flatten(), name("terms").flatten()
        for n in _NUMBERS:
            setattr(self, n, np.frombuffer(name(n)[0].as_buffer(), np.int32))
        self.blocks = int(self.at_block.max(initial=-1)) + 1  # an index keeps the block size it was made with
        self.avgdl = avgdl

    def weight(self, tf: np.ndarray, dl: np.ndarray, k1: float, b: float) -> np.ndarray:
        tf = tf.astype(float)
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / self.avgdl))

    def postings(self, k1: float, b: float) -> np.ndarray:
        return self.weight(self.tf, self.dl[self.slot], k1, b)

    def bounds(self, k1: float, b: float) -> np.ndarray:
        """An upper bound of the weight of every posting of each entry: it grows with tf and falls with dl."""
        return self.weight(self.most_tf, self.least_dl, k1, b) if k1 >= 0 else np.full(len(self.most_tf), np.inf)


def spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of several ranges, and the range each belongs to."""
    n = end - start
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) + np.repeat(start - np.cumsum(n) + n, n), which


class Query:
    """A query's entries in a segment: (entry, weight of its term)."""

    def __init__(self, s: Segment, lists: np.ndarray, weight: np.ndarray) -> None:
        has = lists >= 0
        self.s = s
        self.entry, which = spans(s.first[lists[has]].astype(np.int64), s.first[lists[has] + 1].astype(np.int64))
        self.weight = weight[has][which]

    def scores(self, postings: list[np.ndarray], live: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Slots with a posting in the live blocks (or all), in order, and their sums for each set of posting weights."""
        s, e, w = self.s, self.entry, self.weight
        if live is not None:
            ok = live[s.at_block[e]]
            e, w = e[ok], w[ok]
        at, which = spans(s.start[e].astype(np.int64), s.start[e + 1].astype(np.int64))
        slot = s.slot[at]
        if len(slot) * 4 > len(s.dl):
            hit = np.flatnonzero(np.bincount(slot, minlength=len(s.dl)))
            code = np.empty(len(s.dl), np.int64)
            code[hit] = np.arange(len(hit))
            code = code[slot]
        else:
            hit, code = np.unique(slot, return_inverse=True)
        return hit, [np.bincount(code, w[which] * p[at], len(hit)) for p in postings]

    def best(self, k: int, least: float, margin: float, bounds: np.ndarray, postings: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Slots and scores of all that may be among the k best, given that least is reached already; blocks held and read."""
        s = self.s
        bound = np.bincount(s.at_block[self.entry], self.weight * bounds[self.entry], s.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        held, read, step = len(order), 0, FIRST_BLOCKS
        slots, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        top = np.zeros(0)
        while read < len(order):
            part = order[read : read + step]
            part = part[bound[part] * (1 + 1e-12) >= least]
            if not len(part):
                break
            live = np.zeros(s.blocks, bool)
            live[part] = True
            hit, (x,) = self.scores([postings], live)
            read += len(part)
            slots.append(hit)
            scores.append(x)
            top = np.append(top, x)
            if len(top) >= k:
                top = np.partition(top, len(top) - k)[-k:]
                least = max(least, float(top.min()) - margin)
            step *= 4
        slot, score = np.concatenate(slots), np.concatenate(scores)
        ok = (score >= least) & (score > 0)
        return slot[ok], score[ok], held, read
