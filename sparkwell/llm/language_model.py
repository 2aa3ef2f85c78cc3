"""Scoring documents with a gated recurrent language model.

Tokens are words (A-Z lower-cased) and one end for each document. Counts cover all learned documents: each task
counts its words, and one shuffle sums them. The most frequent words form a dictionary of at most DICTIONARY entries,
which is broadcast; every other word's count is found by a join on its hash, where no key can be hot.

The output softmax is factored by classes. The HEAD most frequent tokens fill classes of CLASS_WORDS words; every
other word belongs to one of TAIL_CLASSES by its last two bytes. The recurrent state gives the class and, for head
words, the word inside it; inside a tail class a word has (count + 1) / (sum of counts + words + 1), which leaves room
for one unknown word. So all outcomes sum to one.

The gated recurrent unit is trained in numpy by truncated backpropagation: the learned documents of a partition lie end to
end in parallel rows, which advance window after window. The state goes on through a document's windows, the gradient
stops at a window. Each round every partition trains a copy on its own documents, and a tree of sums averages the copies,
weighted by tokens. The rounds together train on every token of the learned documents. The first parameters already give
the classes' unigram model.

Scoring carries the state across windows from a document's first token to its end, so long texts are scored whole.

Defined results: null text is empty and scores its end alone; a null doc_id counts as not held out; rows repeat as they
come; extra columns are ignored; an empty table gives no row; without learned documents every count is 0.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, stored, text_chunks, words_of

DICTIONARY = 1 << 18
HEAD = 2048
CLASS_WORDS = 64
TAIL_CLASSES = 64
HIDDEN = 16
WINDOW = 32
BATCH = 384
LEAST_ROW = 128
TRAIN_TOKENS = 1 << 20
CHUNK = 1024
WINDOW_TOKENS = 1 << 17
ROUNDS = 2
RATES = (0.02, 0.006)
FAN_IN = 16
END_HASH = 0
SCORE_TOKENS = 8_000_000
HEAD_CLASSES = HEAD // CLASS_WORDS
CLASSES = HEAD_CLASSES + TAIL_CLASSES

Params = dict[str, np.ndarray]

# ------------------------------------------------------------------ tokens

_lower = np.arange(256, dtype=np.uint32)
_lower[65:91] += 32


def tokens(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges with word hashes (int64), tail classes and each row's first word; ends are not included."""
    for i, j, data, off in text_chunks(col):
        s, e, h, first = words_of(data, off)
        if len(s):
            a = _lower[data[e - 1]]
            b = np.where(e - s > 1, _lower[data[np.maximum(e - 2, 0)]], 0)
            tail = ((a * np.uint32(2654435761) + b * np.uint32(40503)) >> np.uint32(16)) % np.uint32(TAIL_CLASSES)
        else:
            tail = np.zeros(0, np.uint32)
        yield i, j, h.view(np.int64), tail.astype(np.int16), first


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, tail, n) of all tokens of docs; the end is word END_HASH."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        fresh, ends = 0, 0

        def merged() -> tuple:
            w, t, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, at, inverse = np.unique(w, return_index=True, return_inverse=True)
            return u, t[at], np.bincount(inverse, n, len(u)).astype(np.int64)

        for b in batches:
            for i, j, h, tail, _ in tokens(b.column(0)):
                ends += j - i
                u, at, n = np.unique(h, return_index=True, return_counts=True)
                held.append((u, tail[at], n))
                fresh += len(u)
                if fresh > 1_500_000:
                    held[:] = [merged()]
                    fresh = 0
        if ends:
            held.append((np.array([END_HASH]), np.array([-1], np.int16), np.array([ends])))
            u, t, n = merged()
            for s in range(0, len(u), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[s : s + 50_000]), pa.array(t[s : s + 50_000]), pa.array(n[s : s + 50_000])], ["word", "tail", "n"])

    rows = docs.select(text).mapInArrow(run, "word long, tail short, n long")
    return rows.groupBy("word").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


class Vocabulary:
    """Sizes, the dictionary (sorted by hash), the head and the tail classes' totals."""

    def __init__(self, total: int, distinct: int, words: np.ndarray, tails: np.ndarray, counts: np.ndarray, tail_totals: dict[int, int]) -> None:
        self.total, self.distinct = total, distinct
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        tails = tails[order]
        self.mask = (1 << max(8, (4 * len(words)).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)  # an open hash table of indices
        left, slot = np.arange(len(words)), self.words & self.mask
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            more = self.slots[slot] != left
            left, slot = left[more], (slot[more] + 1) & self.mask
        rank = np.lexsort((self.words, -self.counts, self.words != END_HASH))[:HEAD]  # the end first
        self.head = np.full(len(self.words), -1, np.int16)
        self.head[rank] = np.arange(len(rank))
        self.head_counts = np.zeros(HEAD, np.int64)
        self.head_counts[: len(rank)] = self.counts[rank]
        z = np.ones(TAIL_CLASSES)  # the unknown word
        for t, n in tail_totals.items():
            z[t] += n
        inside = rank[tails[rank] >= 0]
        np.subtract.at(z, tails[inside], self.counts[inside] + 1.0)
        self.tail_z = z
        self.log_counts = np.log10(self.counts + 1.0)
        self.unit = math.log10(total + distinct + 1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index in the dictionary, and whether it is there."""
        if not len(self.words):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        slot = h & self.mask
        at = self.slots[slot]
        known = (self.words[at] == h) & (at >= 0)
        open_ = np.flatnonzero((at >= 0) & ~known)
        while len(open_):  # another word's slot: look in the next one
            slot[open_] = (slot[open_] + 1) & self.mask
            here = at[open_] = self.slots[slot[open_]]
            known[open_] = (here >= 0) & (self.words[here] == h[open_])
            open_ = open_[(here >= 0) & ~known[open_]]
        return np.maximum(at, 0), known

    def inputs(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input ids (head words, then tail classes), dictionary index and whether it is there."""
        at, known = self.find(h)
        head = np.where(known, self.head[at], -1) if len(self.words) else np.full(len(h), -1)
        return np.where(head >= 0, head, HEAD + tail).astype(np.int16), at, known


def vocabulary(counts: DataFrame) -> Vocabulary:
    t = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    # the counts' histogram on a log scale, of at most a few thousand rows, gives the dictionary's least count
    step = F.floor(F.log2("n") * 64).cast("int")
    bins = sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"])
    least, size = None, 0
    for r in bins:
        size += r["count"]
        if size > DICTIONARY:
            break
        least = r["s"]
    frequent = F.lit(False) if least is None else step >= least
    rows = counts.where(frequent | (F.col("word") == END_HASH)).toLocalIterator()  # DICTIONARY and the end at most
    words, tails, n = [], [], []
    for r in rows:
        words.append(r["word"]), tails.append(r["tail"]), n.append(r["n"])
    z = {r["tail"]: r["z"] for r in counts.where("tail >= 0").groupBy("tail").agg(F.sum(F.col("n") + 1).alias("z")).collect()}
    return Vocabulary(t["total"] or 0, t["distinct"], np.array(words, np.int64), np.array(tails, np.int16), np.array(n, np.int64), z)


# ------------------------------------------------------------------ the network
#
# Arrays of the three gates (z, r, n) have the gate as first axis, so that each gate's part is contiguous. States come
# with a last column of ones, which carries the biases. The sigmoid gates are ``(1 + tanh(a)) / 2``.


def initial(v: Vocabulary) -> Params:
    """Small random weights, with biases that give the unigram model of classes and words."""
    rng = np.random.default_rng(7)
    h = HIDDEN
    c = v.head_counts.reshape(HEAD_CLASSES, CLASS_WORDS).astype(np.float64)
    mass = np.concatenate([c.sum(axis=1), v.tail_z])
    p = {"x": rng.normal(0, 0.3, (3, HEAD + TAIL_CLASSES, h)), "u": rng.normal(0, 0.3, (3, h + 1, h)), "c": np.zeros((CLASSES, h + 1)), "w": np.zeros((HEAD, h + 1))}
    p["u"][:, -1] = 0
    for gate in (p["x"][:2], p["u"][:2]):
        gate /= 2
    p["u"][0, -1] = 0.5  # remember at first
    p["c"][:, -1] = np.where(mass > 0, np.log(np.maximum(mass, 1e-9)), -1e4)
    p["w"][:, -1] = np.where(v.head_counts > 0, np.log(np.maximum(v.head_counts, 1)), -1e4)
    return {k: x.astype(np.float32) for k, x in p.items()}


def step(u: np.ndarray, s: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """z, r, q, n and the next state; s: states with a column of ones, x: the tokens' rows of the three gates."""
    a = np.matmul(s, u)
    zr = a[:2]
    zr += x[:2]
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    z, r, q = a
    n = r * q
    n += x[2]
    np.tanh(n, out=n)
    new = s[:, :-1] - n
    new *= z
    new += n
    return z, r, q, n, new


def targets(token: np.ndarray) -> np.ndarray:
    """The class of each input id."""
    return np.where(token < HEAD, token // CLASS_WORDS, HEAD_CLASSES + token - HEAD)


def shifted(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output weights whose biases are lowered by a bound of all logits (states lie in -1..1), transposed, and a column of ones."""
    w = w.copy()
    w[:, -1] -= (w[:, -1] + np.abs(w[:, :-1]).sum(axis=1)).max()
    return np.ascontiguousarray(w.T), np.ones(len(w), w.dtype)


def soft(s: np.ndarray, w: np.ndarray, one: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of the logits, their sums by row, and ln of the right ones' probability."""
    e = s @ w
    got = e[np.arange(len(e)), right]
    np.exp(e, out=e)
    total = e @ one
    if total.min() < 1e-25:  # the bound was far above some row's logits
        e = s @ w
        m = e.max(axis=1)
        got -= m
        e = np.exp(e - m[:, None])
        total = e @ one
    return e, total, got - np.log(total)


def spans(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Head classes that occur in sorted ids, with their rows in pieces."""
    bound = np.searchsorted(ids, np.arange(HEAD_CLASSES + 1) * CLASS_WORDS)
    return [(c, a, min(a + 4 * CHUNK, bound[c + 1])) for c in range(HEAD_CLASSES) for a in range(bound[c], bound[c + 1], 4 * CHUNK)]


def log_probability(p: Params, s: np.ndarray, token: np.ndarray) -> np.ndarray:
    """ln of the class and, for head words, of the word inside it, from the states (with ones) before each token."""
    order = np.argsort(token, kind="stable")
    ids, s = token[order].astype(np.int64), s.take(order, axis=0)
    cls, got = targets(ids), np.empty(len(ids))
    w = shifted(p["c"])
    for a in range(0, len(ids), CHUNK):
        got[a : a + CHUNK] = soft(s[a : a + CHUNK], *w, cls[a : a + CHUNK])[2]
    for c, a, b in spans(ids):
        got[a:b] += soft(s[a:b], *shifted(p["w"][c * CLASS_WORDS : (c + 1) * CLASS_WORDS]), ids[a:b] - c * CLASS_WORDS)[2]
    out = np.empty(len(ids))
    out[order] = got
    return out


def document_scores(p: Params, docs: list[np.ndarray], window: int = CHUNK) -> np.ndarray:
    """ln probability of each whole document (input ids), the state carried across windows.

    Documents go on together, the longest first; a window has as many steps as keep its tokens near WINDOW_TOKENS.
    """
    length = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-length, kind="stable")
    flat = np.concatenate([docs[i] for i in order]) if docs else np.zeros(0, np.int16)
    length = length[order]
    start = np.cumsum(length) - length
    out = np.zeros(len(docs))
    h = np.zeros((len(docs), HIDDEN), np.float32)
    t0, end = 0, int(length[0]) if len(docs) else 0
    while t0 < end:
        m = int(np.searchsorted(-length, -t0, "left"))  # documents longer than t0
        steps = max(1, min(window, WINDOW_TOKENS // m, end - t0))
        at = t0 + np.arange(steps)[:, None]
        live = at < length[:m]
        tok = flat[np.minimum(start[:m] + at, len(flat) - 1)]
        s = np.ones((steps, m, HIDDEN + 1), np.float32)
        now, few = h[:m], m < 64
        x = p["x"].take(tok, axis=1) if few else None
        for t in range(steps):
            s[t, :, :-1] = now
            now = step(p["u"], s[t], x[:, t] if few else p["x"].take(tok[t], axis=1))[-1]
        h[:m] = now
        got = np.zeros((steps, m))
        got[live] = log_probability(p, s[live], tok[live])
        out[:m] += got.sum(axis=0)
        t0 += steps
    result = np.empty(len(docs))
    result[order] = out
    return result


def gradients(p: Params, h: np.ndarray, token: np.ndarray, fresh: np.ndarray) -> tuple[Params, float, int, np.ndarray]:
    """Gradients of the window's mean negative ln probability, its sum, its tokens, and the last state.

    token: steps x rows, -1 where there is none; fresh: where a document begins, from a state of zeros.
    """
    k, (steps, rows) = HIDDEN, token.shape
    kind = p["u"].dtype
    s, saved = np.ones((steps, rows, k + 1), kind), []
    for t in range(steps):
        h[fresh[t]] = 0
        s[t, :, :k] = h
        *gates, h = step(p["u"], s[t], p["x"].take(token[t], axis=1))
        saved.append(gates)
    g = {name: np.zeros_like(x) for name, x in p.items()}
    order = np.argsort(token.ravel(), kind="stable")
    ids = token.ravel()[order].astype(np.int64)
    dead = int(np.searchsorted(ids, 0))
    order, ids = order[dead:], ids[dead:]
    total, loss = len(ids), 0.0
    if not total:
        return g, loss, 0, h
    cls, so, ds = targets(ids), s.reshape(-1, k + 1).take(order, axis=0), np.empty((total, k + 1), kind)
    w = shifted(p["c"])
    for a in range(0, total, CHUNK):
        b = slice(a, a + CHUNK)
        e, z, got = soft(so[b], *w, cls[b])
        loss -= float(got.sum())
        e[np.arange(len(e)), cls[b]] -= z
        z = (1 / (z * total))[:, None]
        np.multiply(e @ p["c"], z, out=ds[b])
        g["c"] += e.T @ (so[b] * z)
    pieces = spans(ids)
    for c, a, b in pieces:
        w = slice(c * CLASS_WORDS, (c + 1) * CLASS_WORDS)
        right = ids[a:b] - c * CLASS_WORDS
        e, z, got = soft(so[a:b], *shifted(p["w"][w]), right)
        loss -= float(got.sum())
        e[np.arange(len(e)), right] -= z
        z = (1 / (z * total))[:, None]
        ds[a:b] += (e @ p["w"][w]) * z
        g["w"][w] += e.T @ (so[a:b] * z)
    out = np.zeros((steps * rows, k), kind)
    out[order] = ds[:, :k]
    out = out.reshape(steps, rows, k)
    dh, da, dx = np.zeros((rows, k), kind), np.empty((3, steps, rows, k), kind), np.empty((steps, rows, k), kind)
    back = np.ascontiguousarray(p["u"][:, :k].transpose(0, 2, 1))
    for t in range(steps - 1, -1, -1):
        z, r, q, n = saved[t]
        dn = dx[t]
        np.multiply(n, n, out=dn)
        np.subtract(1, dn, out=dn)
        dn *= dh
        dn *= 1 - z
        dz, dr, dq = da[:, t]
        np.subtract(s[t, :, :k], n, out=dz)
        dz *= dh
        dz *= z * (1 - z)
        np.multiply(dn, q, out=dr)
        dr *= r * (1 - r)
        da[:2, t] *= 2
        np.multiply(dn, r, out=dq)
        dh *= z
        dh += np.matmul(da[:, t], back).sum(axis=0)
        dh += out[t]
        dh[fresh[t]] = 0
    np.matmul(s.reshape(-1, k + 1).T, da.reshape(3, -1, k), out=g["u"])
    dx = np.concatenate([da[0], da[1], dx], axis=2).reshape(-1, 3 * k).take(order, axis=0)
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    g["x"][:, ids[first]] = np.add.reduceat(dx, first, axis=0).reshape(-1, 3, k).transpose(1, 0, 2)
    return g, loss, total, h


class Adam:
    def __init__(self, p: Params, rate: float) -> None:
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(x) for k, x in p.items()}
        self.v = {k: np.zeros_like(x) for k, x in p.items()}

    def apply(self, g: Params) -> None:
        self.t += 1
        norm = math.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-12))
        rate = self.rate * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            x *= scale
            m, v = self.m[k], self.v[k]
            m *= 0.9
            m += 0.1 * x
            v *= 0.999
            x *= x
            x *= 0.001
            v += x
            np.sqrt(v, out=x)
            x += 1e-7
            np.divide(m, x, out=x)
            x *= rate
            self.p[k] -= x


def train_batch(adam: Adam, docs: list[np.ndarray]) -> int:
    """Train on every token of the documents, which are dealt over at most BATCH parallel rows end to end.

    Each row goes window after window; the state goes on through windows and documents' parts, the gradient stops at a
    window. A document begins with a state of zeros, and so does the rest of one that the end of a row cuts.
    """
    flat = np.concatenate(docs)
    n = len(flat)
    rows = max(1, min(BATCH, n // LEAST_ROW))
    length = -(-n // rows)
    token = np.full(rows * length, -1, np.int16)
    token[:n] = flat
    fresh = np.zeros(rows * length, bool)
    fresh[np.cumsum([0, *map(len, docs[:-1])])] = True
    token, fresh = (np.ascontiguousarray(x.reshape(rows, length).T) for x in (token, fresh))
    h, done = np.zeros((rows, HIDDEN), np.float32), 0
    for w in range(0, length, WINDOW):
        g, _, total, h = gradients(adam.p, h, token[w : w + WINDOW], fresh[w : w + WINDOW])
        if total:
            adam.apply(g)
        done += total
    return done


# ------------------------------------------------------------------ Spark jobs


def _dump(p: Params) -> bytes:
    return pickle.dumps({k: x.astype(np.float32) for k, x in p.items()})


def train_round(encoded: DataFrame, params: Params, turn: int) -> Params:
    """Each partition trains a copy of params on its segments; the copies' average, weighted by tokens.

    encoded: (ids) of the learned documents. Every ROUNDS-th document of a partition is this round's, so that the rounds
    together train on every token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, done, waiting, size = TaskContext.get().partitionId(), turn, 0, [], 0
        adam = Adam({k: x.copy() for k, x in params.items()}, RATES[min(turn, len(RATES) - 1)])
        for b in batches:
            for ids in b.column(0).filter(pa.array(np.arange(number, number + b.num_rows) % ROUNDS == 0)):
                waiting.append(np.frombuffer(ids.as_buffer(), np.int16))
                size += len(waiting[-1])
                if size >= TRAIN_TOKENS:
                    done += train_batch(adam, waiting)
                    waiting, size = [], 0
            number += b.num_rows
        if size:
            done += train_batch(adam, waiting)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([float(done)]), pa.array([_dump({k: x * done for k, x in adam.p.items()})], pa.binary())], ["part", "weight", "params"])

    def merge(t: pa.Table) -> pa.Table:
        out: Params = {}
        for x in t["params"]:
            for k, y in pickle.loads(x.as_py()).items():
                out[k] = out[k] + y if k in out else y.astype(np.float64)
        return pa.table({"part": pa.array([t["part"][0].as_py() // FAN_IN], pa.int64()), "weight": pa.array([float(sum(t["weight"].to_pylist()))]), "params": pa.array([_dump(out)], pa.binary())})

    shape = "part long, weight double, params binary"
    level, parts = encoded.mapInArrow(run, shape), max(1, encoded.rdd.getNumPartitions())
    while parts > 1:
        level = level.groupBy((F.col("part") / FAN_IN).cast("long").alias("up")).applyInArrow(merge, shape)
        parts = -(-parts // FAN_IN)
    rows = level.collect()  # one row
    if not rows:
        return params
    return {k: (x / rows[0]["weight"]).astype(np.float32) for k, x in pickle.loads(rows[0]["params"]).items()}


def encode_documents(docs: DataFrame, held, out: Column, id_col: str, text: str) -> DataFrame:
    """A row per document: input ids (int16, the end included), known terms of both scores, and the hashes of words outside the dictionary."""
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "extra", "rare", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, v = TaskContext.get().partitionId() << 40, held.value
        tail_log = np.log10(v.tail_z)
        end_at, end_known = v.find(np.array([END_HASH]))
        end_log = float(v.log_counts[end_at[0]]) if end_known[0] else 0.0
        for b in batches:
            for i, j, h, tail, first in tokens(b.column(2)):
                inp, at, here = v.inputs(h, tail)
                logs = np.where(here, v.log_counts[at] if len(v.words) else 0.0, 0.0)
                inside = np.where(inp >= HEAD, logs - tail_log[tail], 0.0)  # (count + 1) / z; the count of a rare word comes later
                n = np.diff(first)
                upto = lambda x: np.concatenate([[0.0], np.cumsum(x)])
                part = lambda x: upto(x)[first[1:]] - upto(x)[first[:-1]]
                spots = np.insert(inp, first[1:], 0)  # the end is input 0
                ends = np.append(0, np.cumsum(2 * (n + 1))).astype(np.int64)
                missing = np.flatnonzero(~here)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + j - i)), b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n + 1), pa.array(np.rint(part(here)).astype(np.int64) + int(end_known[0])), pa.array(part(logs) + end_log - (n + 1) * v.unit), pa.array(part(inside)),
                     pa.ListArray.from_arrays(pa.array(np.searchsorted(missing, first), pa.int32()), pa.array(h[missing])),
                     pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(spots.astype(np.int16).tobytes())]).cast(pa.binary())], names)
                row += j - i

    return docs.select(F.col(id_col).cast("long"), out, text).mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, extra double, rare array<long>, ids binary")


def score_documents(encoded: DataFrame, params: Params) -> DataFrame:
    """encoded without ids, with score: the log10 probability but for the counts of words outside the dictionary."""
    own = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "extra"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            score = document_scores(params, [np.frombuffer(x.as_py(), np.int16) for x in rows.column(len(own))]) / math.log(10)
            return pa.RecordBatch.from_arrays([*rows.columns[: len(own)], pa.array(score + rows.column(len(own) - 1).to_numpy())], [*own, "score"])

        size = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += pa.compute.sum(b.column(3)).as_py()
            if size >= SCORE_TOKENS:
                yield flush()
                size = 0
        if held:
            yield flush()

    return encoded.select(*own, "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, extra double, score double")


def lm_scores(spark: SparkSession, docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; log10 scores.

    Documents where held_out holds are not learned from.
    """
    bounded_batches(spark)
    out = F.coalesce(held_out, F.lit(False))
    counts = stored(count_words(docs.where(~out).select(text), text), "counts")
    v = vocabulary(counts)
    held = spark.sparkContext.broadcast(v)
    encoded = stored(encode_documents(docs, held, out, id_col, text), "encoded")
    params = initial(v)
    for turn in range(ROUNDS):
        params = train_round(encoded.where("not held_out").select("ids"), params, turn)
    rows = stored(score_documents(encoded, params), "scores")
    rare = encoded.select("row", F.explode("rare").alias("word")).join(counts.select("word", "n"), "word")
    more = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count("*").alias("found"))
    r = rows.join(more, "row", "left")
    more, found = F.coalesce("more", F.lit(0.0)), F.coalesce("found", F.lit(0))
    return r.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + found).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))
