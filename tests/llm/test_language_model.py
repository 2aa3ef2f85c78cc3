"""The recurrent language model: gradients, probabilities that sum to one, base scores, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import sparkwell.llm.language_model as m
from sparkwell.llm.language_model import document_scores, gradients, initial, lm_scores, log_probability

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_vocabulary():
    n = np.array([50, 40, 30, 20, 10, 5], np.int64)
    return m.Vocabulary(int(n.sum()), 6, np.array([m.END_HASH, 11, -5, 7, 99, 3]), np.array([-1, 0, 1, 2, 3, 3], np.int16), n, {0: 41, 1: 31, 2: 21, 3: 17})


def test_gradients_match_finite_differences():
    p = {k: x.astype(np.float64) for k, x in initial(small_vocabulary()).items()}
    rng = np.random.default_rng(0)
    for x in p.values():
        x += np.where(np.abs(x) < 100, rng.normal(0, 0.2, x.shape), 0)
    token = np.array([[0, 1, m.HEAD + 3, 5, -1], [2, m.HEAD + 1, 0, -1, -1], [3, 4, 1, 1, 0]]).T
    fresh = np.zeros(token.shape, bool)
    fresh[0, 1] = fresh[2, 2] = True
    h = rng.normal(0, 0.3, (3, m.HIDDEN))

    def loss(q):
        _, total, n, _ = gradients(q, h.copy(), token, fresh)
        return total / n

    g, *_ = gradients(p, h.copy(), token, fresh)
    for name, at in (("x", (0, 1, 3)), ("x", (2, m.HEAD + 3, 4)), ("x", (1, 0, 9)), ("u", (0, 2, 5)), ("u", (1, 1, 4)), ("u", (2, 3, 4)), ("u", (2, m.HIDDEN, 2)), ("c", (0, 1)), ("c", (m.HEAD_CLASSES + 1, m.HIDDEN)), ("w", (3, 2)), ("w", (1, m.HIDDEN))):
        old = p[name][at]
        p[name][at] = old + 1e-5
        up = loss(p)
        p[name][at] = old - 1e-5
        down = loss(p)
        p[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 2e-5, (name, at)


def test_probabilities_sum_to_one():
    v = small_vocabulary()
    p = initial(v)
    s = np.append(np.random.default_rng(1).uniform(-1, 1, (1, m.HIDDEN)), [[1]], axis=1).astype(np.float32)
    ids = np.concatenate([np.arange(6), m.HEAD + np.arange(m.TAIL_CLASSES)]).astype(np.int16)
    total = np.exp(log_probability(p, np.repeat(s, len(ids), 0), ids)).sum()
    assert abs(total - 1) < 1e-4  # tail classes divide their part among their words and one unknown word


def shaken():
    """Parameters that differ from the first ones everywhere."""
    p, rng = initial(small_vocabulary()), np.random.default_rng(2)
    for x in p.values():
        x += np.where(np.abs(x) < 100, rng.normal(0, 0.5, x.shape), 0).astype(np.float32)
    return p


def test_state_is_carried_over_windows():
    p, rng = shaken(), np.random.default_rng(3)
    docs = [rng.integers(0, 6, n).astype(np.int16) for n in (1, 7, 200, 64, 65, 3)]
    assert np.allclose(document_scores(p, docs, 64), document_scores(p, docs, 1000), atol=1e-3)
    assert np.allclose(document_scores(p, docs)[2], document_scores(p, [docs[2]])[0], atol=1e-3)


def scalar_score(p, doc):
    """One document, unit by unit and word by word, in Python floats."""
    x, u, c, w = (p[k].astype(float).tolist() for k in ("x", "u", "c", "w"))
    h, total, units = [0.0] * m.HIDDEN, 0.0, range(m.HIDDEN)
    sigmoid = lambda a: 1 / (1 + math.exp(-2 * a))
    dot = lambda row: sum(a * b for a, b in zip(row, [*h, 1.0], strict=True))

    def ln_share(rows, at):
        logits = [dot(r) for r in rows]
        top = max(logits)
        return logits[at] - top - math.log(sum(math.exp(v - top) for v in logits))

    for t in map(int, doc):
        cls = t // m.CLASS_WORDS if t < m.HEAD else m.HEAD_CLASSES + t - m.HEAD
        total += ln_share(c, cls)
        if t < m.HEAD:
            total += ln_share(w[cls * m.CLASS_WORDS : (cls + 1) * m.CLASS_WORDS], t % m.CLASS_WORDS)
        into = [[dot([u[g][i][j] for i in range(m.HIDDEN + 1)]) for j in units] for g in range(3)]
        z = [sigmoid(into[0][j] + x[0][t][j]) for j in units]
        r = [sigmoid(into[1][j] + x[1][t][j]) for j in units]
        n = [math.tanh(r[j] * into[2][j] + x[2][t][j]) for j in units]
        h = [z[j] * h[j] + (1 - z[j]) * n[j] for j in units]
    return total


def test_scores_match_a_scalar_network():
    p, rng = shaken(), np.random.default_rng(5)
    ids = np.concatenate([np.arange(6), m.HEAD + np.arange(m.TAIL_CLASSES)])
    docs = [rng.choice(ids, n).astype(np.int16) for n in (1, 2, 30, 150)]
    for got, doc in zip(document_scores(p, docs, 7), docs, strict=True):
        assert abs(got - scalar_score(p, doc)) < 1e-4 * len(doc) + 1e-3


def test_training_reads_every_token_and_learns():
    """Words that follow each other in a fixed order: the first parameters give their frequencies only."""
    v = small_vocabulary()
    docs = [np.array([1, 2, 3, 4] * 50 + [0], np.int16) for _ in range(200)] + [np.array([0], np.int16)]
    adam = m.Adam({k: x.copy() for k, x in initial(v).items()}, 0.02)
    tokens = sum(map(len, docs))
    assert all(m.train_batch(adam, docs) == tokens for _ in range(3))
    before, after = (document_scores(p, docs).sum() / tokens for p in (initial(v), adam.p))
    assert after > before + 0.8  # ln 4 = 1.39 at most


def test_find():
    rng = np.random.default_rng(4)
    words = rng.integers(-(2**62), 2**62, 5000) << 6  # many words of one slot
    v = m.Vocabulary(5000, 5000, words, np.zeros(5000, np.int16), np.ones(5000, np.int64), {0: 10000})
    at, known = v.find(words)
    assert known.all() and (v.words[at] == words).all()
    assert not v.find(words + 1)[1].any()


def brute(rows):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER)) + [None]

    out = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in rows if not out[i] for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(i, out[i], len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows]


def scored(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    return lm_scores(spark, df, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()


def check(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))


def test_edges(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["a b", "A B c", None, "", " \t", "é É", "a" * 5000, "a b c d " * 2000] * 3)] + [(None, "a b"), (4, "again"), (4, "again")]
    check([tuple(r)[:6] for r in scored(spark, rows)], brute(rows))
    monkeypatch.setattr(m, "DICTIONARY", 2)
    check([tuple(r)[:6] for r in scored(spark, rows)], brute(rows))
    assert scored(spark, [])[:1] == []


def test_held_out_gain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = scored(spark, docs)
    check([tuple(r)[:6] for r in got], brute(docs))
    held = [r for r in got if r.held_out]
    base, score, tokens = (sum(r[c] for r in held) for c in ("base_score", "score", "n_tokens"))
    assert len(held) > 80 and score > base + 0.05 * tokens


def test_trained_beats_initial(spark, monkeypatch):
    """On held-out documents the trained network gains at least 0.02 a token (log10) over its first parameters, the unigram model."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    gain = [[r for r in scored(spark, docs) if r.held_out]]
    monkeypatch.setattr(m, "ROUNDS", 0)
    gain.append([r for r in scored(spark, docs) if r.held_out])
    trained, first = (sum(r.score for r in rows) / sum(r.n_tokens for r in rows) for rows in gain)
    print(trained, first)
    assert trained > first + 0.02
