"""Search in segments with skipped blocks against scores of all pairs."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwell.operators import blockmax
from sparkwell.operators import retrieval as R


def brute(docs, queries, k, k1=1.5, b=0.75):
    toks = {i: (t or "").lower().split() for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    out = []
    for q, text in queries:
        scores = {}
        for i, t in toks.items():
            tf = Counter(t)
            s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / avg)) for w in text.split() if tf[w])
            if s:
                scores[i] = round(s, 6)
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def corpus(n=400, seed=1):
    """Texts of Zipf-distributed words in ten topics."""
    rng = np.random.default_rng(seed)
    word = lambda topic: f"w{min(int(rng.zipf(1.3)), 60)}" if rng.random() < 0.5 else f"t{topic}x{min(int(rng.zipf(1.5)), 40)}"
    return [(i, " ".join(word(i % 10) for _ in range(int(rng.integers(0, 60))))) for i in range(n)]


@pytest.mark.parametrize(("postings", "block", "k"), [(1 << 19, 16, 10), (300, 4, 3), (1, 1, 1), (2000, 8, 500)])
def test_top_k_equals_all_pairs(spark, monkeypatch, postings, block, k):
    docs = [*corpus(), (1000, None), (1001, ""), (1002, "t3x1 " * 700), (1003, docs_twin := "w1 t4x1 t4x2"), (1004, docs_twin)]
    queries = [(0, "t3x1 t3x2 w1"), (1, "w1"), (2, "nowhere at all"), (3, "t4x1 t4x1 t4x2 w1 w2 w3 w4"), (4, "t9x40 t8x39"), (5, "")]
    for name, v in (("POSTINGS", postings), ("BLOCK", block), ("FIRST_BLOCKS", 2)):
        monkeypatch.setattr(blockmax, name, v)
    # workers import the module anew: segments of these sizes are made in this process
    index = R.fit(spark.createDataFrame(docs, "doc_id long, body_text string").repartition(2))
    rows = index.docs.select("doc_id", "dl", "terms", "tfs").toArrow().to_batches()
    made = list(_run(rows, postings))
    index.stored_segments = spark.createDataFrame([r for b in made for r in b.to_pylist()], blockmax.schema("bigint"))
    asked = spark.createDataFrame(queries, "query_id int, query_text string")
    got = sorted(map(tuple, R.retrieve(index, asked, k).collect()))
    assert got == brute(docs, queries, k)
    # the same search in this process, with every block size
    terms = [dict.fromkeys(q.split()) for _, q in queries]
    n, avg = len(docs), sum(len((t or "").split()) for _, t in docs) / len(docs)
    df = Counter(w for _, t in docs for w in set((t or "").split()))
    want = {q: [(i, s) for q_, _, i, s in brute(docs, queries, k) if q_ == q] for q, _ in queries}
    for (q, text), words in zip(queries, terms):
        least, found = -np.inf, {}
        for b in made:
            s = blockmax.Segment(b, avg)
            lists = np.array([s.terms.to_pylist().index(w) if w in s.terms.to_pylist() else -1 for w in words], int)
            weight = np.array([text.split().count(w) * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) for w in words])
            slot, score, held, read = blockmax.Query(s, lists, weight).best(k, least, 1e-6, s.bounds(1.5, 0.75), s.postings(1.5, 0.75))
            assert read <= held
            found |= {s.ids[int(j)].as_py(): round(float(x), 6) for j, x in zip(slot, score)}
            if len(found) >= k:
                least = max(least, sorted(found.values())[-k] - 2e-6)
        assert sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k] == want[q]


def _run(batches, postings):
    """Segments in this process, with its sizes."""
    held, n = [], 0
    for b in batches:
        for i in range(b.num_rows):
            m = len(b.column(2)[i])
            if held and n + m > postings:
                yield blockmax._segment(__import__("pyarrow").Table.from_batches(held))
                held, n = [], 0
            held.append(b.slice(i, 1))
            n += m
    if held:
        yield blockmax._segment(__import__("pyarrow").Table.from_batches(held))


def test_bounds_hold_for_all_parameters(spark):
    index = R.fit(spark.createDataFrame(corpus(150), "doc_id long, body_text string"))
    (batch,) = index.segments.coalesce(1).limit(1).toArrow().to_batches()
    s = blockmax.Segment(batch, 20.0)
    for k1, b in ((0.0, 0.0), (1.5, 0.75), (2.5, 1.0), (1.0, 0.5)):
        p, bound = s.postings(k1, b), s.bounds(k1, b)
        assert all((p[x:y] <= m + 1e-12).all() for x, y, m in zip(s.start[:-1], s.start[1:], bound))


def test_segments_hold_every_posting(spark, sf):
    """Postings and frequencies read back from segments are those of the rows."""
    index = R.fit(spark.createDataFrame([*corpus(300), (900, "x " * 5), (901, None)], "doc_id long, body_text string").repartition(3))
    back = {}
    for b in index.segments.toArrow().to_batches():
        for r in range(b.num_rows):
            s = blockmax.Segment(b.slice(r, 1), 1.0)
            entry, term = blockmax.spans(s.first[:-1].astype(int), s.first[1:].astype(int))
            at, which = blockmax.spans(s.start[entry].astype(int), s.start[entry + 1].astype(int))
            back |= {(s.terms[int(t)].as_py(), s.ids[int(x)].as_py()): int(n) for t, x, n in zip(term[which], s.slot[at], s.tf[at])}
    assert back == {(r.term, r.doc_id): r.tf for r in index.postings.collect()}
    df = {r.term: r.df for r in index.weights().collect()}
    assert df == Counter(t for t, _ in back)


def test_blocks_are_skipped(spark):
    """With the best documents found, most blocks that hold a query's terms are never read."""
    docs = spark.createDataFrame(corpus(4000, 2), "doc_id long, body_text string").coalesce(1)
    index = R.fit(docs.repartition(1))
    index.segments  # noqa: B018
    acc = [spark.sparkContext.accumulator(0) for _ in range(2)]
    asked = spark.createDataFrame([(i, f"w1 w2 t{i}x1 t{i}x7 t{i}x9") for i in range(10)], "query_id int, query_text string")
    got = sorted(map(tuple, R.retrieve(index, asked, 5, blocks=acc).collect()))
    full = R.matched_scores(index, asked).withColumn("score", F.round("score", 6))
    want = sorted(map(tuple, R.top(full, ["query_id"], [F.col("score").desc(), F.col("doc_id")], 5).select("query_id", "rank", "doc_id", "score").collect()))
    assert got == want and 0 < acc[1].value < 0.5 * acc[0].value


def test_empty_corpus(spark):
    index = R.fit(spark.createDataFrame([], "doc_id long, body_text string"))
    asked = spark.createDataFrame([(1, "a b")], "query_id int, query_text string")
    assert R.retrieve(index, asked).count() == 0 and R.matched_scores(index, asked).count() == 0
