"""Terms found by one automaton against a search for each term."""

import time

import numpy as np
import pytest

from sparkwell.operators.matching import term_hits


def brute(docs, terms):
    return sorted((i, t) for i, x in docs for t in set(terms) if x is not None and t is not None and t.lower() in x.lower())


@pytest.mark.parametrize("most", [100_000, 2])
def test_small(spark, most):
    docs = [(1, "The Heart of the heart"), (2, "hear"), (3, None), (4, ""), (5, "ÉCOLE and école, overheard"), (1, "The Heart of the heart")]
    terms = ["heart", "HEART", "ear", "hear", "école", "overhear", "", None, "nowhere", "t of t"]
    d = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    assert sorted(map(tuple, term_hits(d, t, "text", most=most).collect())) == brute(docs, terms)
    assert term_hits(d, t.limit(0), "text").count() == 0 and term_hits(d.limit(0), t, "text").count() == 0


def test_ten_thousand_terms(spark):
    """10,000 terms take about the time of one: a text is read once."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 6, int(rng.integers(3, 8))))
    docs = [(i, " ".join(word() for _ in range(150))) for i in range(300)]
    terms = sorted({word() + (" " + word() if rng.random() < 0.3 else "") for _ in range(12_000)})[:10_000]
    d = spark.createDataFrame(docs, "doc_id int, text string").repartition(4)
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    start = time.perf_counter()
    got = sorted(map(tuple, term_hits(d, t, "text").collect()))
    took = time.perf_counter() - start
    assert len(terms) > 9_000 and took < 30
    assert got == brute(docs, terms)
