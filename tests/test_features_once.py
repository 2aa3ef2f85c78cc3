"""Fits read stored features; TF-IDF moves no postings; equal ids are one document."""

import math
from collections import Counter, defaultdict

import pytest

from sparkwell.operators import linear, retrieval
from sparkwell.plans import registry


@pytest.mark.parametrize(("name", "fit"), [("f9_logistic_ranking", "fit_logistic"), ("f11_svm_ranking", "fit_svm")])
def test_fits_read_stored_features(spark, sf, monkeypatch, name, fit):
    class Seen(Exception):
        pass

    def seen(f):
        raise Seen(getattr(f, "_written_at", None))

    monkeypatch.setattr(linear, fit, seen)
    with pytest.raises(Seen) as e:
        registry.queries()[name](spark, sf)
    assert e.value.args[0]


def _plain(rows, most):
    docs = defaultdict(list)
    for i, t in rows:
        docs[i] += retrieval_tokens(t)
    tf = {i: Counter(w for w in t if len(w) > 1 and w != "the") for i, t in docs.items()}
    total, df = Counter(), Counter()
    for c in tf.values():
        total.update(c)
        df.update(c.keys())
    kept = sorted(total, key=lambda w: (-total[w], w))[:most]
    out = {}
    for i, c in tf.items():
        w = {t: n * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items() if t in kept}
        out |= {(i, t): x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}
    return out


def retrieval_tokens(t):
    import re

    return re.findall("[a-z0-9]+", (t or "").lower())


@pytest.mark.parametrize("more", [[], [(1, "heart Valve the b"), (None, "lung"), (None, "lung kidney"), (5, None)]])
def test_tfidf(spark, more):
    rows = [(1, "heart heart lung the"), (2, "Lung, kidney a"), (3, None), (4, ""), (5, "rare words here")] + more
    d = spark.createDataFrame(rows, "doc_id long, body_text string").repartition(3)
    got = retrieval.tfidf(d, max_features=5, stop_words=("the",))
    if not more:
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.term): r.weight for r in got.collect()} == pytest.approx(_plain(rows, 5))
