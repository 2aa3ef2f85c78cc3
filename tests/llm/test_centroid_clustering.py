"""Centroid clustering against brute force in exact integers."""

import hashlib
import math

import numpy as np
import pytest

from sparkwell.llm import centroid_clustering as m
from sparkwell.llm.centroid_clustering import centroid_clustering


def brute(rows, k, rounds, d, seed="2"):
    """Every vector against every centroid."""
    vs = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in vs if i is not None)[:k]]
    if not c:
        return []
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in vs]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(vs, of) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    best = [nearest(v) for _, v in vs]
    per = [sum(s for s, o in best if o == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, o, s, per[o], sum(per), sha[o]) for (i, _), (s, o) in zip(vs, best)), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], f"vec_id long, embedding array<{kind}>, label string, cluster int").repartition(3)


@pytest.mark.parametrize(("span", "rounds"), [(2, 4), (30, 5), (4000, 3)])
def test_small(spark, monkeypatch, span, rounds):
    """Coarse grids give many ties and equal centroids; blocks of a few vectors."""
    monkeypatch.setattr(m, "BLOCK", 7)
    rng = np.random.default_rng(span)
    rows = [(i, [float(x) for x in rng.integers(-span, span + 1, 3) / 256]) for i in range(150)]
    rows += [(7, rows[7][1]), (7, [1.0, 1.0, 1.0]), (None, [0.0, 0.0, 0.0]), (900, None), (901, []), (902, [1.0, None, 1.0]), (903, [float("nan")] * 3), (904, [float("inf"), 0.0, 0.0]), (905, [1.0, 2.0]), (906, [-0.001, -1.0, 0.999])]
    assert got(centroid_clustering(spark, table(spark, rows), k=9, rounds=rounds, d=3)) == brute(rows, 9, rounds, 3)


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i), 0.0]) for i in range(3)]
    assert got(centroid_clustering(spark, table(spark, rows), k=9, rounds=2, d=2)) == brute(rows, 9, 2, 2)
    assert centroid_clustering(spark, table(spark, rows).limit(0), k=9, rounds=2, d=2).count() == 0
    assert got(centroid_clustering(spark, table(spark, [(None, [1.0, 0.0])]), k=9, rounds=2, d=2)) == []
    one = [(i, [1.5, -2.5]) for i in range(20)]  # one vector, twenty times: all centroids equal
    assert got(centroid_clustering(spark, table(spark, one), k=4, rounds=2, d=2)) == brute(one, 4, 2, 2)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-(2**26), 2**26, 4) / 256]) for i in range(60)]
    assert got(centroid_clustering(spark, table(spark, rows), k=5, rounds=3, d=4)) == brute(rows, 5, 3, 4)
    with pytest.raises(Exception, match="fit 64 bits"):
        centroid_clustering(spark, table(spark, [(1, [1e30, 0.0])]), k=1, rounds=1, d=2).collect()


def test_bounds_skip_and_agree(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    report = []
    out = got(centroid_clustering(spark, df, report=report))
    assert out == brute([(r.vec_id, r.embedding) for r in df.collect()], 40, 5, 64)
    assert [r["compared"] < r["all"] for r in report] == [False] + [True] * 5


def test_bounds_hold_in_every_round():
    """Lower bounds never exceed, and upper bounds never fall below, the exact distances; no vector is misassigned."""
    rng = np.random.default_rng(5)
    x = rng.integers(-9, 10, (400, 4)).astype(np.int64)
    c = x[:12].copy()
    a, own, upper, lower, _ = m._first(x, c)
    for _ in range(6):
        old = c
        c = np.array([x[a == j].sum(axis=0) // max(1, (a == j).sum()) if (a == j).any() else c[j] for j in range(len(c))])
        a, own, upper, lower, n = m._again(x, c, a, upper, lower, m._moved(old, c), m._apart(c))
        s = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (a == s.argmin(axis=1)).all() and n < s.size
        assert (lower.astype(float) <= np.sqrt(s)).all() and (upper.astype(float) >= np.sqrt(s[np.arange(len(x)), a])).all()
        assert (own[own >= 0] == s[np.arange(len(x)), a][own >= 0]).all()
