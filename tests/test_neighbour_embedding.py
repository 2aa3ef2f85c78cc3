"""Neighbour embedding: calibration, layout, placed rows, and how far neighbours are kept against PCA."""

import numpy as np
import pytest

from sparkwell.operators import embeddings as E
from sparkwell.operators import neighbour_embedding as N


def pca(x):
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    return u[:, :2] * s[:2]


def sheet(n, seed=1):
    """A curved two-dimensional sheet in 40 dimensions."""
    rng = np.random.default_rng(seed)
    p = rng.uniform(0, 3, (n, 2))
    return E._unit(np.cos(p @ rng.normal(0, 1.2, (2, 40)) + rng.uniform(0, 6.28, 40)))


def test_probabilities_have_the_perplexity():
    d = np.random.default_rng(2).gamma(2, 1, (50, 90))
    p = N.calibrated(d, 20)
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(np.exp(-(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)), 20, rtol=1e-3)
    assert np.isfinite(N.calibrated(np.zeros((3, 5)), 20)).all()


def test_trustworthiness_by_loops():
    rng = np.random.default_rng(4)
    x, y, k = E._unit(rng.normal(size=(30, 4))), rng.normal(size=(30, 2)), 3
    over = 0
    for i in range(30):
        others = [j for j in range(30) if j != i]
        rank = {j: r + 1 for r, j in enumerate(sorted(others, key=lambda j: -x[i] @ x[j]))}
        over += sum(max(0, rank[j] - k) for j in sorted(others, key=lambda j: ((y[i] - y[j]) ** 2).sum())[:k])
    assert N.trustworthiness(x, y, k) == pytest.approx(1 - 2 / (30 * k * (60 - 3 * k - 1)) * over)
    assert N.trustworthiness(x, x, 2) == 1.0


def test_a_curved_sheet_keeps_its_neighbours(spark):
    """Rows that are no landmarks included: 0.9 or more, and above PCA."""
    x = sheet(900)
    df = spark.createDataFrame([(i, r.tolist(), "more") for i, r in enumerate(x)] + [(9000, None, "none")], "vec_id long, embedding array<double>, x string").repartition(4)
    got = {r.vec_id: (r.x, r.y) for r in N.embed(df, 300).collect()}
    assert set(got) == set(range(900))
    y = np.array([got[i] for i in range(900)])
    kept, flat = N.trustworthiness(x, y), N.trustworthiness(x, pca(x))
    assert kept >= 0.9 and kept > flat


def test_table(spark, sf):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = v.orderBy("vec_id").collect()
    x = E._unit(np.array([r.embedding for r in rows], float))
    got = {r.vec_id: (r.x, r.y) for r in N.embed(v).collect()}
    y = np.array([got[r.vec_id] for r in rows])
    assert N.trustworthiness(x, y) > N.trustworthiness(x, pca(x)) + 0.1


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<double>")
    rows = N.embed(df).collect()
    assert len(rows) == n and all(np.isfinite([r.x, r.y]).all() for r in rows)
