"""Models fitted together against each one fitted alone."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sparkwell.operators import linear, newton
from sparkwell.operators.newton import Fit

N, K = 400, 4


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, K)) * (1, 3, 0.2, 1)
    y = (x @ (1, -0.4, 2, 0) + rng.normal(size=N) > 0.3).astype(int)
    rows = [(i % 20, i, int(y[i]), *map(float, x[i])) for i in range(N)]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, label int, a double, b double, c double, d double").repartition(3)
    return df, x, y


def alone(x, y, c, logistic):
    """Plain Newton steps on the whole matrix, small at first."""
    z, s, w = np.column_stack([x, np.ones(len(x))]), 2 * y - 1, np.zeros(x.shape[1] + 1)
    for i in range(400):
        m = s * (z @ w)
        if logistic:
            p = 1 / (1 + np.exp(m))
            g, h = -(s * p) @ z, (z * (p * (1 - p))[:, None]).T @ z
        else:
            v = np.maximum(0, 1 - m)
            g, h = -2 * (s * v) @ z, 2 * (z * (v > 0)[:, None]).T @ z
        w = w - (0.3 if i < 60 else 1.0) * np.linalg.solve(c * h + np.diag([1.0] * x.shape[1] + [1e-9]), c * g + np.append(w[:-1], 0))
    return w


@pytest.mark.parametrize("logistic", [True, False])
def test_all_models_equal_single_fits(spark, table, logistic):
    df, x, y = table
    rows = df.select("label", F.pmod("doc_id", F.lit(3)).alias("fold"), "a", "b", "c", "d")
    fits = [Fit(c, width, held) for c in (0.001, 1.0, 100.0) for width in (1, K) for held in (-1, 0, 2)]
    w = newton.newton(rows, fits, logistic)
    fold = np.arange(N) % 3
    for f, got in zip(fits, w):
        use = fold != f.held
        want = alone(x[use][:, : f.width], y[use], f.c, logistic)
        assert np.allclose(got[: f.width], want[:-1], atol=1e-6) and abs(got[-1] - want[-1]) < 1e-6 and not got[f.width : -1].any()


def test_logistic_equals_sparks(table):
    df, _, _ = table
    m = linear.fit_logistic(df, ("a", "b", "c", "d"), (2.0,), 1)
    z = df.select("label", *((F.col(c) - float(mean)) / float(s) for c, mean, s in zip("abcd", m.mean, m.scale))).toDF("label", *"abcd")
    other = LogisticRegression(featuresCol="x", regParam=1 / (2.0 * N), standardization=False, maxIter=300, tol=1e-12).fit(VectorAssembler(inputCols=list("abcd"), outputCol="x").transform(z))
    assert np.allclose(m.weight, other.coefficients.toArray(), atol=1e-5) and abs(m.bias - other.intercept) < 1e-5


@pytest.mark.parametrize(("fit", "logistic"), [(linear.fit_logistic, True), (linear.fit_svm, False)])
def test_grid_search_chooses_what_single_fits_choose(spark, table, fit, logistic):
    df, x, y = table
    got = fit(df, ("a", "b", "c", "d"), (0.001, 0.1, 10.0), 4)
    fold = {r.doc_id: r.fold for r in linear.folds(df, n=4).collect()}
    fold = np.array([fold[i] for i in range(N)])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    areas = []
    for c in (0.001, 0.1, 10.0):
        each = []
        for f in range(4):
            w = alone(z[fold != f], y[fold != f], c, logistic)
            s, t = z[fold == f] @ w[:-1] + w[-1], y[fold == f]
            each.append(np.mean([(a > b) + 0.5 * (a == b) for a in s[t == 1] for b in s[t == 0]]))
        areas.append(np.mean(each))
    assert got.c == (0.001, 0.1, 10.0)[int(np.argmax(areas))] and got.auc == pytest.approx(max(areas), abs=1e-9)
    assert np.allclose(got.weight, alone(z, y, got.c, logistic)[:-1], atol=1e-6)


def test_ablation_equals_single_fits(spark, table):
    df, x, y = table
    got = [tuple(r) for r in linear.ablation(df, ("a", "b", "c", "d")).orderBy("n_features").collect()]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    for (n, last, accuracy), name in zip(got, "abcd"):
        w = alone(z[:, :n], y, 1.0, False)
        assert last == name and accuracy == pytest.approx(np.mean((z[:, :n] @ w[:-1] + w[-1] > 0) == y))


def test_areas_with_ties_over_many_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(m, int(rng.random() < 0.4), float(rng.integers(0, 30 * (m + 1)))) for m in range(4) for _ in range(500)] + [(9, 1, 0.5)]
    df = spark.createDataFrame(rows, "model int, label int, raw double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = newton.areas(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.pop(9) == 0.5
    for m, a in got.items():
        want = BinaryClassificationEvaluator(rawPredictionCol="raw").evaluate(df.where(F.col("model") == m).withColumn("label", F.col("label").cast("double")))
        assert a == pytest.approx(want, abs=1e-9)


def test_one_class_or_no_rows(spark, table):
    df, _, _ = table
    m = linear.fit_logistic(df.where("label = 1"), ("a", "b"), (1.0, 10.0), 3)
    assert m.auc == 0.5 and np.isfinite(m.weight).all()
    m = linear.fit_svm(df.limit(0), ("a", "b"), (1.0, 10.0), 3)
    assert not m.weight.any() and m.bias == 0


def test_scans_do_not_grow_with_models(spark, table, monkeypatch):
    df, _, _ = table
    calls, real = [], newton.sums
    monkeypatch.setattr(newton, "sums", lambda *a: calls.append(len(a[2])) or real(*a))
    linear.fit_logistic(df, ("a", "b", "c", "d"))
    assert calls[0] == 6 * 5 + 6 and len(calls) <= 15
