"""Gradients summed as a tree."""

import numpy as np
import pytest

from sparkwell.operators import gradients
from sparkwell.operators.embeddings import random_dense
from sparkwell.operators.contrastive import ContrastiveTrainer
from sparkwell.operators.gradients import flat, summed, unflat
from sparkwell.operators.lambdarank import Network, Trainer


@pytest.mark.parametrize(("n", "parts", "fan", "piece"), [(10, 1, 32, 4), (50, 9, 2, 3), (7, 20, 32, 100), (40, 33, 4, 1)])
def test_the_sum(spark, monkeypatch, n, parts, fan, piece):
    x = np.random.default_rng(n).normal(size=(n, 11))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "g array<double>").repartition(parts)
    monkeypatch.setattr(gradients, "FAN", fan)
    monkeypatch.setattr(gradients, "PIECE", piece)
    got = summed(df)
    assert got.shape == (11,) and np.allclose(got, x.sum(axis=0))
    assert summed(df.limit(0)) is None


def test_the_driver_gets_one_row_a_piece(spark):
    """The last level has one row for each piece, whatever the number of partitions."""
    df = spark.range(64, numPartitions=64).selectExpr("array(1.0D, cast(id as double)) AS g")
    assert summed(df).tolist() == [64.0, 2016.0]


def test_same_gradients_from_one_task_and_many(spark):
    rng = np.random.default_rng(0)
    rows = [(f"q{q}", [float(v) for v in rng.integers(0, 4, 6)], [[float(v) for v in r] for r in rng.normal(size=(6, 4))]) for q in range(20)]
    df = spark.createDataFrame(rows, "query_id string, l array<double>, x array<array<double>>")
    t = Trainer(Network.random(4, (8, 4)), dropout=0.2)
    (a, la, na), (b, lb, nb) = t._summed(df.coalesce(1), 3), t._summed(df.repartition(13), 3)
    assert na == nb == 20 and la == pytest.approx(lb) and all(np.allclose(x, y) for x, y in zip(a, b))


def test_batches_are_cut_without_a_shuffle(spark):
    """Every row is in one batch of an epoch's shares."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, *(rng.normal(size=k).tolist() for k in (3, 4, 5))) for i in range(103)], "i int, text array<double>, image array<double>, structured array<double>").coalesce(1)
    t = ContrastiveTrainer(*(random_dense(k, 6, 4, seed=k) for k in (3, 4, 5)))
    plan = df.mapInPandas(t._share(0, 0, 4, 10), "g array<double>")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    batches = [r.g[-1] for p in range(4) for r in df.mapInPandas(t._share(0, p, 4, 10), "g array<double>").collect()]
    assert len(batches) == 10
    d = df.toPandas()
    x = np.random.default_rng([0, 0, 103]).permutation(103)
    assert sorted(np.concatenate(np.array_split(x, 10)).tolist()) == list(range(103)) and len(d) == 103
    like = [np.zeros((2, 3)), np.zeros(4)]
    assert all((a == b).all() for a, b in zip(unflat(flat([np.arange(6.0).reshape(2, 3), np.arange(4.0)], 9.0), like), [np.arange(6.0).reshape(2, 3), np.arange(4.0)]))


def test_a_task_gives_one_sum_of_its_batches(spark, monkeypatch):
    """A step's tasks give their sums alone, no more rows than pieces, from stored blocks, as whole batches' gradients would sum."""
    from sparkwell.operators import contrastive

    monkeypatch.setattr(contrastive, "BLOCK", 40)
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, *(rng.normal(size=k).tolist() for k in (3, 4, 5))) for i in range(103)], "i int, text array<double>, image array<double>, structured array<double>").coalesce(1)
    kinds = [np.float64] * 3
    blocks = df.mapInArrow(contrastive._blocks(kinds), "n int, text binary, image binary, structured binary")
    assert [r.n for r in blocks.collect()] == [40, 63]
    t = ContrastiveTrainer(*(random_dense(k, 6, 4, seed=k) for k in (3, 4, 5)))
    held = spark.sparkContext.broadcast(t.models())
    got = [np.frombuffer(r.g) for r in blocks.mapInArrow(t._sums(held, kinds, 0, 1, 4, 10), "piece int, slot int, g binary").collect()]
    assert len(got) == 1
    want = [r.g for lo, hi in ((0, 40), (40, 103)) for r in df.where(f"i >= {lo} and i < {hi}").mapInPandas(t._share(0, 1, 4, 10), "g array<double>").collect()]
    assert len(want) == got[0][-1] == 3 and np.allclose(np.sum(want, axis=0), got[0])
    t.train(df, 1, 10)
    assert t.steps == 4


def test_whole_blocks_share_and_vectors_are_made_where_they_are_stored(spark, monkeypatch):
    """With many blocks, a step reads its share's blocks alone and an epoch every row once; rows are dealt before their vectors are made."""
    from sparkwell.operators import contrastive
    from sparkwell.sources import shared

    monkeypatch.setattr(contrastive, "BLOCK", 4)
    monkeypatch.setattr(contrastive, "ROWS", 40)
    kept = []
    monkeypatch.setattr(contrastive, "written", lambda df, *a, **more: kept.append(shared.written(df, *a, **more)) or kept[-1])
    read, sums = [], ContrastiveTrainer._sums
    monkeypatch.setattr(ContrastiveTrainer, "_sums", lambda t, held, kinds, epoch, part, parts, size: read.append((part, parts)) or sums(t, held, kinds, epoch, part, parts, size))
    monkeypatch.setattr(contrastive, "drop", lambda df: None)

    def features(rows):
        i = rows["i"].to_numpy()
        return [np.column_stack([i % 3, i % 5, i % 7]).astype(float), np.column_stack([np.sin(i * k) for k in range(1, 5)]).astype(np.float32), np.column_stack([np.cos(i * k) for k in range(1, 6)])]

    t = ContrastiveTrainer(*(random_dense(k, 6, 4, seed=k) for k in (3, 4, 5)))
    h = t.train(spark.range(400).withColumnRenamed("id", "i"), 2, 4, features=features)
    assert t.steps == 8 and read == [(0, 1)] * 8
    rows = kept[0].collect()
    assert {r.share for r in rows} == {0, 1, 2, 3} and sum(r.n for r in rows) == 400 and h[0]["n_batches"] >= 80
    assert all(len(r.text) == 3 * r.n and len(r.image) == 16 * r.n and len(r.structured) == 40 * r.n for r in rows)
    model = contrastive._of(t.image, np.float32)
    assert model(np.ones((2, 4), np.float32)).dtype == np.float32


def test_batches_of_a_block_are_summed_at_once():
    rng = np.random.default_rng(2)
    t = ContrastiveTrainer(*(random_dense(k, 6, 4, seed=k) for k in (3, 4, 5)))
    xs = [rng.normal(size=(17, k)) for k in (3, 4, 5)]
    loss, grads = t.batches(xs, [5, 5, 7])
    each = [t.batch([x[s:e] for x in xs]) for s, e in ((0, 5), (5, 10), (10, 17))]
    assert loss == pytest.approx(sum(a for a, _ in each))
    for g, *w in zip(*(flat([x for m in g for layer in m for x in layer]) for g in (grads, *(g for _, g in each)))):
        assert g == pytest.approx(sum(w), abs=1e-12)


def test_counts_are_stored_in_few_bytes():
    import pyarrow as pa

    from sparkwell.operators.contrastive import _packed, _unpacked

    for x, size in ((np.array([[1.0, -3.0], [127.0, 0.0]]), 1), (np.array([[1.0, 300.0]]), 2), (np.array([[1.0, 40000.0]]), 8), (np.array([[0.5, np.nan]], np.float32), 4)):
        b = _packed(x)
        assert len(b) == x.size * size and np.array_equal(_unpacked(pa.scalar(b, pa.binary()), len(x), 2, x.dtype.type), x, equal_nan=True)
