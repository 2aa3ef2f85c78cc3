"""Quantised, cell and exact search; exact percentiles."""

import numpy as np
import pytest

from sparkwell.operators import embeddings as E
from sparkwell.operators import quantisation as Q
from sparkwell.operators.analytics import exact_percentiles


def found(df):
    return {(r.query_id, r.vec_id): r.score for r in df.collect()}


def recall(got, exact):
    return len(got.keys() & exact.keys()) / len(exact)


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_quantised_search(spark, table):
    v = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    q = v.where("vec_id % 50 = 0")
    exact = found(E.flat_search(v, q, 10))
    index = Q.build(v)
    assert index.bytes_per_vector == 10 and index.codes.count() == v.count()
    assert {len(r.code) for r in index.codes.collect()} == {10}
    got = found(Q.search(index, q, 10, rerank=20))
    assert recall(got, exact) >= 0.9 and all(abs(got[x] - exact[x]) < 1e-6 for x in got.keys() & exact.keys())


def test_estimates_are_products_with_the_decoded_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, None)], "vec_id long, embedding array<double>").repartition(3)
    index = Q.build(v, cells=3, subspaces=4, entries=16)
    q = v.where("vec_id < 5")
    code = {r.id: np.frombuffer(r.code, np.uint8) for r in index.codes.collect()}
    decode = lambda c: index.centroids[int(c[0]) * 256 + c[1]] + np.concatenate([index.books[j][c[j + 2]] for j in range(4)])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = found(Q.candidates(index, q, 400))
    assert len(got) == 5 * 299
    assert all(s == pytest.approx(float(decode(code[i]) @ unit[j]), abs=1e-5) for (j, i), s in got.items())
    # entries are their members' means once the fit has settled, and codes are nearest entries
    left = unit - index.centroids[[int(code[i][0]) * 256 + code[i][1] for i in range(300)]]
    for j in range(4):
        part = left[:, 2 * j : 2 * j + 2]
        assert (((part[:, None] - index.books[j][None]) ** 2).sum(axis=2).argmin(axis=1) == [code[i][j + 2] for i in range(300)]).all()
    err = np.mean([np.linalg.norm(unit[i] - decode(code[i])) for i in range(300)])
    assert err < 0.5 * np.mean(np.linalg.norm(unit, axis=1))


def test_dealt_queries_and_empty_tables(spark, monkeypatch):
    """More queries than a task holds: the same results over a grid."""
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.normal(size=(200, 8)))], "vec_id long, embedding array<double>").repartition(3)
    index = Q.build(v, cells=4, subspaces=4, entries=32)
    one = found(Q.search(index, v, 5))
    monkeypatch.setattr(Q, "HELD", 30)
    monkeypatch.setattr(E, "SHARD_ROWS", 50)
    assert found(Q.search(index, v, 5)) == one
    empty = Q.build(v.limit(0))
    assert empty.codes.count() == 0
    assert Q.search(index, v.limit(0), 5).count() == 0


@pytest.mark.parametrize("probes", [1, 3, 8])
def test_cell_search_compares_the_probed_cells(spark, probes):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 6))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    index = E.build_cells(v, 8)
    got = found(E.cell_search(index, v.where("vec_id < 20"), 4, probes=probes))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    d = ((unit[:, None] - index.centroids[None]) ** 2).sum(axis=2)
    cell, asked = d.argmin(axis=1), np.argsort(d, axis=1)[:, :probes]
    want = {}
    for a in range(20):
        among = [i for i in range(240) if i != a and cell[i] in asked[a]]
        best = sorted(((-round(float(unit[a] @ unit[i]), 6), i) for i in among))[:4]
        want |= {(a, i): -s for s, i in best}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-5 for x in want)


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0] * 7 + [1.0], list(map(float, range(101))), "random"])
def test_exact_percentiles(spark, values):
    values = np.random.default_rng(4).integers(0, 50, 500).astype(float).tolist() if values == "random" else values
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(5)
    r = exact_percentiles(df, "x", {"a": 0.5, "b": 0.95, "c": 0.99, "d": 0.0, "e": 1.0}).first()
    if not values:
        assert tuple(r) == (None,) * 5
    else:
        assert list(r) == pytest.approx([float(np.percentile(values, p)) for p in (50, 95, 99, 0, 100)])


def test_search_lists_results_and_not_candidates(spark, monkeypatch):
    """Whatever the width, a task's lists hold the results alone, and they are the best of at least k * rerank candidates."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    q = v.where("vec_id % 50 = 0")
    index = Q.build(v, cells=4, subspaces=4, entries=16)
    lists, tiled = [], Q._tiled
    monkeypatch.setattr(Q, "_tiled", lambda v, q, k, *a, **more: lists.append(k) or tiled(v, q, k, *a, **more))
    got = found(Q.search(index, q, 5, rerank=20))
    assert lists == [5]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    best, every = found(Q.candidates(index, q, 100)), found(Q.candidates(index, q, 600))
    least = {r.id: r.least for r in Q._least(index, q.toDF("id", "v"), 100).collect()}
    for a in range(0, 600, 50):
        among = [i for (j, i), s in every.items() if j == a and s >= least[a]]
        assert {i for j, i in best if j == a} <= set(among) and len(among) <= 115
        want = sorted(((-round(float(unit[a] @ unit[i]), 6), i) for i in among))[:5]
        assert {i for j, i in got if j == a} == {i for _, i in want}
    assert {r.least for r in Q._least(index, q.toDF("id", "v"), 600).collect()} == {-np.inf}


def test_few_tiles_of_queries_keep_all_cores_busy(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(400)], "id long, v array<double>")
    cells = E._cells(v, v.where("id < 60"), 60, 30).where("asked = 1").groupBy("tile", "shard").count().collect()
    assert len(cells) >= 4 * spark.sparkContext.defaultParallelism and sum(r["count"] for r in cells) == 2 * 400
