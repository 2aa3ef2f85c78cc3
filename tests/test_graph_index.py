"""The graph index against exact search."""

import numpy as np
import pytest

from sparkwell.operators import embeddings as E
from sparkwell.operators import graph_index as G


def found(df):
    return {(r.query_id, r.vec_id): r.score for r in df.collect()}


@pytest.mark.parametrize(("table", "shard", "share"), [("sf0.1", 8192, 0.25), ("sf0.1", 500, 1.0), ("check_s", 8192, 0.2)])
def test_recall_and_visits(spark, monkeypatch, table, shard, share):
    monkeypatch.setattr(G, "SHARD", shard)
    v = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    q = v.where("vec_id % 50 = 0")
    exact = found(E.flat_search(v, q, 10))
    graph = G.build(v)
    assert graph.shards.count() == max(1, round(v.count() / shard))
    compared = spark.sparkContext.accumulator(0)
    got = found(G.search(graph, q, 10, compared=compared))
    assert len(got) == len(exact) and len(got.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(abs(got[x] - exact[x]) < 2e-6 for x in got.keys() & exact.keys())
    assert 0 < compared.value < share * q.count() * v.count()


def test_a_wide_beam_is_exact(spark, monkeypatch):
    """With a list as long as the shard, all that can be reached is compared: the result is the exact one."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(900, None), (5, x[7].tolist()), (901, x[3].tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(G, "SHARD", 60)
    monkeypatch.setattr(G, "TILE", 40)
    asked = v.where("vec_id < 100")
    got = found(G.search(G.build(v), asked.dropDuplicates(["vec_id"]).where("vec_id <> 5"), 4, beam=400))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    held = [(i, unit[i]) for i in range(300)] + [(5, unit[7]), (901, unit[3])]
    for a in (i for i in range(100) if i != 5):
        best = sorted((-round(float(unit[a] @ y), 6), i) for i, y in held if i != a)[:4]
        assert [round(s, 4) for s in sorted((got[x] for x in got if x[0] == a), reverse=True)] == [round(-s, 4) for s, _ in best]


def test_links_point_in_different_directions():
    """Links are diverse near vectors first; every vector is linked back where there is room."""
    x = E._unit(np.random.default_rng(3).normal(size=(200, 4))).astype(np.float32)
    links = G.neighbours(x, np.random.default_rng(0))
    assert links.shape == (200, G.LINKS + G.BACK + G.RANDOM) and links.min() >= -1 and links.max() < 200
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    for i in range(200):
        own = links[i, : G.LINKS]
        assert own[0] == s[i].argmax() and i not in own and len(set(own.tolist())) == G.LINKS
        second = own[1]
        assert s[second, own[0]] < s[i, second] or (s[own[0], own[1:]] >= s[i, own[1:]]).all()  # not closer to the first link


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_vectors(spark, n):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<double>")
    got = found(G.search(G.build(v), v, 10))
    assert set(got) == {(i, j) for i in range(n) for j in range(n) if i != j}
