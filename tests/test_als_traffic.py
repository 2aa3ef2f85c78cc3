"""What a half-step of ALS sends: rows with near partners lie in one block; short rows are solved among their pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwell.operators import als as m


def test_factors_go_to_few_blocks(spark, monkeypatch):
    """2,000 users each of 10 neighbouring items, ids shuffled over users: hashed blocks would each need most of the items."""
    monkeypatch.setattr(m, "BLOCK_PAIRS", 1000)
    at = np.random.default_rng(3).permutation(2000)
    rows = [(u, int((at[u] * 2 + j * 3) % 4000), 1.0) for u in range(2000) for j in range(10)]
    dealt = m._deal(spark.createDataFrame(rows, "u int, i int, c double"), len(rows), m.MOST_PAIRS)
    assert dealt.count() == len(rows) and dealt.select("bu").distinct().count() >= 20
    for key, other in (("u", "i"), ("i", "u")):
        blocks, routes, hot = m._side(dealt, key, other)
        n = routes.agg(F.count("*").alias("n"), F.sum(F.size("to")).alias("sent")).first()
        assert not hot and n["sent"] <= 1.5 * n["n"]
        assert blocks.agg(F.max(F.size("key"))).first()[0] <= 2 * 1000


@pytest.mark.parametrize("penalty", [0.01, 0.0])
def test_rows_shorter_and_longer_than_the_rank(penalty):
    rng = np.random.default_rng(5)
    y = rng.normal(size=(50, 6))
    size = np.array([1, 3, 3, 5, 6, 9])
    start = np.cumsum(size) - size
    at, c = rng.integers(0, 50, size.sum()), 1 + 40.0 * rng.integers(0, 4, size.sum())
    x, sse = m._rows_solved(y, at, c, start, size, y.T @ y, penalty)
    for row, error, s, n in zip(x, sse, start, size):
        v, w = y[at[s : s + n]], c[s : s + n]
        want = np.linalg.solve(y.T @ y + (v.T * (w - 1)) @ v + penalty * np.eye(6), v.T @ w)
        assert np.allclose(row, want, atol=1e-9) and error == pytest.approx(((v @ want - w) ** 2).sum())


def test_scores_of_a_cell_come_in_strips(monkeypatch):
    """A cell of 2,000 users and 2,000 items never has all its scores (32 MB) at once."""
    import tracemalloc

    import pyarrow as pa

    from sparkwell.operators import collaborative as c

    monkeypatch.setattr(c, "MOST_SCORES", 100_000, raising=False)
    rng = np.random.default_rng(6)
    u, v = (rng.normal(size=(2000, 4)).astype(np.float32) for _ in range(2))
    seen = [(int(a), int(b)) for a, b in zip(rng.integers(0, 2000, 500), rng.integers(0, 2100, 500)) if b < 2000]
    kinds = pa.schema([("physician_id", pa.int64()), ("f", pa.list_(pa.float32())), ("doc_id", pa.int64())])
    users = pa.Table.from_pylist([{"physician_id": i, "f": x.tolist()} for i, x in enumerate(u)] + [{"physician_id": a, "doc_id": b} for a, b in seen], kinds)
    items = pa.table({"doc_id": pa.array(range(2000)), "f": pa.array(v.tolist(), pa.list_(pa.float32()))})
    tracemalloc.start()
    got = c._best_of_cell(3)(users, items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = u.astype(float) @ v.astype(float).T
    for a, b in seen:
        s[a, b] = -np.inf
    best = np.argsort(-s, axis=1)[:, :3]
    assert {(r["physician_id"], r["doc_id"]) for r in got.to_pylist()} == {(a, int(b)) for a in range(2000) for b in best[a]}
    assert peak < 20e6
