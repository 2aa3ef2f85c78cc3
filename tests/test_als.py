"""Block ALS: normal equations, rows dealt over several blocks, several ranks, one history."""

import numpy as np
import pyarrow as pa
import pytest

from sparkwell.operators import als as m
from sparkwell.operators.als import als
from sparkwell.operators.collaborative import convergence, factor_sizes, fit_als

PENALTY = 0.01


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(4)
    cells = {(int(u), int(i)) for u, i in zip(rng.integers(0, 40, 500), rng.zipf(1.4, 500) % 60)} | {(0, i) for i in range(60)}
    rows = [(u, i, float(1 + 40 * rng.integers(0, 6))) for u, i in sorted(cells)]
    # dense ids, as index_of gives
    us, its = ({v: n for n, v in enumerate(sorted({r[k] for r in rows}))} for k in (0, 1))
    rows = [(us[u], its[i], c) for u, i, c in rows]
    return spark.createDataFrame(rows, "u int, i int, c double").repartition(3), rows


def factors(df, a, b):
    return {r["id"]: np.array(r["f"][a:b]) for r in df.collect()}


def residual(rows, key, own, other):
    """The largest relative residual of the normal equations of one side."""
    g = sum(np.outer(y, y) for y in other.values())
    worst = 0.0
    for u, x in own.items():
        mine = [r for r in rows if r[key] == u]
        ys, c = np.stack([other[r[1 - key]] for r in mine]), np.array([r[2] for r in mine])
        b = ys.T @ c
        worst = max(worst, np.abs((g + (ys.T * (c - 1)) @ ys + PENALTY * np.eye(len(x))) @ x - b).max() / max(1, np.abs(b).max()))
    return worst


def loss(rows, users, items):
    return np.mean([(users[u] @ items[i] - c) ** 2 for u, i, c in rows])


@pytest.mark.parametrize("most", [100_000, 7])
def test_normal_equations_and_history(spark, pairs, most):
    """Rows of more than 7 pairs are dealt over blocks in the second case; results are the same."""
    df, rows = pairs
    users, items, history = als(df, (3, 8), 4, PENALTY, most=most)
    assert [(h["iterations"], h["rank"]) for h in history] == [(t, r) for t in range(1, 5) for r in (3, 8)]
    for a, b, h in ((0, 3, history[-2]), (3, 11, history[-1])):
        u, i = factors(users, a, b), factors(items, a, b)
        assert len(u) == len({r[0] for r in rows}) and len(i) == len({r[1] for r in rows})
        assert residual(rows, 1, i, u) < 1e-6  # the items were solved last
        assert h["reconstruction_loss"] == pytest.approx(loss(rows, u, i), rel=1e-6)
        assert h["item_factor_norm"] == pytest.approx(np.sqrt(sum((x**2).sum() for x in i.values())))
        assert h["user_factor_norm"] == pytest.approx(np.sqrt(sum((x**2).sum() for x in u.values())))
    one = als(df, (8,), 4, PENALTY, most=100_000)
    assert len(history) == 8 and one[2][-1]["iterations"] == 4


def test_dealt_rows_give_the_same_factors(spark, pairs):
    df, _ = pairs
    (u1, i1, h1), (u2, i2, h2) = (als(df, (5,), 3, PENALTY, most=n) for n in (100_000, 5))
    for a, b in ((u1, u2), (i1, i2)):
        x, y = factors(a, 0, 5), factors(b, 0, 5)
        assert x.keys() == y.keys() and all(np.allclose(x[k], y[k], atol=1e-6) for k in x)
    assert h1[-1]["reconstruction_loss"] == pytest.approx(h2[-1]["reconstruction_loss"])


def test_objective_falls(spark, pairs):
    """The full objective, all unstored pairs included, never rises."""
    df, rows = pairs
    c = {(u, i): w for u, i, w in rows}
    last = np.inf
    for n in (1, 2, 4):
        users, items, _ = als(df, (4,), n, PENALTY)
        u, i = factors(users, 0, 4), factors(items, 0, 4)
        now = sum(c.get((a, b), 1.0) * (((a, b) in c) - x @ y) ** 2 for a, x in u.items() for b, y in i.items()) + PENALTY * sum((x**2).sum() for x in (*u.values(), *i.values()))
        assert now <= last + 1e-9
        last = now


def test_history_of_one_fit(spark, pairs):
    df, rows = pairs
    matrix = spark.createDataFrame([(f"p{u}", f"d{i}", int((c - 1) / 40), c) for u, i, c in rows], "physician_id string, doc_id string, weighted_score long, confidence double")
    got = [tuple(r) for r in convergence(matrix, 5, 6, (1, 3, 5)).orderBy("iterations").collect()]
    for n, value, items, users in got:
        r = fit_als(matrix, 6, n).reconstruction(matrix).first()
        assert (value, items, users) == (pytest.approx(r["reconstruction_loss"], rel=1e-4), pytest.approx(r["item_factor_norm"], rel=1e-5), pytest.approx(r["user_factor_norm"], rel=1e-5))
    assert [g[0] for g in got] == [1, 3, 5]
    sizes = {r["factors"]: r for r in factor_sizes(matrix, (2, 6), 3).collect()}
    assert sizes[6]["reconstruction_loss"] == pytest.approx(fit_als(matrix, 6, 3).reconstruction(matrix).first()["reconstruction_loss"], rel=1e-4)
    assert sizes[2]["memory_mb"] == pytest.approx((len({r[0] for r in rows}) + len({r[1] for r in rows})) * 8 / 1048576)


def test_tables_are_deleted(spark, pairs, monkeypatch):
    """Only the last users and items stay in the shared folder."""
    df, _ = pairs
    made, gone = [], []
    real, drop = m.written, m.drop
    monkeypatch.setattr(m, "written", lambda d, name, path=None: made.append(name) or real(d, name, path))
    monkeypatch.setattr(m, "drop", lambda d: gone.append(d) or drop(d))
    als(df, (2,), 3, PENALTY)
    assert len(made) - len([g for g in gone if g is not None]) == 2


def test_no_pairs(spark, pairs):
    users, items, history = als(pairs[0].limit(0), (2,), 2, PENALTY)
    assert users.count() == items.count() == 0 and history[-1]["reconstruction_loss"] == 0


@pytest.mark.parametrize("flat", [False, True])
def test_recommendations_equal_all_scores(spark, monkeypatch, flat):
    """Blocks of 16 items: the best of every user over all items, seen pairs left out, ties by id; hot users see most items."""
    from sparkwell.operators import collaborative as c

    monkeypatch.setattr(c, "BLOCK_ITEMS", 16)
    monkeypatch.setattr(c, "TILE_USERS", 6)
    rng = np.random.default_rng(8)
    length = np.ones(150) if flat else rng.pareto(1.0, 150) + 0.01  # falling norms let scans end early
    v = rng.normal(size=(150, 5))
    v = (v / np.linalg.norm(v, axis=1)[:, None] * length[:, None]).astype(np.float32)
    v[20] = v[21] = v[22]
    u = rng.normal(size=(23, 5)).astype(np.float32)
    u[5] = 0
    ids = rng.permutation(150)
    users = spark.createDataFrame([(f"p{i}", x.tolist()) for i, x in enumerate(u)], "physician_id string, factors array<float>")
    items = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "doc_id long, factors array<float>")
    pairs = {(f"p{int(a)}", int(b)) for a, b in zip(rng.integers(0, 23, 200), rng.integers(0, 160, 200))} | {("p1", i) for i in range(147)}
    seen = spark.createDataFrame([*pairs, *sorted(pairs)[:5]], "physician_id string, doc_id long")
    f = c.Factors(users, items, spark.createDataFrame([], "doc_id long, n long"), 5)
    out = f.recommend(users.select("physician_id"), 4, seen)
    got = {(r.physician_id, r["rank"]): (r.doc_id, r.score) for r in out.collect()}
    want = {}
    for a in range(23):
        s = v.astype(float) @ u[a].astype(float)
        best = sorted(((-x, int(i)) for x, i in zip(s, ids) if (f"p{a}", int(i)) not in pairs))[:4]
        want |= {(f"p{a}", n + 1): (i, pytest.approx(-x, abs=1e-9)) for n, (x, i) in enumerate(best)}
    assert got == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan


def test_a_scan_ends_early(spark, monkeypatch):
    from sparkwell.operators import collaborative as c

    monkeypatch.setattr(c, "BLOCK_ITEMS", 10)
    calls, real = spark.sparkContext.accumulator(0), c._best_of_cell

    def counting(k):
        run = real(k)
        return lambda users, items: (calls.add(items.num_rows), run(users, items))[1]

    monkeypatch.setattr(c, "_best_of_cell", counting)
    items = spark.createDataFrame([(i, [float(2.0**-i), 0.0]) for i in range(200)], "doc_id long, factors array<float>")
    users = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 1.0])], "physician_id string, factors array<float>")
    f = c.Factors(users, items, spark.createDataFrame([], "doc_id long, n long"), 2)
    assert [r.doc_id for r in f.recommend(users, 3).where("physician_id = 'a'").orderBy("rank").collect()] == [0, 1, 2]
    assert calls.value <= 4 * 10  # the first block, not twenty


def test_users_and_items_are_sent_to_few_cells():
    """At 540,000 users and 3 million items of 128 factors, all blocks sent to all tiles are 40 GB; in blocks of 8,192 by tiles of 16,384 they were 170 GB."""
    from sparkwell.operators import collaborative as c

    users, items, row = 540_000, 3_000_000, 128 * 4
    assert (items * -(-users // c.TILE_USERS) + users * -(-items // c.BLOCK_ITEMS)) * row < 40e9


def test_pairs_that_reach_a_score_come_alone():
    """Users with a score to reach get the items that reach it in 64 bits, seen ones left out; others the k best of each strip."""
    from sparkwell.operators import collaborative as c

    rng = np.random.default_rng(9)
    u, v = (rng.normal(size=(n, 16)).astype(np.float32) for n in (50, 3 * c.STRIP_ITEMS // 2))
    s = u.astype(float) @ v.astype(float).T
    least = np.sort(s, axis=1)[:, -7]
    kinds = pa.schema([("physician_id", pa.int64()), ("f", pa.list_(pa.float32())), ("least", pa.float64()), ("doc_id", pa.int64())])
    seen = {(a, int(s[a].argmax())) for a in range(0, 50, 2)}
    users = pa.Table.from_pylist([{"physician_id": i, "f": x.tolist(), "least": float(t)} for i, (x, t) in enumerate(zip(u, least))] + [{"physician_id": a, "doc_id": b} for a, b in seen], kinds)
    items = pa.table({"doc_id": pa.array(range(len(v))), "f": pa.array(v.tolist(), pa.list_(pa.float32()))})
    got = {(r["physician_id"], r["doc_id"]): r["score"] for r in c._best_of_cell(5)(users, items).to_pylist()}
    want = {(a, int(i)): pytest.approx(s[a, i], abs=1e-9) for a in range(50) for i in np.argsort(-s[a])[:7] if (a, int(i)) not in seen}
    assert got == want
    users = users.set_column(2, "least", pa.array([None] * users.num_rows, pa.float64()))
    assert set(want) <= {(r["physician_id"], r["doc_id"]) for r in c._best_of_cell(7)(users, items).to_pylist()}
