"""Operators without an SQL form, and edge rows, against twins written from the formulas."""

import datetime as dt
import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwell.functions import scalar as S
from sparkwell.operators import analytics as A
from sparkwell.operators import embeddings as E
from sparkwell.operators import linear
from sparkwell.operators import ranking as R
from sparkwell.operators import retrieval as B
from sparkwell.operators.contrastive import ContrastiveTrainer, nce
from sparkwell.operators.lambdarank import Network, Trainer, group_lambdas
from sparkwell.operators.linear import fit_logistic, fit_svm
from sparkwell.plans import registry
from sparkwell.sources import tables
from sparkwell.sources.bridge import ICD_CODES
from sparkwell.sources.datagen import Config, dataset, image_features, interactions, judgments, structured_metadata

# ------------------------------------------------------------------ analytics


def test_week_text_agrees_with_sqlite(spark):
    days = [dt.datetime(2019, 1, 1) + dt.timedelta(days=i) for i in range(3000)]
    got = spark.createDataFrame([(d,) for d in days], "t timestamp").select("t", S.week_text(F.col("t")).alias("w")).collect()
    con = sqlite3.connect(":memory:")
    assert all(r.w == con.execute("SELECT strftime('%W', ?)", (r.t.isoformat(),)).fetchone()[0] for r in got)


ROWS = [(1, "p", "d1", "save", 3.0), (2, "p", "d1", "dwell", None), (3, "p", "d2", "dwell", 9.0), (4, "p", "d3", "click", None), (5, "p", "d4", "click", 1.0), (6, "q", "d1", "view", None), (7, "q", "d1", "odd", None)] + [(10 + i, "q", f"e{n}", "view", None) for n in (4, 5) for i in range(0)]


def made(spark, rows=ROWS):
    return spark.createDataFrame([(*r, dt.datetime(2024, 12, 30), None) for r in rows], "interaction_id long, physician_id string, doc_id string, interaction_type string, dwell_time_seconds double, timestamp timestamp, query_id string")


def test_interaction_matrix_edges(spark):
    got = {(r.physician_id, r.doc_id): r for r in A.interaction_matrix(made(spark)).collect()}
    assert got["p", "d1"].weighted_score == 3 and got["p", "d1"].avg_dwell_time == 3.0 and got["p", "d1"].total_interactions == 2
    assert got["p", "d2"].confidence == 1 and got["p", "d2"].rank_per_physician == 4
    assert [got["p", d].rank_per_physician for d in ("d1", "d3", "d4")] == [1, 2, 3]  # ties by doc_id
    assert got["q", "d1"].max_dwell_time is None and got["q", "d1"].weighted_score == 1
    assert {r.confidence for r in A.interaction_matrix(made(spark), alpha=10).collect()} == {31, 1, 21, 11}


def test_cold_start_threshold(spark):
    rows = [(i, f"p{i % 3}", d, "view", None) for d, n in (("four", 4), ("five", 5)) for i in range(n)]
    docs = spark.createDataFrame([("four", "", "", ""), ("five", "", "", ""), ("none", "", "", "")], "doc_id string, title string, specialty string, doc_type string")
    got = {r.doc_id: (r.interaction_count, r.unique_physicians, r.is_cold_start) for r in A.cold_start_documents(docs, made(spark, rows)).collect()}
    assert got == {"four": (4, 3, 1), "five": (5, 3, 0), "none": (0, 0, 1)}


def test_ctr_of_a_week_without_views(spark):
    (r,) = A.weekly_ctr(made(spark, [(1, "p", "d", "click", None)])).collect()
    assert (r.year, r.week_num, r.ctr, r.view_count) == ("2024", "53", 0.0, 0)


def test_empty_inputs(spark):
    none = made(spark, [])
    assert A.interaction_matrix(none).count() == 0 and A.sparse_coordinates(A.interaction_matrix(none)).count() == 0
    docs = spark.createDataFrame([], "doc_id string")
    assert A.sparsity(docs, docs, none).first().sparsity == 1.0 and A.sparsity(docs, docs, none).first().sparsity_pct == "100.00%"


def test_index_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1013).alias("k")).repartition(8)
    got = A.index_of(df, "k").orderBy("k").collect()
    assert [r.idx for r in got] == list(range(1000))


def test_split_keeps_groups(spark):
    df = spark.range(600).select((F.col("id") % 20).alias("query_id"), "id")
    s = A.hash_split(df, "query_id").groupBy("query_id").agg(F.count_distinct("is_train").alias("n"), F.max("is_train").alias("t")).collect()
    assert all(r.n == 1 for r in s) and sum(r.t for r in s) == 14


def test_storage_round_trip(spark, tmp_path):
    t = dataset(spark, Config(30, 5, 6, 50))
    tables.create_tables(spark, str(tmp_path / "x"))
    assert tables.load_tables(spark, str(tmp_path / "x")).documents.count() == 0
    tables.write_tables(t, str(tmp_path / "x"))
    back = tables.load_tables(spark, str(tmp_path / "x"))
    assert back.documents.count() == 30 and {r.n for r in tables.violations(back).collect()} == {0}
    for fmt in ("json", "orc"):
        tables.write_tables(t, str(tmp_path / fmt), fmt)
        assert tables.load_tables(spark, str(tmp_path / fmt), fmt).interactions.count() == 50


# ------------------------------------------------------------------ retrieval

CORPUS = [("a", "heart heart attack naïve"), ("b", ""), ("c", None), ("d", "Cardiac arrest. heart"), ("e", "nothing here")]
ASKED = [("q1", "heart heart arrest"), ("q2", ""), ("q3", "zzz"), ("q4", "NAÏVE")]


def tokens(t):
    import re

    return re.findall("[a-z0-9]+", (t or "").lower())


def bm25(query, text, k1=1.5, b=0.75):
    docs = [tokens(t) for _, t in CORPUS]
    n, avg, d = len(docs), sum(map(len, docs)) / len(docs), tokens(text)
    out = 0.0
    for w in tokens(query):
        df = sum(w in x for x in docs)
        if df and w in d:
            out += math.log((n - df + 0.5) / (df + 0.5) + 1) * d.count(w) * (k1 + 1) / (d.count(w) + k1 * (1 - b + b * len(d) / avg))
    return out


def test_bm25_more_terms_than_are_broadcast(spark, monkeypatch):
    docs, queries = spark.createDataFrame(CORPUS, "doc_id string, body_text string"), spark.createDataFrame(ASKED, "query_id string, query_text string")
    index, rounded = B.fit(docs), lambda df: sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in df.collect())
    want = rounded(B.matched_scores(index, queries))
    monkeypatch.setattr(B, "MOST_TERMS", 0)
    assert rounded(B.matched_scores(index, queries)) == want


def test_bm25_best_of_each_task(spark, monkeypatch):
    """Segments of 64 postings, so that lists are cut often; ties stay in the order of ids, and a stored index gives the same."""
    import random

    from sparkwell.operators import blockmax

    monkeypatch.setattr(blockmax, "POSTINGS", 64)
    rng = random.Random(1)
    words = ["ash", "Birch", "cedar", "oak", "elm", "fir", "É", "a1"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6)))) for i in range(300)] + [(300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, body_text string").repartition(3)
    queries = spark.createDataFrame([(j, " ".join(rng.sample(words, 3))) for j in range(12)] + [(99, ""), (98, None)], "query_id int, query_text string")
    index = B.fit(docs)
    assert index.segments.count() > 9
    every = B.matched_scores(index, queries).withColumn("score", F.round("score", 6))
    want = sorted((r.query_id, r.rank, r.doc_id, r.score) for r in A.top(every, ["query_id"], [F.col("score").desc(), F.col("doc_id")], 5).collect())
    assert sorted(map(tuple, B.retrieve(index, queries, 5).collect())) == want
    from sparkwell.sources.shared import new_path

    path = new_path(spark, "kept")
    assert sorted(map(tuple, B.retrieve(B.fit(docs, path), queries, 5).collect())) == want
    assert sorted(map(tuple, B.retrieve(B.load(spark, path), queries, 5).collect())) == want
    some = every.where("doc_id % 7 = 0")
    pairs = some.select("query_id", "doc_id").union(spark.createDataFrame([(99, 1), (0, 300)], "query_id int, doc_id long"))
    got = {(r.query_id, r.doc_id): round(r.score, 6) for r in B.pair_scores(index, pairs, queries).collect()}
    assert got == {(r.query_id, r.doc_id): r.score for r in some.collect()} | {(99, 1): 0.0, (0, 300): 0.0}


def test_bm25(spark):
    docs, queries = spark.createDataFrame(CORPUS, "doc_id string, body_text string"), spark.createDataFrame(ASKED, "query_id string, query_text string")
    got = {(r.query_id, r.doc_id): r.score for r in B.matched_scores(B.fit(docs), queries).collect()}
    want = {(q, d): bm25(t, x) for q, t in ASKED for d, x in CORPUS if bm25(t, x)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    padded = B.retrieve(B.fit(docs), queries, 4, padded=True).collect()
    assert all(len([r for r in padded if r.query_id == q]) == 4 for q, _ in ASKED)
    assert [r.doc_id for r in sorted(padded, key=lambda r: r.rank) if r.query_id == "q2"] == list("abcd")
    index = B.fit(docs)
    assert index.postings.agg(F.sum("tf")).first()[0] == index.docs.agg(F.sum("dl")).first()[0] == 10
    assert set(B.measure_latency(B.fit(docs), ["heart"])) == {"p50_ms", "p95_ms", "p99_ms", "mean_ms", "num_queries"}


# ------------------------------------------------------------------ ranking

JUDGED = [("a", i, lab, sc) for i, (lab, sc) in enumerate([(3, 0.1), (0, 0.9), (2, 0.9), (1, 0.5)] + [(0, 0.01 * k) for k in range(10)])] + [("zero", i, 0, 0.1 * i) for i in range(3)] + [("one", 0, 2, 0.5)] + [("ideal", i, 3 - i, 1.0 - i / 4) for i in range(4)]


def judged(spark):
    return spark.createDataFrame(JUDGED, "query_id string, doc_id long, relevance_score int, score double")


def test_ndcg_and_lambdas(spark):
    got = {r.query_id: r.ndcg for r in R.ndcg(judged(spark)).collect()}
    assert got["zero"] == 0 and got["one"] == 1 and abs(got["ideal"] - 1) < 1e-12 and 0 < got["a"] < 1
    g = {(r.query_id, r.doc_id): r["lambda"] for r in R.lambda_gradients(judged(spark)).collect()}
    for q in ("a", "zero", "ideal"):
        rows = [r for r in JUDGED if r[0] == q]
        want = group_lambdas(np.array([r[2] for r in rows], float), np.array([r[3] for r in rows]))
        assert np.allclose([g[q, r[1]] for r in rows], want, atol=1e-9) and abs(sum(want)) < 1e-9
    assert R.delta_ndcg(judged(spark)).where("delta < 0").count() == 0
    assert {r.query_id for r in R.trainable_groups(judged(spark)).collect()} == {"a", "ideal"}


def groups(spark, n=12):
    rng = np.random.default_rng(0)
    rows = []
    for q in range(n):
        for d in range(8):
            x = rng.normal(size=4)
            rows.append((q, d, int(np.clip(round(x[0] + 1), 0, 3)), [float(v) for v in x]))
    return spark.createDataFrame(rows, "query_id long, doc_id long, relevance_score int, features array<double>")


@pytest.mark.parametrize("mode", ["local", "sync"])
def test_lambdarank_learns_and_is_saved(spark, tmp_path, mode):
    g = groups(spark)
    t = Trainer(Network.random(4, (16, 8), seed=1), rate=0.01, dropout=0.0)
    before = t.evaluate(g)
    t.train(g, epochs=4 if mode == "local" else 6, mode=mode, parts=2)
    after = t.evaluate(g)
    assert after > before
    t.save(spark, str(tmp_path / "m"))
    u = Trainer.load(spark, str(tmp_path / "m"))
    assert u.steps == t.steps and abs(u.evaluate(g) - after) < 1e-12


def test_network_gradient():
    net = Network.random(3, (5, 4), seed=2)
    rng = np.random.default_rng(1)
    x, d = rng.normal(size=(6, 3)), rng.normal(size=6)
    g = net.backward(net.forward(x)[1], d)
    for p, q in zip(net.parameters(), g):
        at = tuple(0 for _ in p.shape)
        old = p[at]
        p[at] = old + 1e-6
        up = d @ net.forward(x)[0]
        p[at] = old - 1e-6
        down = d @ net.forward(x)[0]
        p[at] = old
        assert abs((up - down) / 2e-6 - q[at]) < 1e-5


def test_linear_rankers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(int(i % 10), int(i), int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(300)], "query_id long, doc_id long, label int, u double, v double")
    for fit in (fit_logistic, fit_svm):
        m = fit(df, ("u", "v"), (0.1, 10.0), 2)
        assert m.auc > 0.98 and m.weight[0] > 0 > m.weight[1]
        top = m.rank(df, 3).collect()
        assert len(top) == 30
        s = df.select("label", m.decision().alias("s")).collect()
        assert np.mean([(r.s > 0) == bool(r.label) for r in s]) > 0.95


def test_truncated_svd(spark):
    x = np.random.default_rng(0).normal(size=(30, 20)) * (np.random.default_rng(1).random((30, 20)) < 0.4)
    df = spark.createDataFrame([(i, [j for j, v in enumerate(row) if v], [float(v) for v in row if v]) for i, row in enumerate(x)], "doc_id long, i array<int>, w array<double>")
    out, share = linear.truncated_svd(df, 20, 6, passes=30)
    got = np.array([r.features for r in out.orderBy("doc_id").collect()])
    u, sizes, _ = np.linalg.svd(x)
    assert np.allclose(np.linalg.norm(got, axis=0), sizes[:6]) and np.allclose(np.abs(got), np.abs(u[:, :6] * sizes[:6]), atol=1e-6)
    assert share == pytest.approx(got.var(axis=0).sum() / x.var(axis=0).sum())
    assert len(linear.truncated_svd(df.limit(3), 20)[0].first().features) == 3


# ------------------------------------------------------------------ embeddings


def test_structured_encoding(spark):
    row = [(1, [" C34.1 ", "C34.1", "Z99.9", "C50.9"], {"Free T4": 3.0, "creatinine": 1.5}, {"her2": 9.0, "BRAF V600E": 50.0, "EGFR": 20.0}), (2, [], {}, {})]
    df = spark.createDataFrame(row, "i int, codes array<string>, labs map<string,double>, markers map<string,double>")
    got = {r.i: r for r in df.select("i", E.icd_indices(F.col("codes")).alias("ix"), E.structured_input(F.col("codes"), F.col("labs"), F.col("markers")).alias("x")).collect()}
    t = E.icd_table()
    assert got[1].ix == [1, 1, 0, 2] and len(ICD_CODES) == 26
    assert np.allclose(got[1].x[:16], (2 * t[0] + t[1]) / 3)
    labs, marks = got[1].x[16:33], got[1].x[33:]
    assert labs[0] == pytest.approx(0.1) and labs[9] == pytest.approx(0.2) and sum(x != 0 for x in labs) == 2
    assert marks[E.MARKERS.index("HER2")] == 0 and marks[4] == 0.5 and marks[1] == 0.2
    assert got[2].x == [0.0] * 53


def test_info_nce(spark):
    same = [(i, [1.0, 0.0], [1.0, 0.0]) for i in range(8)]
    df = spark.createDataFrame(same, "i long, anchor array<double>, positive array<double>")
    assert E.info_nce(df, batch=8).first().loss == pytest.approx(math.log(8))
    rng = np.random.default_rng(0)
    a, p = rng.normal(size=(10, 5)), rng.normal(size=(10, 5))
    df = spark.createDataFrame([(i, a[i].tolist(), p[i].tolist()) for i in range(10)], df.schema)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    assert E.info_nce(df, batch=64).first().loss == pytest.approx(nce(unit(a), unit(p))[0])
    assert E.alignment(df.limit(1)).first().negative_sim is None


def test_encoders(spark):
    m = E.structured_encoder()
    assert m.parameters() == {"trainable": 53 * 128 + 128 + 128 * 128 + 128, "frozen": 0}
    w, b = np.eye(2), np.zeros(2)
    w2, b2 = E.folded(w, b, np.array([2.0, 1.0]), np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.array([3.0, 1.0]), 0.0)
    assert np.allclose(np.array([[2.0, 3.0]]) @ w2 + b2, [[2 * 1 / math.sqrt(3) + 1, 3.0]])
    assert E.early_fusion(4, 4, 2).layers[0][0].shape == (10, 512)
    df = spark.createDataFrame([(1, "Some text"), (2, None), (3, "")], "i int, t string")
    got = {r.i: r.vec for r in E.encode_texts(df, "t").collect()}
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-9 and got[2] == got[3]
    h = df.select("i", E.hashed_text_features(F.col("t"), 8).alias("h")).collect()
    assert sum(map(abs, h[0].h)) in (0.0, 2.0) and h[1].h == [0.0] * 8


def test_texts_are_encoded_whole(spark):
    df = spark.createDataFrame([(i, "same " * 600 + end) for i, end in enumerate(("one", "two"))], "i int, t string")
    one, two = (r.vec for r in E.encode_texts(df, "t").orderBy("i").collect())
    assert one != two
    one, two = (r.vec for r in E.encode_texts(df, "t", max_tokens=512).orderBy("i").collect())
    assert one == two


@pytest.mark.parametrize("mode", ["local", "sync"])
def test_contrastive_training_lowers_the_loss(spark, tmp_path, mode):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 6))
    xs = [base @ rng.normal(size=(6, k)) for k in (7, 8, 9)]
    t = ContrastiveTrainer(*(E.random_dense(k, 16, 8, seed=k) for k in (7, 8, 9)), rate=0.01)
    df = spark.createDataFrame([(i, *(x[i].tolist() for x in xs)) for i in range(40)], "i int, text array<double>, image array<double>, structured array<double>")
    h = t.train(df, 15, 20, mode)
    assert h[-1]["loss"] < (0.6 if mode == "local" else 0.8) * h[0]["loss"] and h[0]["n_batches"] == 2
    t.save_all(spark, str(tmp_path / "m"))
    u = ContrastiveTrainer.load_all(spark, str(tmp_path / "m"))
    assert np.allclose(u.text(xs[0]), t.text(xs[0]))
    loss, g = t.batch([x[:6] for x in xs])
    w = t.text.layers[0][0]
    w[0, 0] += 1e-6
    up = t.batch([x[:6] for x in xs])[0]
    w[0, 0] -= 2e-6
    down = t.batch([x[:6] for x in xs])[0]
    assert abs((up - down) / 2e-6 - g[0][0][0][0, 0]) < 1e-4


def test_approximate_search_recall(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.where("vec_id % 25 = 0")
    exact = {(r.query_id, r.vec_id) for r in E.flat_search(v, q, 5).collect()}
    index = E.build_cells(v, 8)
    assert index.vectors.count() == v.count()
    every = {(r.query_id, r.vec_id) for r in E.cell_search(index, q, 5, probes=8).collect()}
    some = {(r.query_id, r.vec_id) for r in E.cell_search(index, q, 5, probes=6).collect()}
    assert every == exact and len(some & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("tables", ["sf0.001", "sf0.1"])
def test_registered_cell_search_recall(spark, tables):
    d = f"/root/testdata/{tables}"
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    exact = {(r.query_id, r.vec_id) for r in E.flat_search(v, v.where("vec_id % 25 = 0")).collect()}
    got = {(r.query_id, r.vec_id) for r in registry.queries()["o16_cell_search"](spark, d).collect()}
    assert len(got) == len(exact) and len(got & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("tables", ["sf0.001", "sf0.1"])
def test_registered_hash_search_recall(spark, tables):
    d = f"/root/testdata/{tables}"
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    exact = {(r.query_id, r.vec_id): r.score for r in E.flat_search(v, v.where("vec_id % 50 = 0")).collect()}
    got = {(r.query_id, r.vec_id): r.score for r in registry.queries()["o16_hash_search"](spark, d).collect()}
    assert {q for q, _ in got} == {q for q, _ in exact} and len(got) == len(exact)
    assert len(got.keys() & exact.keys()) >= 0.9 * len(exact) and all(got[p] == exact[p] for p in got.keys() & exact.keys())


def test_hash_search_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in E.hash_search(v, v, 1).orderBy("query_id").collect()]
    assert got[:2] == [(1, 1, 2, 1.0), (2, 1, 1, 1.0)] and all(r[0] != 4 for r in got)
    assert E.hash_search(v, v.where("vec_id = 0")).count() == 0


# ------------------------------------------------------------------ generated data


def test_generated_distributions(spark):
    c = Config(300, 40, 50, 20_000)
    t = dataset(spark, c)
    assert t.documents.select("doc_id").distinct().count() == 300 and t.documents.where("body_text like '%{%'").count() == 0
    kinds = {r.value: r.cnt / 20_000 for r in A.histogram(t.interactions, "interaction_type").collect()}
    assert all(abs(kinds[k] - s) < 0.02 for k, s in (("view", 0.5), ("click", 0.25), ("save", 0.1), ("dwell", 0.15)))
    assert abs(t.interactions.where("query_id is not null").count() / 20_000 - 0.6) < 0.02
    assert t.interactions.where("interaction_type = 'view' and dwell_time_seconds is not null").count() == 0
    assert t.query_document_relevance.groupBy("query_id").count().where("count <> 20").count() == 0
    own = t.interactions.join(t.physicians, "physician_id").join(t.documents.select("doc_id", F.col("specialty").alias("s")), "doc_id").agg(F.avg((F.col("s") == F.col("specialty")).cast("double"))).first()[0]
    assert own > 0.65
    m = structured_metadata(t.documents).agg(F.min(F.size("lab_values")), F.max(F.size("lab_values")), F.min(F.size("biomarker_levels")), F.max(F.size("biomarker_levels"))).first()
    assert tuple(m) == (3, 8, 1, 5)
    v = np.array([r.vec for r in image_features(t.documents.limit(5), 64).collect()])
    assert np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-5)
    again = dataset(spark, c).interactions
    assert again.exceptAll(t.interactions).count() == 0


def test_config_file(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("data:\n  num_documents: 10  # few\n  num_queries: 3\nranking:\n  num_documents: 99\n")
    assert Config.read(str(p)) == Config(10, 500, 3, 75_000)


def test_noise_free_grades(spark):
    docs = spark.createDataFrame([(f"d{i}", "alpha beta" if i % 2 else "gamma") for i in range(30)], "doc_id string, body_text string")
    q = spark.createDataFrame([("q", "alpha beta")], "query_id string, query_text string")
    got = {r.doc_id: r.relevance_score for r in judgments(q, docs, 30, noise=False).collect()}
    assert len(got) == 20 and all(g == (3 if int(d[1:]) % 2 else 0) for d, g in got.items())


def test_interactions_cover_all_rows(spark):
    t = dataset(spark, Config(50, 5, 5, 10))
    assert interactions(spark, t.documents, 50, t.physicians, 5, 500).count() == 500


def test_recommendations(spark):
    from sparkwell.operators.collaborative import Factors

    rng = np.random.default_rng(0)
    u, v = rng.normal(size=(7, 4)), rng.normal(size=(30, 4))
    users = spark.createDataFrame([(f"p{i}", u[i].tolist()) for i in range(7)], "physician_id string, factors array<float>")
    items = spark.createDataFrame([(i, v[i].tolist()) for i in range(30)], "doc_id long, factors array<float>")
    f = Factors(users, items, spark.createDataFrame([(3, 1)], "doc_id long, n long"), 4)
    seen = spark.createDataFrame([("p0", int(np.argmax(v @ u[0]))), ("p1", 99)], "physician_id string, doc_id long")
    ask = spark.createDataFrame([("p0",), ("p1",), ("none",)], "physician_id string")
    got = f.recommend(ask, 5, seen).orderBy("physician_id", "rank").collect()
    want = [int(i) for i in np.argsort(-(v.astype(np.float32).astype(float) @ u[0].astype(np.float32).astype(float)))[1:6]]
    assert [r.doc_id for r in got if r.physician_id == "p0"] == want and len(got) == 10
    assert len(f.recommend(ask, 40).collect()) == 60
    z = {r.doc_id: r.factors for r in f.item_factors(spark.createDataFrame([(3,), (4,), (77,)], "doc_id long")).collect()}
    assert z[3] == z[77] == [0.0] * 4 and z[4] != z[3]
    assert f.user_factors(ask).where("physician_id = 'none'").first().factors == [0.0] * 4
    c = spark.createDataFrame([(3, [1.0]), (4, [2.0])], "doc_id long, features array<double>")
    assert {r.doc_id: len(r.features) for r in f.augmented(c).collect()} == {3: 5, 4: 5}


def test_als_prefers_the_own_block(spark):
    from sparkwell.operators.collaborative import fit_als

    rows = [(f"p{i}", f"d{j}", int((i < 5) == (j < 5)) * 3) for i in range(10) for j in range(10) if (i < 5) == (j < 5) and (i + j) % 4]
    m = spark.createDataFrame(rows, "physician_id string, doc_id string, weighted_score long").withColumn("confidence", 1 + 40 * F.col("weighted_score"))
    f = fit_als(m, 2, 10)
    got = f.recommend(spark.createDataFrame([("p0",)], "physician_id string"), 5).collect()
    assert {r.doc_id for r in got} == {f"d{j}" for j in range(5)}
    assert f.reconstruction(m).first().reconstruction_loss > 0


def test_flat_search_over_a_grid(spark, monkeypatch):
    """More queries than are broadcast: dealt with the vectors over a grid, with the same rows; the alignment's search too."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(80)] + [(80, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    pairs = spark.createDataFrame([(i, rng.standard_normal(4).tolist(), rng.standard_normal(4).tolist()) for i in range(40)], "i long, anchor array<double>, positive array<double>")
    want, aligned = sorted(map(tuple, E.flat_search(v, v.where("vec_id % 3 = 0"), 4).collect())), E.alignment(pairs).first()
    inside = E.alignment(pairs, 40).first()  # one batch of all, pair by pair
    assert all(abs(aligned[c] - inside[c]) < 1e-9 for c in ("n", "positive_sim", "negative_sim", "top1_accuracy"))
    for name, n in (("TILE_ROWS", 3), ("VECTOR_ROWS", 5), ("HELD_QUERIES", 7), ("SHARD_ROWS", 20)):
        monkeypatch.setattr(E, name, n)
    assert sorted(map(tuple, E.flat_search(v, v.where("vec_id % 3 = 0"), 4).collect())) == want
    assert all(abs(a - b) < 1e-9 for a, b in zip(E.alignment(pairs).first(), aligned, strict=True))


def test_tfidf_leaves_stop_words_out(spark):
    docs = spark.createDataFrame([(1, "the heart and the lung"), (2, "The a I heart")], "doc_id long, body_text string")
    assert {"the", "and", "of"} < set(B.ENGLISH_STOP_WORDS)
    assert {r.term for r in B.tfidf(docs).collect()} == {"heart", "lung"}
    assert {r.term for r in B.tfidf(docs, stop_words=("heart",)).collect()} == {"the", "and", "lung"}


def test_folds_are_even_within_labels(spark):
    df = spark.createDataFrame([(i % 3, i, int(i % 4 == 0)) for i in range(103)], "query_id int, doc_id int, label int")
    got = linear.folds(df, n=5).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in got if r.label == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_truncated_svd_explains_what_its_features_vary(spark, monkeypatch):
    """The share comes from the eigenvalues, without a pass over the features, and is that of the features."""
    rng = np.random.default_rng(5)
    x = (rng.random((40, 15)) < 0.4) * rng.random((40, 15))
    df = spark.createDataFrame([(d, [int(i) for i in np.flatnonzero(r)], [float(v) for v in r[r > 0]]) for d, r in enumerate(x)], "doc_id int, i array<int>, w array<double>").repartition(7)
    monkeypatch.setattr(F, "posexplode", lambda c: pytest.fail("every feature becomes a row"))
    out, share = linear.truncated_svd(df, 15, 4)
    f = np.array([r.features for r in out.orderBy("doc_id").collect()])
    assert share == pytest.approx(f.var(axis=0).sum() / x.var(axis=0).sum(), abs=1e-6)
