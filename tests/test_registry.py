"""Every registered query against DuckDB on the smallest tables."""

import inspect
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from sparkwell.operators import collaborative, lambdarank, linear  # noqa: E402
from sparkwell.operators import retrieval as B  # noqa: E402
from sparkwell.plans import registry  # noqa: E402
from sparkwell.sources import bridge  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    if isinstance(v, list):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_values(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry_and_names(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(registry.queries()) <= set(q)
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["j11_query_split", "f14_stratified_split", "l6_lambdarank", "c4_item_factors", "c5_augmented_features", "t5_recommendations", "o4_structured_encoder", "o6_image_encoder", "o7_text_encoder", "o7_learned_text_encoder", "o5_encoded_tensors", "o14_early_fusion", "o15_projection", "o15_neighbour_embedding", "o16_quantised_search", "o16_graph_search", "o11_contrastive_training", "g8_structured_metadata", "b11_truncated_svd"])
def test_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["f9_logistic_ranking", "f11_svm_ranking"])
def test_linear_rankings_run_to_the_end(spark, sf, name):
    """The full grid over five folds: ranks without gaps in falling order of the score, all queries ranked."""
    r = registry.queries()[name](spark, sf).orderBy("query_id", "rank").collect()
    by = {}
    for x in r:
        by.setdefault(x.query_id, []).append(x)
    assert len(by) == bridge.judgments(spark, sf).select("query_id").distinct().count()
    assert all([x["rank"] for x in v] == list(range(1, len(v) + 1)) and [x.score for x in v] == sorted((x.score for x in v), reverse=True) for v in by.values())


def test_ablation_and_factor_studies_run_to_the_end(spark, sf):
    q = registry.queries()
    a = q["f13_feature_ablation"](spark, sf).orderBy("n_features").collect()
    assert [x.n_features for x in a] == list(range(1, 11)) and a[-1].train_accuracy >= a[0].train_accuracy > 0.5
    c = q["c6_convergence"](spark, sf).orderBy("iterations").collect()
    assert [x.iterations for x in c] == [1, 3, 5, 10, 15, 20, 25, 30] and all(x.reconstruction_loss > 0 for x in c)
    s = q["c7_factor_sizes"](spark, sf).orderBy("factors").collect()
    assert [x.factors for x in s] == [32, 64, 128, 256] and s[1].memory_mb == pytest.approx(2 * s[0].memory_mb)
    one = q["c1_als_reconstruction"](spark, sf).first()
    at = next(x for x in c if x.iterations == 15)
    assert one.reconstruction_loss == pytest.approx(at.reconstruction_loss, rel=1e-3) and s[2].reconstruction_loss > 0


def test_methods_are_compared_on_one_split(spark, sf):
    r = {x.method: x for x in registry.queries()["e2_method_ordering"](spark, sf).collect()}
    assert set(r) == {"bm25", "logistic", "svm", "lambdarank", "lambdarank_als"}
    assert len({x.n_queries for x in r.values()}) == 1 and all(0.5 < x.ndcg <= 1 for x in r.values())


@pytest.mark.parametrize("ids", [[3, 70, 1000, -5, 1], list(range(31)), list(range(100, 162)), [-40, 7, 7], []])
def test_judgments_of_any_ids(spark, tmp_path, ids):
    spark.createDataFrame([(i, f"a b w{i % 3}", "en", f"src{i % 20}", 5) for i in ids], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, "a b w1") for i in (0, 1, 5, 33)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    con.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, event_type TEXT, value DOUBLE, ts TIMESTAMP, props TEXT)")
    want = con.execute(bridge.SQL + " SELECT query_id, doc_id, relevance_score FROM l_judgments").fetchall()
    assert sorted(map(tuple, bridge.judgments(spark, str(tmp_path)).collect())) == sorted(want)


class Called(Exception):
    pass


@pytest.mark.parametrize(
    ("name", "owner", "function"),
    [
        ("f9_logistic_ranking", linear, "fit_logistic"),
        ("f11_svm_ranking", linear, "fit_svm"),
        ("f13_feature_ablation", linear, "ablation"),
        ("b11_truncated_svd", B, "tfidf"),
        ("b11_truncated_svd", linear, "truncated_svd"),
        ("l6_lambdarank", lambdarank.Network, "random"),
        ("l6_lambdarank", lambdarank.Trainer, "__init__"),
        ("l6_lambdarank", lambdarank.Trainer, "train"),
        ("c1_als_reconstruction", collaborative, "fit_als"),
        ("c4_item_factors", collaborative, "fit_als"),
        ("c5_augmented_features", collaborative, "fit_als"),
        ("t5_recommendations", collaborative, "fit_als"),
        ("c6_convergence", collaborative, "convergence"),
        ("c7_factor_sizes", collaborative, "factor_sizes"),
    ],
)
def test_registered_with_the_default_job(spark, sf, monkeypatch, name, owner, function):
    expected = inspect.signature(getattr(owner, function))

    def stop(*args, **named):
        given = expected.bind(*args, **named)
        default = {k: p.default for k, p in expected.parameters.items() if p.default is not p.empty}
        assert {k: v for k, v in given.arguments.items() if k in default and v != default[k]} == {}
        raise Called

    monkeypatch.setattr(owner, function, stop)
    with pytest.raises(Called):
        registry.queries()[name](spark, sf)
