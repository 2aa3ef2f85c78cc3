"""Quality: the classifier on held-out labels, shrinkage against the formulas, edges."""

import numpy as np
from pyspark.sql import functions as F

import sparkwell.llm.quality as q
from sparkwell.llm.quality import FEATURES, assess, classify, fit, learn

SITE = ("source", "lang")


def test_fit_recovers_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, len(FEATURES)))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 3] + 0.5)))).astype(float)
    c = fit(x, y)
    w = c.weight / c.scale
    assert abs(w[0] - 2) < 0.2 and abs(w[3] + 1) < 0.2 and np.abs(np.delete(w, [0, 3])).max() < 0.2


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    part = F.col("doc_id") % 4 == 0
    model = learn(spark, docs, labels.where(~part), *SITE)
    got = classify(spark, docs, model, *SITE, ["doc_id"]).join(labels.where(part), "doc_id").select("kept", labels.quality.alias("y")).collect()
    good = [r.kept for r in got if r.y == 1]
    bad = [r.kept for r in got if r.y == 0]
    assert len(bad) > 50 and np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_posteriors_follow_the_formulas(spark):
    rows = [(i, ("good words here " * 3) if i % 5 else "## $$ %% ^^", ["a", "b", None][i % 3], ["x", None][i % 2], "z") for i in range(120)]
    rows += [(500, "lonely good words", "rare", "x", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(60)] + [(3, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    m = learn(spark, docs, labels, *SITE)
    got = {r.doc_id: r for r in classify(spark, docs, m, *SITE, ["doc_id", "source", "lang", "kept"]).collect()}
    assert len(got) == 121 and all(got[i].kept == bool(i % 5) for i in range(120))
    p = {i: got[i].evidence for i in got}
    mean = np.mean(list(p.values()))
    assert abs(mean - m.mean) < 1e-9
    for r in rows:
        host = [p[s[0]] for s in rows if s[2] == r[2]]
        path = [p[s[0]] for s in rows if s[2:4] == r[2:4]]
        hp = (sum(host) + m.host_strength * mean) / (len(host) + m.host_strength)
        pp = (sum(path) + m.path_strength * hp) / (len(path) + m.path_strength)
        assert abs(got[r[0]].host_posterior - hp) < 1e-9 and abs(got[r[0]].path_posterior - pp) < 1e-9
        logit = lambda q: np.log(q / (1 - q))
        want = 1 / (1 + np.exp(-(logit(np.clip(p[r[0]], 1e-6, 1 - 1e-6)) + logit(pp) - logit(mean))))
        assert abs(got[r[0]].quality - want) < 1e-9


def test_edges(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", "x"), (3, " \n", None, None), (None, "some words", "a", None), (4, "w " * 30000, "a", "x"), (4, "w " * 30000, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    m = learn(spark, docs, none, *SITE)
    got = classify(spark, docs, m, *SITE, ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.kept) for r in got) == [("1", False), ("2", False), ("3", False), ("4", True), ("4", True), ("None", True)]
    empty = docs.limit(0)
    m = learn(spark, empty, none, *SITE)
    assert classify(spark, empty, m, *SITE, ["doc_id"]).count() == 0


def test_repeated_labelled_rows_and_many_sites(spark, monkeypatch):
    """One labelled id with many rows is one row of the sample; sites beyond the broadcast are joined, the hot ones aside; one pass gives the same."""
    rows = [(1, f"## $$ {i} %%" if i % 2 else "plain good words", "hot", "x") for i in range(300)]
    rows += [(10 + i, "plain good words " * (1 + i % 3) if i % 4 else "$$ ## |", f"h{i % 40}", ["x", None][i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (1, 1)] + [(10 + i, int(i % 4 > 0)) for i in range(100)], "doc_id long, quality int")
    x, y = q._sample(docs, labels, "doc_id", "text", "quality")
    assert len(x) == len(y) == 101
    model = learn(spark, docs, labels, *SITE)
    rounded = lambda df: sorted((r.doc_id, r.source, r.lang or "", round(r.quality, 9), round(r.host_posterior, 9), r.kept) for r in df.collect())
    want = rounded(classify(spark, docs, model, *SITE, ["doc_id", "source", "lang"]))
    assert rounded(assess(spark, docs, labels, *SITE, ["doc_id", "source", "lang"])) == want
    monkeypatch.setattr(q, "MOST_SITES", 0)
    monkeypatch.setattr(q, "HOT_SITES", 2)
    assert rounded(classify(spark, docs, model, *SITE, ["doc_id", "source", "lang"])) == want
    monkeypatch.setattr(q, "MOST_LABELLED", 7)
    assert len(q._sample(docs, labels, "doc_id", "text", "quality")[0]) <= 7


def by_loops(rows):
    """Mean, strengths and posteriors from (host, path, evidence) rows alone, site by site."""
    used = [r for r in rows if r[2] > 0]
    mean = sum(r[2] for r in used) / len(used)

    def strength(sites):
        """sites: (n, mean of the site, prior mean)."""
        n = sum(s[0] for s in sites)
        observed = sum(s[0] * (s[1] - s[2]) ** 2 for s in sites) / n
        sampling = sum(s[2] * (1 - s[2]) for s in sites) / n
        spread = sum(s[0] * s[2] * (1 - s[2]) for s in sites) / n
        between = observed - sampling
        return q.STRONGEST if between <= spread / q.STRONGEST else min(q.STRONGEST, max(1.0, spread / between - 1))

    def of(key):
        groups = {}
        for r in used:
            groups.setdefault(key(r), []).append(r[2])
        return groups

    hosts, paths = of(lambda r: r[0]), of(lambda r: r[:2])
    a = strength([(len(v), sum(v) / len(v), mean) for v in hosts.values()])
    host = {h: (sum(v) + a * mean) / (len(v) + a) for h, v in hosts.items()}
    b = strength([(len(v), sum(v) / len(v), host[h]) for (h, _), v in paths.items()])
    return mean, a, b, {(h, p): (host[h], (sum(v) + b * host[h]) / (len(v) + b)) for (h, p), v in paths.items()}


def test_strengths_and_posteriors_by_loops(spark):
    """Hosts drawn around a mean with strength 12, paths around their hosts with 30: the moments find both about again.

    A path's documents are part of its host's posterior, so the paths' strength comes out too large, the more so the fewer paths a
    host has (about 60 with 6 paths); here there are 30.
    """
    rng = np.random.default_rng(11)
    rows = []
    for h in range(120):
        p = rng.beta(12 * 0.7, 12 * 0.3)
        for path in range(30):
            r = rng.beta(30 * p, 30 * (1 - p))
            rows += [(f"h{h}", f"p{path}", 1.0 if rng.random() < r else 1e-9) for _ in range(int(rng.integers(3, 40)))]
    rows += [("h0", "p0", 0.0), ("only empty", "p", 0.0)]  # texts without a word
    scored = spark.createDataFrame(rows, "__host string, __path string, evidence double").repartition(4)
    mean, a, b, sites = by_loops(rows)
    m = q.site_model(scored, None)
    assert abs(m.mean - mean) < 1e-9 and abs(m.host_strength / a - 1) < 1e-6 and abs(m.path_strength / b - 1) < 1e-6
    assert 7 < m.host_strength < 20 and 20 < m.path_strength < 50
    got = {(r.host, r.path): (r.host_posterior, r.path_posterior) for r in m.sites.collect()}
    assert got.keys() == sites.keys() and m.n_sites == len(sites)
    assert all(abs(got[k][i] - sites[k][i]) < 1e-9 for k in sites for i in (0, 1))


def test_sites_that_only_sampling_parts_are_shrunk_most(spark):
    rng = np.random.default_rng(12)
    rows = [(f"h{i % 40}", f"p{i % 80}", 1.0 if rng.random() < 0.5 else 1e-9) for i in range(4000)]
    scored = spark.createDataFrame(rows, "__host string, __path string, evidence double")
    m = q.site_model(scored, None)
    mean, a, b, _ = by_loops(rows)
    assert abs(m.host_strength / a - 1) < 1e-6 and abs(m.path_strength / b - 1) < 1e-6 and m.host_strength > 100
