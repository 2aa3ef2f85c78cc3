"""Temperature mixing against the definitions."""

import math
from collections import Counter, defaultdict

import pytest

from sparkwell.llm.mixing import mixture

SCHEMA = "doc_id long, text string, source string, epoch string"


def rows(sizes):
    out, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            out.append((i, "w " * (i % 7), s, "old"))
            i += 1
    return out


def tokens(r):
    return len((r[1] or "").split()) + 1


@pytest.mark.parametrize("limit", [1.0, 2.0, 5.0])
def test_repetition_limit_loses_nothing(spark, limit):
    data = rows({"a": 300, "b": 60, "c": 20, None: 10}) + [(None, None, "a", None), (5, "x", "b", "y")]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    out, p = mixture(spark, df, most_repeats=limit)
    got = out.collect()
    total = Counter()
    for r in data:
        total[r[2]] += tokens(r)
    drawn = Counter()
    copies = defaultdict(list)
    for r in got:
        drawn[r.source] += r.n_tokens
        copies[r.doc_id, r.text, r.source].append(r.epoch)
    assert {(r[0], r[1], r[2]) for r in data} == set(copies)
    assert all(sorted(e) == list(range(len(e))) for e in copies.values())
    share = {s: n / sum(total.values()) for s, n in total.items()}
    z = sum(x ** p["exponent"] for x in share.values())
    for s in total:
        want = p["budget"] * share[s] ** p["exponent"] / z
        assert want - 8 <= drawn[s] <= want * (1 + 1e-8) + 1e-6
        assert drawn[s] <= limit * total[s] * (1 + 1e-8)
    if limit > 1:  # the limit is reached by the smallest source
        assert abs(max(p["budget"] * share[s] ** p["exponent"] / z / total[s] for s in total) - limit) < 1e-3


def test_entropy_and_budget(spark):
    data = rows({"a": 400, "b": 100, "c": 25})
    df = spark.createDataFrame(data, SCHEMA)
    out, p = mixture(spark, df, budget=600, entropy=0.9, most_repeats=None)
    got = out.collect()
    w = {r.source: r.weight for r in got}
    assert abs(-sum(x * math.log(x) for x in w.values()) - 0.9) < 1e-4
    assert abs(sum(w.values()) - 1) < 1e-9
    drawn = Counter()
    for r in got:
        drawn[r.source] += r.n_tokens
    assert sum(drawn.values()) <= 600 and all(600 * w[s] - 8 <= drawn[s] <= 600 * w[s] for s in w)
    again = mixture(spark, df.repartition(7), budget=600, entropy=0.9, most_repeats=None)[0].collect()
    assert sorted((r.doc_id, r.epoch) for r in again) == sorted((r.doc_id, r.epoch) for r in got)


def test_clashing_columns(spark):
    data = [(i, "a b", "s" if i % 3 else "t", "e", "r", 7) for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, full string, rest string, weight int")
    out, _ = mixture(spark, df, most_repeats=1.5)
    assert out.columns == ["doc_id", "text", "source", "full", "rest", "n_tokens", "epoch", "weight", "block", "block_key"]
    assert {(r.full, r.rest) for r in out.collect()} == {("e", "r")} and {r.doc_id for r in out.collect()} == set(range(30))


def test_empty(spark):
    assert mixture(spark, spark.createDataFrame([], SCHEMA))[0].count() == 0


def test_many_null_ids_and_fine_blocks(spark, monkeypatch):
    """Rows without an id are cut one by one by their text, in blocks that follow the source's size; one very long text is drawn whole."""
    import sparkwell.llm.mixing as m

    monkeypatch.setattr(m, "BLOCKS", 2)
    monkeypatch.setattr(m, "BLOCK_ROWS", 20)
    data = [(None, f"text {i}", "a", None) for i in range(400)] + [(i, "some text here", "b", None) for i in range(30)] + [(99, "long " * 200_000, "c", None)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    total = sum(map(tokens, data))
    out, _ = mixture(spark, df, budget=total // 2, most_repeats=None, entropy=10.0)
    got = out.groupBy("source").agg({"n_tokens": "sum", "doc_id": "count", "*": "count"}).collect()
    w = {r.source: r.weight for r in out.select("source", "weight").distinct().collect()}
    drawn = {r.source: r["sum(n_tokens)"] for r in got}
    assert abs(drawn["a"] - total // 2 * w["a"]) <= 4 and out.select("block").distinct().count() > 5
    assert sorted(r.n_tokens for r in out.where("source = 'c'").select("n_tokens").distinct().collect()) in ([], [200_001])
