"""The learned text encoder."""

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkwell.operators import embeddings as E
from sparkwell.operators import text_encoder as T


def test_co_occurrences(spark):
    texts = ["a b a c", "b  B, a", None, "", "x a x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    want = Counter()
    for t in texts:
        w = T._TOKEN.findall((t or "").lower())
        for i, a in enumerate(w):
            for d in (1, 2):
                if i + d < len(w) and {a, w[i + d]} <= {"a", "b", "c"}:
                    want[a, w[i + d]] += 1 / d
                    want[w[i + d], a] += 1 / d
    got = {("abc"[r.i], "abc"[r.j]): r.n for r in T.co_occurrences(df, ["a", "b", "c"], "t", 2).collect()}
    assert got == pytest.approx(dict(want))


def test_words_of_one_topic_are_near(spark):
    """Words that never meet but share their company have near vectors."""
    rng = np.random.default_rng(1)
    topics = [[f"{c}{i}" for i in range(12)] for c in "pqr"]
    rows = [(i, " ".join(rng.choice(topics[i % 3][: 6 + 6 * (i % 2)][-6:] + [f"{'pqr'[i % 3]}hub"], 30))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id int, body_text string").repartition(3)
    e = T.learn(df, vocabulary=60, width=6)
    at = {t: n for n, t in enumerate(e.terms)}
    unit = E._unit(e.table)
    near = lambda a, b: float(unit[at[a]] @ unit[at[b]])
    assert near("p0", "p5") > near("p0", "q5") + 0.3
    assert e.parameters() == {"trainable": 0, "frozen": e.table.size + e.centre.size}
    out = e.encode(spark.createDataFrame([(1, "p0 p1"), (2, None), (3, "unknown words")], "i int, t string"), "t").orderBy("i").collect()
    assert abs(np.linalg.norm(out[0].vec) - 1) < 1e-9 and not any(out[1].vec) and not any(out[2].vec)


def test_held_out_alignment_beats_the_hashed_substitute(spark):
    """Halves of held-out documents: the learned encoder parts matching from other halves by 0.2 more than hashed counts do."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.size(F.split("text", " ")) > 40)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    encoder = T.learn(d.where(~held).withColumnRenamed("text", "body_text"), vocabulary=2048)
    words = F.split("text", " ")
    half = F.floor(F.size(words) / 2).cast("int")
    halves = d.where(held).dropDuplicates(["text"]).select("doc_id", F.array_join(F.slice(words, F.lit(1), half), " ").alias("a"), F.array_join(F.slice(words, half + 1, F.size(words)), " ").alias("b"))

    def apart(encode):
        p = encode(encode(halves, "a", "anchor"), "b", "positive").select(F.col("doc_id").alias("i"), "anchor", "positive")
        r = E.alignment(p).first()
        return r.positive_sim - r.negative_sim

    learned = apart(lambda df, c, out: encoder.encode(df, c, out))
    hashed = apart(lambda df, c, out: E.encode_texts(df, c, out=out))
    assert learned > hashed + 0.2


def test_empty_corpus(spark):
    e = T.learn(spark.createDataFrame([], "body_text string"))
    assert e.terms == [] and e.encode(spark.createDataFrame([("a",)], "t string"), "t").first().vec is not None


def _watched(spark, monkeypatch, words):
    """A stand-in for a table of texts whose task runs here, and the sizes of its merges."""
    merges, merged = [], T._merged
    monkeypatch.setattr(T, "_merged", lambda k, w: (merges.append(sum(map(len, k))), merged(k, w))[1])
    held = type("Held", (), {"value": [f"w{i}" for i in range(int(words.max()) + 1)]})

    class Docs:
        sparkSession = type("S", (), {"sparkContext": type("C", (), {"broadcast": staticmethod(lambda terms: held)})})

        def select(self, text):
            return self

        def mapInArrow(self, run, schema):
            texts = pa.array([" ".join(f"w{i}" for i in r) for r in words])
            got = pd.concat([b.to_pandas() for b in run(iter([pa.RecordBatch.from_arrays([texts], ["t"])]))])
            return spark.createDataFrame(got if len(got) < 100_000 else got[:0], schema)

    return Docs(), held.value, merges


def test_co_occurrences_are_merged_in_proportion(spark, monkeypatch):
    """More different pairs than a merge waits for: they are not sorted again with every text."""
    words = np.random.default_rng(3).integers(0, 1500, (300, 1000))
    docs, terms, merges = _watched(spark, monkeypatch, words)
    T.co_occurrences(docs, terms, "t")
    assert sum(merges) < 5 * 2 * T.WINDOW * words.size


def test_co_occurrences_given_away_in_parts(spark, monkeypatch):
    words = np.random.default_rng(3).integers(0, 200, (400, 60))
    for name, value in (("MERGE", 500), ("WORDS", 100), ("MOST_HELD", 3000)):
        monkeypatch.setattr(T, name, value)
    docs, terms, merges = _watched(spark, monkeypatch, words)
    got = {(r.i, r.j): r.n for r in T.co_occurrences(docs, terms, "t", 2).collect()}
    want = Counter()
    for r in words.tolist():
        for i, a in enumerate(r):
            for d in (1, 2):
                if i + d < len(r):
                    want[a, r[i + d]] += 1 / d
                    want[r[i + d], a] += 1 / d
    assert got == pytest.approx(dict(want)) and len(merges) > 5
