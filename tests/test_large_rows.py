"""Segments are rows of megabytes: their files' row groups stay small, whatever the partition's size; so do Arrow batches."""

from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkwell.operators import retrieval
from sparkwell.operators.matching import term_hits
from sparkwell.plans import registry
from sparkwell.sources import shared
from sparkwell.sources.shared import BATCH_BYTES, LARGE_ROWS, written

ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def large_batches(spark):
    """The session as a caller hands it over: batches of up to 64 MB."""
    now = spark.conf.get(ARROW)
    spark.conf.set(ARROW, str(64 << 20))
    yield
    spark.conf.set(ARROW, now.rstrip("b"))


def test_row_groups_of_large_rows(spark):
    rows = spark.range(0, 60, 1, 1).select("id", F.expr("cast(array_join(transform(sequence(1, 30000), x -> uuid()), '') as binary)").alias("x"))
    out = written(rows, "large", options=LARGE_ROWS)
    assert out.count() == 60
    groups = [m.row_group(i) for p in Path(out._written_at).glob("*.parquet") for m in [pq.ParquetFile(p).metadata] for i in range(m.num_row_groups)]
    assert len(groups) >= 3 and max(g.total_byte_size for g in groups) < 24 << 20


def test_segments_are_written_so(spark, monkeypatch):
    asked, real = {}, retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda d, name, path=None, options=None: (asked.__setitem__(name, options), real(d, name, path, options))[1])
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(20)], "doc_id long, body_text string")
    index = retrieval.fit(docs)
    assert index.segments.count() >= 1 and asked["segments"] == LARGE_ROWS
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= BATCH_BYTES


@pytest.mark.parametrize("rows", [100, 400])
def test_tokenizing_takes_batches_of_one_size(spark, monkeypatch, large_batches, rows):
    """A task of tokenizing holds no more of a larger partition (10 or 40 MB here)."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), pa.array([b.nbytes]), pa.array([[]], pa.list_(pa.string())), pa.array([[]], pa.list_(pa.int64()))], ["doc_id", "dl", "terms", "tfs"])

    monkeypatch.setattr(retrieval, "_counted", sizes)
    docs = spark.range(0, rows, 1, 4).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 20000)").alias("body_text"))
    got = [r.dl for r in retrieval.fit(docs).docs.collect()]
    assert sum(got) >= rows * 100_000 and max(got) < BATCH_BYTES + (1 << 18)


@pytest.mark.parametrize(("given", "bound"), [("64m", BATCH_BYTES), ("65536k", BATCH_BYTES), ("67108864b", BATCH_BYTES), ("67108864", BATCH_BYTES), ("1m", 1 << 20), ("4096", 4096)])
def test_batches_are_bounded_whatever_the_unit(spark, large_batches, given, bound):
    spark.conf.set(ARROW, given)
    retrieval.fit(spark.createDataFrame([(1, "a")], "doc_id long, body_text string"))
    assert spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() == bound


@pytest.mark.parametrize("name", ["l6_lambdarank", "l2_delta_ndcg", "l7_evaluated_ndcg", "l1_trainable_groups", "f8_standardized_features"])
def test_queries_tokenize_in_small_batches(spark, sf, monkeypatch, large_batches, name):
    """All of them tokenize the corpus by the step that bounds its batches (16 KB here, where a partition has some 100)."""
    real = retrieval._counted

    def checked(batches):
        def each():
            for b in batches:
                assert b.slice(0, b.num_rows - 1).nbytes < 1 << 15  # the last row may pass the bound
                yield b

        return real(each())

    monkeypatch.setattr(shared, "BATCH_BYTES", 1 << 14)
    monkeypatch.setattr(retrieval, "_counted", checked)
    assert registry.queries()[name](spark, sf).count() > 0


def test_searching_terms_takes_small_batches(spark, large_batches):
    docs = spark.createDataFrame([(1, "Heart failure")], "doc_id int, body_text string")
    hits = term_hits(docs, spark.createDataFrame([("heart",)], "term string"), "body_text")
    assert int(spark.conf.get(ARROW).rstrip("b")) <= BATCH_BYTES and [r.term for r in hits.collect()] == ["heart"]


def test_term_statistics_need_no_segments(spark):
    """Counts come from the documents' rows, by Spark's own expressions; once there are segments, from them, and are the same."""
    docs = spark.createDataFrame([(1, "b a a"), (1, "a c"), (2, ""), (3, None), (4, "C a")], "doc_id long, body_text string")
    index = retrieval.fit(docs)
    got = {r.term: r.df for r in index.terms.collect()}
    assert index.stored_segments is None and got == {"a": 3, "b": 1, "c": 2}
    other = retrieval.fit(docs)
    assert other.segments.count() >= 1 and sorted(map(tuple, other.terms.collect())) == sorted(map(tuple, index.terms.collect()))


def test_vectors_are_given_back_in_small_batches(spark, monkeypatch):
    """A batch of ids or texts is far smaller than its vectors, so these are not kept until it ends."""
    from sparkwell.operators import embeddings as E
    from sparkwell.sources import datagen

    made = []
    monkeypatch.setattr(F, "pandas_udf", lambda kind: lambda f: (made.append(f), lambda c: F.lit(None))[1])
    d = spark.createDataFrame([(1, "a", [1.0, 2.0])], "doc_id int, text string, x array<double>")
    datagen.image_features(d, width=8)
    E.encode(d, "x", E.random_dense(2, 3))
    E.encode_texts(d, "text", width=8, model=E.random_dense(8, 3))
    vectors = [[1.0, 2.0], None] * 1500
    for f, values in zip(made, (range(3000), vectors, ["a b", None] * 1500), strict=True):
        got = list(f(iter([pd.Series(values)])))
        assert max(map(len, got)) <= 256 and sum(map(len, got)) == 3000
        if values is vectors:
            assert [v is None for g in got for v in g] == [False, True] * 1500
