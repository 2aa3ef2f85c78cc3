"""The width of an approximate search follows from its measured recall, so that recall holds as tables grow."""

from pyspark.sql import functions as F

from sparkwell.operators import embeddings as E


def test_width_is_doubled_until_recall_is_reached(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    poor = lambda q, w: E.flat_search(v, q).where(F.col("rank") <= w)  # noqa: E731 a width of w finds the w best of ten
    assert E.wide_enough(poor, v, 2, probes=20) == 16
    assert E.wide_enough(poor, v, 10, probes=20) == 10
    assert E.wide_enough(lambda q, w: E.flat_search(v, q).limit(0), v, 2, probes=20) >= v.count()  # ends at all vectors
