"""Streams against batch results on closed windows, and late rows."""

import datetime as dt

from pyspark.sql import functions as F

from sparkwell.streaming.ctr import read_interactions, sessions, start_sink, windowed_ctr

SCHEMA = "interaction_type string, doc_id string, physician_id string, timestamp timestamp"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def rows(day, kinds):
    return [(k, f"d{i}", f"p{i % 2}", dt.datetime(2024, 1, day, 10, i)) for i, k in enumerate(kinds)]


def run(spark, stream, tmp_path):
    q = start_sink(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_weeks_begin_on_monday_and_close(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, rows(1, ["view", "view", "click", "dwell"]) + rows(7, ["view"]) + rows(8, ["click"]) + rows(20, ["view"]))
    got = {r.start.day: r for r in run(spark, windowed_ctr(read_interactions(spark, src, spark.read.parquet(src).schema)), tmp_path).collect()}
    assert set(got) == {1, 8}  # the last week is still open
    assert (got[1].click_count, got[1].view_count, got[1].ctr) == (1, 3, 1 / 3) and got[8].ctr == 0.0


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, rows(1, ["view", "click"]))
    schema = spark.read.parquet(src).schema
    stream = lambda: windowed_ctr(read_interactions(spark, src, schema), "1 day", start=None, late="1 hour")
    run(spark, stream(), tmp_path)
    put(spark, src, rows(10, ["view"]))
    run(spark, stream(), tmp_path)
    put(spark, src, rows(1, ["click"]))  # late
    put(spark, src, rows(20, ["view"]))
    got = {r.start.day: r.click_count for r in run(spark, stream(), tmp_path).collect()}
    assert got[1] == 1


def test_sliding_windows_and_sessions(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, rows(1, ["view", "click"]) + rows(9, ["view"]))
    s = read_interactions(spark, src, spark.read.parquet(src).schema)
    got = run(spark, windowed_ctr(s, "2 days", "1 day", late="1 hour"), tmp_path / "a")
    assert got.where(F.col("view_count") == 1).count() >= 2
    got = run(spark, sessions(s, late="1 hour"), tmp_path / "b").collect()
    assert {(r.physician_id, r.interactions) for r in got} == {("p0", 1), ("p1", 1)}
