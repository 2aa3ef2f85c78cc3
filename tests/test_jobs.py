"""The two jobs: growing input, repeated and failed runs, date ranges, command lines."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import engagement_report, incremental_index
from jobs.config import load
from sparkwell.operators import retrieval
from sparkwell.streaming.ingest import batch_path, file_stream, ingest

ROOT = Path(__file__).resolve().parent.parent


def one_file(df, folder, name):
    """df as one more Parquet file of the folder."""
    part = Path(folder).parent / f"part-{name}"
    df.coalesce(1).write.parquet(str(part))
    Path(folder).mkdir(exist_ok=True)
    next(part.glob("*.parquet")).rename(Path(folder) / f"{name}.parquet")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def expected(spark, docs, queries):
    """The answers of a batch index over docs."""
    asked = queries.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    best = retrieval.retrieve(retrieval.fit(docs, text="text"), asked)
    return rows(best.join(docs.select("doc_id", "lang"), "doc_id").select("query_id", "rank", "doc_id", "score", "lang"))


@pytest.fixture
def three(spark, sf, tmp_path):
    """Documents in three files: the second repeats ids of the first with other texts, the third one row twice and a null id."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = d.where("doc_id < 90"), d.where("doc_id between 80 and 150").withColumn("text", F.concat(F.lit("newer "), "text"))
    c = d.where("doc_id > 145").union(d.where("doc_id > 195")).union(d.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    kept = d.where("doc_id < 90").union(b.where("doc_id >= 90")).union(d.where("doc_id > 150"))
    return str(tmp_path / "documents"), [a, b, c], kept


def test_index_grows_with_its_input(spark, sf, tmp_path, three):
    folder, (a, b, c), kept = three
    queries, out = f"{sf}/benchmark.parquet", str(tmp_path / "out")
    one_file(a, folder, "a")
    first = incremental_index.run(spark, folder, queries, out)
    assert (first["batches"], first["read"], first["indexed"]) == (1, 90, 90)
    assert rows(incremental_index.results(spark, folder, queries, out)) == expected(spark, a, spark.read.parquet(queries))
    before = {p: p.stat().st_mtime_ns for p in Path(out, "index").rglob("*.parquet")}
    one_file(b, folder, "b")
    one_file(c, folder, "c")
    second = incremental_index.run(spark, folder, queries, out, {"files_per_batch": 1})
    assert (second["batches"], second["read"]) == (2, b.count() + c.count()) and first["indexed"] + second["indexed"] == kept.count()
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # what was indexed isn't written again
    want = expected(spark, kept, spark.read.parquet(queries))
    assert rows(incremental_index.results(spark, folder, queries, out)) == want
    third = incremental_index.run(spark, folder, queries, out)
    assert third["read"] == third["batches"] == 0 and rows(incremental_index.results(spark, folder, queries, out)) == want


def test_failed_batch_is_repeated_whole(spark, sf, tmp_path, three, monkeypatch):
    folder, parts, kept = three
    for name, df in zip("abc", parts, strict=True):
        one_file(df, folder, name)
    out, queries = str(tmp_path / "out"), f"{sf}/benchmark.parquet"
    real, calls = retrieval.document_frequencies, []

    def fails_once(docs):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return real(docs)

    monkeypatch.setattr(retrieval, "document_frequencies", fails_once)
    with pytest.raises(Exception, match="lost"):
        incremental_index.run(spark, folder, queries, out, {"files_per_batch": 2})
    incremental_index.run(spark, folder, queries, out, {"files_per_batch": 2})
    index = spark.read.parquet(f"{out}/index")
    assert index.count() == index.select("doc_id").distinct().count() == kept.count()
    # two files came in one batch: of an id in both, the least row stays, whatever the order of the files
    a, b, c = (x.where("doc_id is not null") for x in parts)
    both = a.union(b).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x")).select("doc_id", "x.*")
    rest = c.select("doc_id", "lang", "text").distinct().join(both, "doc_id", "left_anti")
    held = sorted(p.name for p in Path(out, "index").iterdir())
    assert held == ["batch=0", "batch=1"]
    if index.where("batch = 0").count() == both.count():
        assert rows(incremental_index.results(spark, folder, queries, out)) == expected(spark, both.unionByName(rest), spark.read.parquet(queries))


def test_empty_input(spark, sf, tmp_path):
    folder = str(tmp_path / "documents")
    one_file(spark.read.parquet(f"{sf}/documents.parquet").limit(0), folder, "a")
    r = incremental_index.run(spark, folder, f"{sf}/benchmark.parquet", str(tmp_path / "out"))
    assert r["indexed"] == r["answers"] == 0
    empty = copied(spark, sf, tmp_path / "tables", lambda e: e.limit(0))
    assert engagement_report.run(spark, empty, str(tmp_path / "report")) == {"rows": 0, "weeks": 0, "documents": 200}


def test_first_judgment_wins_over_batches(spark, tmp_path):
    """Replayed and overlapping batches give what one pass over all rows in their order gives."""
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    judged = lambda *r: spark.createDataFrame(r, "query_id int, doc_id int, relevance_score int")
    one_file(judged((1, 1, 3), (1, 2, 0), (None, 1, 2)), folder, "a")
    ingest(file_stream(spark, folder), out, check, ["query_id", "doc_id"]).awaitTermination()
    one_file(judged((1, 1, 0), (2, 1, 2), (2, 1, 1), (2, 1, 2)), folder, "b")
    ingest(file_stream(spark, folder), out, check, ["query_id", "doc_id"]).awaitTermination()
    want = [(1, 1, 3), (1, 2, 0), (2, 1, 1)]
    assert rows(spark.read.parquet(out).drop("batch")) == want
    # a new checkpoint offers all files again: as one batch, whose folder is replaced, nothing is doubled
    ingest(file_stream(spark, folder), str(tmp_path / "out2"), str(tmp_path / "check2"), ["query_id", "doc_id"]).awaitTermination()
    assert rows(spark.read.parquet(batch_path(str(tmp_path / "out2"), 0))) == [(1, 1, 0), (1, 2, 0), (2, 1, 1)]


def copied(spark, sf, folder, events=None):
    for t in ("documents", "benchmark", "events"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        (events(df) if events and t == "events" else df).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def test_report_replaces_only_the_weeks_asked_for(spark, sf, tmp_path):
    out = str(tmp_path / "out")
    # the first half of the events alone, then all
    half = copied(spark, sf, tmp_path / "half", lambda e: e.where("ts < '2024-01-16'"))
    whole = engagement_report.run(spark, half, out)
    before = {p: p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet")}
    old = {r.week_num: r.n for r in engagement_report.weeks(spark, out).groupBy("week_num").agg(F.sum("interactions").alias("n")).collect()}
    part = engagement_report.run(spark, sf, out, {"since": "2024-01-18"})
    assert part["weeks"] > whole["weeks"]
    kept = [p for p, t in before.items() if p.exists() and p.stat().st_mtime_ns == t]
    assert kept and {p.parent.name for p in kept} < {p.parent.name for p in before}
    engagement_report.run(spark, sf, str(tmp_path / "all"))
    want, got = (engagement_report.weeks(spark, p) for p in (str(tmp_path / "all"), out))
    late = "week_num >= '03'"
    assert rows(got.where(late)) == rows(want.where(late)) and rows(got.where(late)) != []
    for r in got.where("week_num < '03'").groupBy("week_num").agg(F.sum("interactions").alias("n")).collect():
        assert old[r.week_num] == r.n  # as first written
    assert rows(engagement_report.documents(spark, out)) == rows(engagement_report.documents(spark, str(tmp_path / "all")))  # by all interactions
    again = rows(got)
    engagement_report.run(spark, sf, out, {"since": "2024-01-18"})
    assert rows(engagement_report.weeks(spark, out)) == again


def test_config(tmp_path):
    for job in (incremental_index, engagement_report):
        assert load(str(ROOT / "jobs" / f"{job.__name__.split('.')[-1]}.json"), job.DEFAULTS) == job.DEFAULTS
    (tmp_path / "x.json").write_text('{"topk": 3}')
    with pytest.raises(ValueError, match="topk"):
        load(str(tmp_path / "x.json"), incremental_index.DEFAULTS)


@pytest.mark.parametrize("job", ["incremental_index", "engagement_report"])
def test_command_line(sf, tmp_path, job):
    inputs = ["--documents", f"{sf}/documents.parquet", "--queries", f"{sf}/benchmark.parquet"] if job == "incremental_index" else ["--tables", sf]
    cmd = [sys.executable, "-m", f"jobs.{job}", "--config", str(ROOT / "jobs" / f"{job}.json"), *inputs, "--out", str(tmp_path / "out"), "--master", "local[2]"]
    r = subprocess.run(cmd, cwd=ROOT, env={**os.environ, "PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=200)
    assert r.returncode == 0, r.stderr[-2000:]
    assert " read " in r.stderr and " wrote " in r.stderr and list((tmp_path / "out").rglob("*.parquet"))


def test_jobs_leave_the_training_data_operators_alone():
    for p in [*Path(ROOT, "jobs").glob("*.py"), Path(__file__)]:
        assert not any(line.startswith(("from", "import")) and ("llm" in line or "corpus_pipeline" in line) for line in p.read_text().splitlines()), p
