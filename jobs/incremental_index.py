"""Keeps a BM25 index of a growing document table and answers all search queries from it.

    python -m jobs.incremental_index --config jobs/incremental_index.json --documents PATH --queries PATH --out PATH

The document table is read as a file stream: a run tokenizes the files that came since the last one, no others, and stores
the index's rows by batch and language. The first document of an id stays (of one batch, the least by its values); documents
without an id are left out. Every query is then ranked over the whole index, whose weights change with every new document;
the answers replace the former ones, partitioned by the documents' language.

out/index/batch=N/<partition>=...   doc_id, dl, terms, tfs
out/segments/batch=N                the same, inverted in segments for search
out/frequencies/batch=N             term, df
out/results/<partition>=...         query_id, rank, doc_id, score

A batch writes to folders of its own and answers are computed from the index alone, so a run that failed anywhere is simply
run again; a run without new files gives the same answers.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobs.config import load, logger
from sparkwell.operators import blockmax, retrieval
from sparkwell.sources.shared import LARGE_ROWS
from sparkwell.streaming.ingest import batch_path, file_stream, ingest

DEFAULTS = {"id": "doc_id", "text": "text", "partition": "lang", "query_id": "item_id", "query_text": "text", "files_per_batch": 64, "top_k": 10, "k1": 1.5, "b": 0.75}

log = logger("incremental_index")


def results(spark: SparkSession, documents: str, queries: str, out: str, config: dict | None = None) -> DataFrame:
    """The answers as they stand: (query_id, rank, doc_id, score, partition), of the types that the tables' ids have."""
    c = DEFAULTS | (config or {})
    d, q = spark.read.parquet(documents).schema, spark.read.parquet(queries).schema
    schema = T.StructType([T.StructField("query_id", q[c["query_id"]].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", d[c["id"]].dataType), T.StructField("score", T.DoubleType()), T.StructField(c["partition"], d[c["partition"]].dataType)])
    return spark.read.schema(schema).option("basePath", f"{out}/results").parquet(f"{out}/results")


def run(spark: SparkSession, documents: str, queries: str, out: str, config: dict | None = None, checkpoint: str | None = None) -> dict[str, int]:
    """Take in what is new, answer all queries; gives the numbers that were logged."""
    c = DEFAULTS | (config or {})
    index, segments, frequencies, checkpoint = f"{out}/index", f"{out}/segments", f"{out}/frequencies", checkpoint or f"{out}/checkpoint"
    stream = file_stream(spark, documents, c["files_per_batch"]).select(c["id"], c["partition"], c["text"])
    counts = {"batches": 0, "read": 0, "indexed": 0}

    def rows(new: DataFrame) -> DataFrame:
        return retrieval.counted(new, c["id"], c["text"], (c["partition"],)).withColumnRenamed("doc_id", c["id"])

    def also(stored: DataFrame, n: int, read: int) -> None:
        blockmax.segments(stored.withColumnRenamed(c["id"], "doc_id")).write.mode("overwrite").options(**LARGE_ROWS).parquet(batch_path(segments, n))
        retrieval.document_frequencies(spark.read.parquet(batch_path(segments, n))).write.mode("overwrite").parquet(batch_path(frequencies, n))
        indexed = stored.count()
        for name, m in (("batches", 1), ("read", read), ("indexed", indexed)):
            counts[name] += m
        log.info("batch %d: %d rows read, %d new documents indexed in %s", n, read, indexed, batch_path(index, n))

    ingest(stream, index, checkpoint, [c["id"]], rows, (c["partition"],), also).awaitTermination()
    log.info("read %d rows in %d new batches of %s", counts["read"], counts["batches"], documents)

    stored = spark.read.schema(rows(spark.createDataFrame([], stream.schema)).schema).option("basePath", index).parquet(index)
    df = spark.read.schema("term string, df long, batch int").parquet(frequencies).groupBy("term").agg(F.sum("df").alias("df"))
    held = retrieval.Index(stored.withColumnRenamed(c["id"], "doc_id"), spark.read.parquet(segments), df)
    asked = spark.read.parquet(queries).select(F.col(c["query_id"]).alias("query_id"), F.col(c["query_text"]).alias("query_text"))
    best = retrieval.retrieve(held, asked, c["top_k"], c["k1"], c["b"])
    kind = held.docs.select("doc_id", c["partition"])
    best = best.join(kind, "doc_id").select("query_id", "rank", "doc_id", "score", c["partition"])
    best.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(c["partition"]).parquet(f"{out}/results")
    counts["answers"] = results(spark, documents, queries, out, c).count()
    log.info("wrote %d answers to %s/results", counts["answers"], out)
    return counts


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("config", "checkpoint"):
        p.add_argument(f"--{name}")
    for name in ("documents", "queries", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--master", help="where the session is not started by spark-submit")
    a = p.parse_args()

    from sparkwell.session import SETTINGS, ship_package

    builder = SparkSession.builder.appName("incremental_index").config(map=SETTINGS)
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    try:
        ship_package(spark)
        run(spark, a.documents, a.queries, a.out, load(a.config, DEFAULTS), a.checkpoint)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
