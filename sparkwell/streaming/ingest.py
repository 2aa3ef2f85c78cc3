"""Keyed ingestion from file streams: the first row of each key stays, and every batch can be repeated.

Each batch is written to a folder of its own, ``<path>/batch=<n>``, so a batch that is run again replaces what it wrote and
nothing else. Keys of earlier batches are anti-joined (Spark prunes the stored side to the key columns); of several rows
with one key in one batch the least by its values stays, so the result does not depend on the order of files or rows in a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet files of path, a folder or one file, as a stream with the schema they have now.

    A plain path must be a folder for Spark's file stream; a pattern may match files as well, so the last letter becomes one.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = path.rstrip("/")
    return reader.parquet(path if any(c in path for c in "*?[]{}") else f"{path[:-1]}[{path[-1]}]")


def first_of_batch(batch: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: the least by the other columns; rows with a null in the key are left out."""
    rest = [c for c in batch.columns if c not in keys]
    known = batch.dropna(subset=keys)
    if not rest:
        return known.distinct().select(batch.columns)
    return known.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*keys, "__row.*").select(batch.columns)


def batch_path(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def stored_batches(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """All rows with their batch; before: of earlier batches only. The schema makes an empty table readable."""
    if "batch" not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    df = spark.read.schema(schema).option("basePath", path).parquet(path)
    return df if before is None else df.where(F.col("batch") < before)


def new_rows(batch: DataFrame, n: int, path: str, keys: list[str], schema: T.StructType) -> DataFrame:
    """The rows of batch n whose key no earlier batch has stored."""
    first = first_of_batch(batch, keys)
    if n == 0:  # nothing is stored yet
        return first
    return first.join(stored_batches(batch.sparkSession, path, schema, n).select(*keys), keys, "left_anti").select(batch.columns)


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], rows: Callable[[DataFrame], DataFrame] | None = None, partition_by: tuple[str, ...] = (), also: Callable[[DataFrame, int, int], None] | None = None) -> StreamingQuery:
    """Take what is new in the stream into ``path`` and end.

    rows: turns new rows into those to store (the keys must stay); also: called with the rows of a batch as they are
    stored, its number and the number of rows read.
    """
    rows = rows or (lambda df: df)
    schema = rows(stream.sparkSession.createDataFrame([], stream.schema)).schema

    def take(batch: DataFrame, n: int) -> None:
        read = Observation()
        out = rows(new_rows(batch.observe(read, F.count(F.lit(1)).alias("n")), n, path, keys, schema))
        out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(batch_path(path, n))
        if also is not None:
            also(stored_batches(batch.sparkSession, path, schema).where(F.col("batch") == n), n, read.get["n"])

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
