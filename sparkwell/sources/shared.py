"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_sparkwell_dir", None)
        if base is None:
            base = spark._sparkwell_dir = tempfile.mkdtemp(prefix="sparkwell-")
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: For rows of megabytes: Parquet's writer looks at its size after every row, and its row groups, which a reader holds whole, are small.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def written(df: DataFrame, name: str, path: str | None = None, options: dict[str, str] | None = None, by: list[str] | None = None) -> DataFrame:
    """df written as Parquet and read again: its lineage is cut, and it is computed once. by: columns that part its files."""
    path = path or new_path(df.sparkSession, name)
    df.write.options(**(options or {})).partitionBy(*(by or [])).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table made by written() that no later plan reads."""
    path = getattr(df, "_written_at", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of rows in one Arrow batch of text or of lists of terms.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES, unless they are smaller already: what a Python task holds then does not grow with its partition."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))  # it may have a unit, as in 64m
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: small files come as one, and costly rows would run in one task."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
