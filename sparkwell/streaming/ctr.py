"""Streaming click-through: the batch report's measures on an unbounded source, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import guarded_ratio

#: Epoch day 0 is a Thursday; four days later the weeks begin on Monday.
MONDAY = "4 days"


def read_interactions(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of interactions as a stream; timestamps become instants so that a watermark can be set."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def windowed_ctr(interactions: DataFrame, size: str = "7 days", slide: str | None = None, start: str | None = MONDAY, late: str = "1 day") -> DataFrame:
    """Clicks, views, CTR and approximate distinct physicians and documents by event-time window.

    Distinct counts are approximate, as exact ones would need unbounded state. Rows later than the watermark are
    dropped by the engine; state is kept for open windows only.
    """
    e = interactions.where(F.col("interaction_type").isin("click", "view")).withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    w = F.window("timestamp", size, slide) if slide else F.window("timestamp", size, startTime=start or "0 seconds")
    g = e.groupBy(w.alias("w")).agg(
        F.count(F.when(F.col("interaction_type") == "click", 1)).alias("click_count"), F.count(F.when(F.col("interaction_type") == "view", 1)).alias("view_count"),
        F.approx_count_distinct("physician_id").alias("active_physicians"), F.approx_count_distinct("doc_id").alias("docs_interacted"),
    )
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "click_count", "view_count", guarded_ratio(F.col("click_count"), F.col("view_count")).alias("ctr"), "active_physicians", "docs_interacted")


def sessions(interactions: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Interactions of each physician by session."""
    e = interactions.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    g = e.groupBy(F.session_window("timestamp", gap).alias("w"), "physician_id").agg(F.count("*").alias("interactions"))
    return g.select("physician_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "interactions")


def start_sink(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Write closed windows to Parquet exactly once; the checkpoint folder must be shared."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    return (w.trigger(availableNow=True) if available_now else w).start()
