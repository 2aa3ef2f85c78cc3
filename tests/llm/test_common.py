"""Shared storage."""

from pyspark.sql import functions as F

from sparkwell.llm import common


def test_an_aggregate_keeps_its_tasks(spark):
    """summed: the reduce side runs in all shuffle partitions, and its rows are dealt to few files after it."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = spark.range(8000).groupBy((F.col("id") % 4000).alias("k")).agg(F.count("*").alias("n")).withColumn("task", F.spark_partition_id())
        summed = common.stored(counts, "counts", 0, summed=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert summed.select("task").distinct().count() == 40 and summed.count() == 4000
    plan = counts.repartition(8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 8, true" in plan  # a shuffle of its own, above the aggregate
    assert len(summed.inputFiles()) == common.LEAST_FILES
