"""Engagement by week and specialty, and by document: clicks, views, CTR, dwell time, physicians, cold documents.

    python -m jobs.engagement_report --config jobs/engagement_report.json --tables DIR --out PATH [--since DATE] [--until DATE]

Reads documents, events and benchmark of a folder of tables.

out/weeks/year=.../week_num=...   a row a specialty
out/documents/specialty=...       a row a document, those nobody has opened included, with the words of its text

With since or until only the weeks (Monday to Sunday) that the range touches are computed, and only their partitions are
replaced; documents are always reported by all interactions. Running it again gives the same partitions.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.config import load, logger
from sparkwell.operators import analytics
from sparkwell.sources import bridge

DEFAULTS = {"cold_start": 5, "since": None, "until": None}

log = logger("engagement_report")


MEASURES = "interactions long, click_count long, view_count long, ctr double, weighted_score long, mean_dwell double, active_physicians long"
WEEKS = f"{MEASURES}, docs_interacted long, cold_docs long, specialty string, year string, week_num string"
DOCUMENTS = f"doc_id long, {MEASURES}, is_cold_start int, words long, specialty string"


def weeks(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(WEEKS).option("basePath", f"{out}/weeks").parquet(f"{out}/weeks")


def documents(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).option("basePath", f"{out}/documents").parquet(f"{out}/documents")


def report(spark: SparkSession, out: str) -> DataFrame:
    """The whole report as it stands, both levels in one table."""
    none = lambda kind: F.lit(None).cast(kind)
    measures = [c.split()[0] for c in MEASURES.split(", ")]
    w = weeks(spark, out).select(F.lit("week").alias("level"), "specialty", "year", "week_num", none("long").alias("doc_id"), *measures, "docs_interacted", "cold_docs", none("long").alias("words"))
    d = documents(spark, out).select(F.lit("document").alias("level"), "specialty", none("string").alias("year"), none("string").alias("week_num"), "doc_id", *measures, none("long").alias("docs_interacted"), F.col("is_cold_start").cast("long").alias("cold_docs"), "words")
    return w.union(d)


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> dict[str, int]:
    """Compute and write the weeks asked for; gives the numbers that were logged."""
    c = DEFAULTS | (config or {})
    interactions, docs = bridge.interactions(spark, tables), bridge.documents(spark, tables)
    # a document is cold by all its interactions; the range bounds the weeks alone
    by_week = analytics.weekly_engagement(interactions, docs, c["cold_start"], _in_weeks(c["since"], c["until"])).repartition("year", "week_num")  # a file a week
    by_document = analytics.document_engagement(docs, interactions, c["cold_start"])
    log.info("read %d interactions and %d documents of %s", interactions.count(), docs.count(), tables)
    mode = "dynamic" if c["since"] or c["until"] else "static"
    by_week.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("year", "week_num").parquet(f"{out}/weeks")
    by_document.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("specialty").parquet(f"{out}/documents")
    r = weeks(spark, out).agg(F.count("*").alias("rows"), F.count_distinct("year", "week_num").alias("weeks")).first()
    n = documents(spark, out).count()
    log.info("wrote %s; it holds %d rows of %d weeks and %d documents", out, r["rows"], r["weeks"], n)
    return {"rows": r["rows"], "weeks": r["weeks"], "documents": n}


def _in_weeks(since: str | None, until: str | None):
    """A condition on timestamps: within the weeks of since to until, both included."""
    week = F.date_trunc("week", F.col("timestamp"))
    ok = F.lit(True)
    if since:
        ok = ok & (week >= F.date_trunc("week", F.lit(since).cast("date")))
    if until:
        ok = ok & (week <= F.date_trunc("week", F.lit(until).cast("date")))
    return ok


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("config", "since", "until"):
        p.add_argument(f"--{name}")
    for name in ("tables", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--master", help="where the session is not started by spark-submit")
    a = p.parse_args()
    config = load(a.config, DEFAULTS)
    config |= {k: v for k, v in (("since", a.since), ("until", a.until)) if v}

    from sparkwell.session import SETTINGS

    builder = SparkSession.builder.appName("engagement_report").config(map=SETTINGS)
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    try:
        run(spark, a.tables, a.out, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
