"""The five logical tables derived from generic tables (documents, events, benchmark), in Spark and as SQL.

Judgments are found by residues: each query's 20 residues meet the documents' in an equi-join, where the SQL form compares all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import grade, tokens
from .tables import Tables

# The structured encoder's code vocabulary, in its order.
ICD_CODES = (
    "C34.1", "C50.9", "C61", "C18.9", "C71.9", "I25.1", "I50.9", "I42.0", "I48.0", "N17.9", "N18.9", "K72.0", "K75.9",
    "D70.9", "D69.6", "D64.9", "G62.0", "G93.4", "E11.9", "E05.0", "J84.1", "J96.0", "M35.9", "M06.9", "D89.9", "D80.9",
)
UNKNOWN_CODE = "Z99.9"
JUDGED = 20


def _code(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, (*ICD_CODES, UNKNOWN_CODE))), (i + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        "doc_id", F.substring("text", 1, 40).alias("title"), F.col("source").alias("specialty"), F.col("lang").alias("doc_type"), F.col("text").alias("body_text"),
        F.expr("date_add(date'2021-01-01', cast(doc_id % 1096 as int))").alias("created_at"),
        F.concat(_code(F.col("doc_id") % 26), F.lit(","), _code((F.col("doc_id") * 7 + 3) % 27)).alias("icd_codes"),
    )


def physicians(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("physician_id")).distinct()
    return u.select("physician_id", F.concat(F.lit("src"), F.col("physician_id") % 20).alias("specialty"), (1 + F.col("physician_id") % 35).cast("int").alias("years_experience"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sizes = F.broadcast(  # one row
        spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count("*").alias("n")).crossJoin(spark.read.parquet(f"{sf_dir}/benchmark.parquet").agg(F.count("*").alias("b")))
    )
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "purchase", "save").when(F.col("event_type") == "signup", "dwell").when(F.col("event_type") == "error", "other").otherwise(F.col("event_type"))
    return e.crossJoin(sizes).select(
        F.col("event_id").alias("interaction_id"), F.col("user_id").alias("physician_id"), ((F.col("user_id") * 37 + k * 11) % F.col("n")).alias("doc_id"), kind.alias("interaction_type"),
        F.when(~F.col("event_type").isin("view", "error"), F.col("value")).alias("dwell_time_seconds"), F.col("ts").alias("timestamp"),
        F.when(F.col("event_id") % 5 < 3, F.col("event_id") % F.col("b")).alias("query_id"),
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = F.broadcast(spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.count_distinct("user_id").alias("u")))
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.crossJoin(users).select(F.col("item_id").alias("query_id"), (F.col("item_id") % F.col("u")).alias("physician_id"), F.col("text").alias("query_text"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(item_id as int), 0, 0)").alias("timestamp"))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = d.agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).first()
    n = max(1, size["n"])
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    d = d.select("doc_id", "text", "source")
    # doc_id * 31 + query_id * 17 = r (mod n), for r = 0..19 below n
    asked = q.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(min(JUDGED, n) - 1)))).withColumn("residue", F.expr(f"pmod(r - query_id * 17, {n}L)")).drop("r")
    pairs = asked.join(d.withColumn("residue", F.expr(f"pmod(doc_id * 31, {n}L)")), "residue").where("doc_id * 31 + query_id * 17 >= 0").drop("residue")
    least = q.agg(F.min("query_id")).first()[0]
    if size["low"] is not None and least is not None and size["low"] * 31 + least * 17 < 0:  # a negative remainder is below 20 as well
        pairs = pairs.unionByName(q.join(d, F.col("doc_id") * 31 + F.col("query_id") * 17 < 0))
    qt = F.array_distinct(tokens(F.col("query_text")))
    overlap = F.size(F.array_intersect(qt, F.array_distinct(tokens(F.col("text"))))) / F.greatest(F.size(qt), F.lit(1))
    base = 2 * overlap + F.when(F.col("source") == F.concat(F.lit("src"), F.col("query_id") % 20), 0.5).otherwise(0.0)
    return pairs.select("query_id", "doc_id", grade(base).alias("relevance_score"))


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(documents(spark, sf_dir), physicians(spark, sf_dir), interactions(spark, sf_dir), search_queries(spark, sf_dir), judgments(spark, sf_dir))


_CODES = ", ".join(f"'{c}'" for c in (*ICD_CODES, UNKNOWN_CODE))
_TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"

#: The logical tables as common table expressions for DuckDB.
SQL = f"""WITH l_size AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM benchmark) AS b, (SELECT count(DISTINCT user_id) FROM events) AS u),
l_documents AS (SELECT doc_id, substr(text, 1, 40) AS title, source AS specialty, lang AS doc_type, text AS body_text, CAST(DATE '2021-01-01' + CAST(doc_id % 1096 AS INTEGER) AS DATE) AS created_at,
  ([{_CODES}])[doc_id % 26 + 1] || ',' || ([{_CODES}])[(doc_id * 7 + 3) % 27 + 1] AS icd_codes FROM documents),
l_physicians AS (SELECT DISTINCT user_id AS physician_id, 'src' || (user_id % 20) AS specialty, CAST(1 + user_id % 35 AS INTEGER) AS years_experience FROM events),
l_interactions AS (SELECT event_id AS interaction_id, user_id AS physician_id, (user_id * 37 + CAST(json_extract(props, '$.k') AS BIGINT) * 11) % n AS doc_id,
  CASE event_type WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'dwell' WHEN 'error' THEN 'other' ELSE event_type END AS interaction_type,
  CASE WHEN event_type NOT IN ('view', 'error') THEN value END AS dwell_time_seconds, ts AS timestamp, CASE WHEN event_id % 5 < 3 THEN event_id % b END AS query_id FROM events, l_size),
l_queries AS (SELECT item_id AS query_id, item_id % u AS physician_id, text AS query_text, TIMESTAMP '2024-01-01' + to_hours(CAST(item_id AS BIGINT)) AS timestamp FROM benchmark, l_size),
l_pairs AS (SELECT item_id AS query_id, doc_id, list_distinct({_TOKENS.format('b.text')}) AS qt, list_distinct({_TOKENS.format('d.text')}) AS dt, source = 'src' || (item_id % 20) AS same
  FROM benchmark b, documents d, l_size WHERE (doc_id * 31 + item_id * 17) % n < {JUDGED}),
l_base AS (SELECT query_id, doc_id, 2 * (CAST(len(list_intersect(qt, dt)) AS DOUBLE) / greatest(len(qt), 1)) + CASE WHEN same THEN 0.5 ELSE 0.0 END AS base FROM l_pairs),
l_judgments AS (SELECT query_id, doc_id, CAST(CASE WHEN base >= 1.5 THEN 3 WHEN base >= 1.0 THEN 2 WHEN base >= 0.4 THEN 1 ELSE 0 END AS INTEGER) AS relevance_score FROM l_base)"""
