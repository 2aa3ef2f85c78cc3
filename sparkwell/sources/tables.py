"""The five logical tables: schemas, storage and validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# The domains of the declared checks.
DOC_TYPES = ("trial_report", "case_study", "drug_interaction", "pathology_report", "cohort_summary")
INTERACTION_TYPES = ("view", "click", "save", "dwell")
RELEVANCE = (0, 1, 2, 3)


def _schema(*fields: tuple[str, T.DataType], required: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in required) for n, t in fields])


_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()
SCHEMAS = {
    "documents": _schema(("doc_id", _S), ("title", _S), ("specialty", _S), ("doc_type", _S), ("body_text", _S), ("created_at", _TS), ("icd_codes", _S), required=("doc_id",)),
    "physicians": _schema(("physician_id", _S), ("specialty", _S), ("years_experience", _I), required=("physician_id",)),
    "interactions": _schema(("interaction_id", _L), ("physician_id", _S), ("doc_id", _S), ("interaction_type", _S), ("dwell_time_seconds", _D), ("timestamp", _TS), ("query_id", _S), required=("interaction_id",)),
    "search_queries": _schema(("query_id", _S), ("physician_id", _S), ("query_text", _S), ("timestamp", _TS), required=("query_id",)),
    "query_document_relevance": _schema(("query_id", _S), ("doc_id", _S), ("relevance_score", _I), required=("query_id", "doc_id")),
}
KEYS = {"documents": ["doc_id"], "physicians": ["physician_id"], "interactions": ["interaction_id"], "search_queries": ["query_id"], "query_document_relevance": ["query_id", "doc_id"]}
DOMAINS = {"documents": ("doc_type", DOC_TYPES), "interactions": ("interaction_type", INTERACTION_TYPES), "query_document_relevance": ("relevance_score", RELEVANCE)}


@dataclass
class Tables:
    """The logical tables of one data set."""

    documents: DataFrame
    physicians: DataFrame
    interactions: DataFrame
    search_queries: DataFrame
    query_document_relevance: DataFrame

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(n, getattr(self, n)) for n in SCHEMAS]


def create_tables(spark: SparkSession, path: str) -> None:
    """Empty tables with the declared schemas, replacing what is there."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{name}")


def write_tables(tables: Tables, path: str, format: str = "parquet") -> None:
    """Store all tables. Judgments keep the first row of each key."""
    for name, df in tables.items():
        if name == "query_document_relevance" and "arrival" in df.columns:
            df = first_wins(df, KEYS[name], "arrival").drop("arrival")
        df.write.mode("overwrite").format(format).save(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, format: str = "parquet") -> Tables:
    return Tables(**{n: spark.read.format(format).load(f"{path}/{n}") for n in SCHEMAS})


def first_wins(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The first row of each key in the order of arrival."""
    w = Window.partitionBy(*keys).orderBy(arrival)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def domain_violations(df: DataFrame, column: str, allowed: tuple) -> DataFrame:
    """(value, n) of the values outside the domain; null is allowed, as in a declared check."""
    return df.where(~F.col(column).isin(*allowed)).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def violations(tables: Tables) -> DataFrame:
    """(check_name, n): rows that break a domain, and surplus rows of keys, for every table."""
    out = None
    for name, df in tables.items():
        rows = [duplicate_keys(df, KEYS[name]).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n")).select(F.lit(f"{name}.key").alias("check_name"), "n")]
        if name in DOMAINS:
            column, allowed = DOMAINS[name]
            rows.append(domain_violations(df, column, allowed).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")).select(F.lit(f"{name}.{column}").alias("check_name"), "n"))
        for r in rows:
            out = r if out is None else out.union(r)
    return out
