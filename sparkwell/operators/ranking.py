"""Pair features, NDCG and LambdaRank pair mathematics as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..sources.shared import written
from ..sources.tables import DOC_TYPES
from .analytics import exact_percentiles
from .retrieval import B, K1, Index, fit, pair_scores

FEATURES = ("set_cosine", "bm25", "overlap", "doc_words", *(f"type_{i}" for i in range(5)), "same_specialty")


# ------------------------------------------------------------------ features


def one_hot(column: Column, values: tuple[str, ...], prefix: str = "type_") -> list[Column]:
    """One 0/1 column for each value; an unknown value has zeros everywhere."""
    return [F.coalesce(column == v, F.lit(False)).cast("double").alias(f"{prefix}{i}") for i, v in enumerate(values)]


def bm25_feature(pairs: DataFrame, corpus: DataFrame, k1: float = K1, b: float = B, index: Index | None = None) -> DataFrame:
    """(query_id, doc_id, bm25): distinct query terms against the pair's own text, with the corpus' statistics.

    index: the corpus' index, where there is one; else the corpus is tokenized and stored for this call.
    """
    queries = pairs.select("query_id", "query_text").dropDuplicates(["query_id"])
    return pair_scores(index or fit(corpus), pairs, queries, k1, b, distinct=True, least_avgdl=1.0).withColumnRenamed("score", "bm25")


def pair_features(pairs: DataFrame, corpus: DataFrame, types: tuple[str, ...] = DOC_TYPES, index: Index | None = None) -> DataFrame:
    """The ten ranking features of judged pairs (as given by analytics.judged_pairs)."""
    q, d = F.array_distinct(S.tokens(F.col("query_text"))), F.array_distinct(S.tokens(F.col("body_text")))
    both = F.size(F.array_intersect(q, d))
    f = pairs.select(
        "query_id", "doc_id", "relevance_score", "label",
        F.when((F.size(q) > 0) & (F.size(d) > 0), both / (F.sqrt(F.size(q)) * F.sqrt(F.size(d)))).otherwise(0.0).alias("set_cosine"),
        F.when(F.size(q) > 0, both / F.size(q)).otherwise(0.0).alias("overlap"), F.coalesce(S.word_count(F.col("body_text")), F.lit(0)).cast("double").alias("doc_words"),
        *one_hot(F.col("doc_type"), types), F.coalesce(F.col("query_specialty") == F.col("doc_specialty"), F.lit(False)).cast("double").alias("same_specialty"),
    )
    f = f.join(bm25_feature(pairs, corpus, index=index), ["query_id", "doc_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    return f.select("query_id", "doc_id", "relevance_score", "label", *FEATURES)


def standardized(df: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Columns shifted to mean 0 and scaled to population deviation 1; a constant column is only shifted."""
    stats = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns))
    d = df.crossJoin(F.broadcast(stats))  # one row
    z = [((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 1e-12, F.col(f"s_{c}")).otherwise(1.0)).alias(c) for c in columns]
    return d.select(*(c for c in df.columns if c not in columns), *z)


# ------------------------------------------------------------------ NDCG


def ranks(scored: DataFrame, score: str = "score", rank: str = "rank") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "doc_id")
    return scored.withColumn(rank, F.row_number().over(w))


def ndcg(scored: DataFrame, k: int = 10, label: str = "relevance_score", score: str = "score") -> DataFrame:
    """(query_id, n, ndcg) of rows (query_id, doc_id, label, score); 0 where the ideal DCG is 0."""
    r = ranks(scored, score)
    ideal = Window.partitionBy("query_id").orderBy(F.col(label).desc(), "doc_id")
    r = r.withColumn("ideal", F.row_number().over(ideal))
    part = lambda at: F.sum(F.when(F.col(at) <= k, S.gain(F.col(label)) * S.discount(F.col(at))).otherwise(0.0))
    g = r.groupBy("query_id").agg(F.count("*").alias("n"), part("rank").alias("dcg"), part("ideal").alias("idcg"))
    return g.select("query_id", "n", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def ndcg_summary(per_query: DataFrame, least_judgments: int = 2) -> DataFrame:
    """Mean, median and population deviation over queries with enough judgments."""
    q = written(per_query.where(F.col("n") >= least_judgments).select("ndcg"), "ndcg")  # read twice
    one = q.agg(F.count("*").alias("n_queries"), F.avg("ndcg").alias("mean_ndcg"), F.stddev_pop("ndcg").alias("std_ndcg"))
    return one.crossJoin(F.broadcast(exact_percentiles(q, "ndcg", {"median_ndcg": 0.5}))).select("n_queries", "mean_ndcg", "median_ndcg", "std_ndcg")


# ------------------------------------------------------------------ LambdaRank


def trainable_groups(df: DataFrame, label: str = "relevance_score") -> DataFrame:
    """Rows of queries that have at least two different labels."""
    q = df.groupBy("query_id").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo < hi").select("query_id")
    return df.join(q, "query_id", "left_semi")


def delta_ndcg(scored: DataFrame, k: int = 10, label: str = "relevance_score", score: str = "score") -> DataFrame:
    """(query_id, doc_i, doc_j, s_i, s_j, delta) of all pairs of a query with label_i > label_j.

    k cuts the ideal DCG only; discounts are those of the current ranks, uncut. Pairs stay inside a query's judgments.
    """
    ideal = Window.partitionBy("query_id").orderBy(F.col(label).desc(), "doc_id")
    r = ranks(scored, score).withColumn("ideal", F.row_number().over(ideal))
    whole = Window.partitionBy("query_id")
    r = r.withColumn("idcg", F.sum(F.when(F.col("ideal") <= k, S.gain(F.col(label)) * S.discount(F.col("ideal"))).otherwise(0.0)).over(whole))
    r = r.select("query_id", "doc_id", F.col(label).alias("l"), F.col(score).alias("s"), S.gain(F.col(label)).alias("g"), S.discount(F.col("rank")).alias("d"), "idcg")
    i, j = r.alias("i"), r.alias("j")
    p = i.join(j, (F.col("i.query_id") == F.col("j.query_id")) & (F.col("i.l") > F.col("j.l")))
    delta = F.abs((F.col("i.g") - F.col("j.g")) * (F.col("j.d") - F.col("i.d")))
    return p.select(F.col("i.query_id").alias("query_id"), F.col("i.doc_id").alias("doc_i"), F.col("j.doc_id").alias("doc_j"), F.col("i.s").alias("s_i"), F.col("j.s").alias("s_j"), F.when(F.col("i.idcg") > 0, delta / F.col("i.idcg")).otherwise(0.0).alias("delta"))


def lambda_gradients(scored: DataFrame, k: int = 10, label: str = "relevance_score", score: str = "score") -> DataFrame:
    """(query_id, doc_id, lambda): what each pair adds to its better and takes from its worse document, summed."""
    p = delta_ndcg(scored, k, label, score).withColumn("x", F.col("delta") / (1 + F.exp(F.col("s_i") - F.col("s_j"))))
    both = p.select("query_id", F.explode(F.array(F.struct(F.col("doc_i").alias("doc_id"), F.col("x")), F.struct(F.col("doc_j").alias("doc_id"), (-F.col("x")).alias("x")))).alias("e"))
    g = both.groupBy("query_id", F.col("e.doc_id").alias("doc_id")).agg(F.sum("e.x").alias("lambda"))
    return scored.select("query_id", "doc_id").join(g, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("lambda", F.lit(0.0)).alias("lambda"))
