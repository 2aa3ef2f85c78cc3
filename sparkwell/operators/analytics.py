"""Relational analytics over the logical tables: interaction matrix, cold start, weekly CTR, NDCG table, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..sources.shared import written
from ..sources.tables import Tables

# ------------------------------------------------------------------ interactions


def pair_weights(interactions: DataFrame) -> DataFrame:
    """One row per (physician, document), from one partially aggregated shuffle."""
    return interactions.groupBy("physician_id", "doc_id").agg(
        F.sum(S.interaction_weight(F.col("interaction_type"))).alias("weighted_score"), F.count("*").alias("total_interactions"),
        F.max("dwell_time_seconds").alias("max_dwell_time"), F.avg("dwell_time_seconds").alias("avg_dwell_time"),
    )


def interaction_matrix(interactions: DataFrame, alpha: int = S.ALPHA) -> DataFrame:
    """Confidence-weighted pairs, ranked per physician by score (ties by doc_id)."""
    w = Window.partitionBy("physician_id").orderBy(F.col("weighted_score").desc(), "doc_id")
    p = pair_weights(interactions).withColumn("confidence", S.confidence(F.col("weighted_score"), alpha)).withColumn("rank_per_physician", F.row_number().over(w))
    return p.select("physician_id", "doc_id", "weighted_score", "confidence", "total_interactions", "max_dwell_time", "avg_dwell_time", "rank_per_physician")


def cold_start_documents(documents: DataFrame, interactions: DataFrame, threshold: int = S.COLD_START) -> DataFrame:
    """Interaction counts of every document, those without any included.

    Interactions are summed by document before the join, so a hot document never meets its rows in one task.
    """
    by_pair = interactions.where("doc_id is not null").groupBy("doc_id", "physician_id").agg(F.count("interaction_id").alias("n"))
    by_doc = by_pair.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("physician_id").alias("u"))
    d = documents.select("doc_id", "title", "specialty", "doc_type").join(by_doc, "doc_id", "left")
    d = d.select("doc_id", "title", "specialty", "doc_type", F.coalesce("n", F.lit(0)).cast("long").alias("interaction_count"), F.coalesce("u", F.lit(0)).cast("long").alias("unique_physicians"))
    return d.withColumn("is_cold_start", S.cold_flag(F.col("interaction_count"), threshold))


def weekly_ctr(interactions: DataFrame, approximate: bool = False) -> DataFrame:
    """Clicks, views, CTR and active physicians and documents by week."""
    e = interactions.where(F.col("interaction_type").isin("click", "view"))
    e = e.select(S.year_text(F.col("timestamp")).alias("year"), S.week_text(F.col("timestamp")).alias("week_num"), "interaction_type", "doc_id", "physician_id")
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    g = e.groupBy("year", "week_num").agg(
        F.count(F.when(F.col("interaction_type") == "click", 1)).alias("click_count"), F.count(F.when(F.col("interaction_type") == "view", 1)).alias("view_count"),
        distinct("physician_id").alias("active_physicians"), distinct("doc_id").alias("docs_interacted"),
    )
    return g.select("year", "week_num", "click_count", "view_count", S.guarded_ratio(F.col("click_count"), F.col("view_count")).alias("ctr"), "active_physicians", "docs_interacted")


def weekly_engagement(interactions: DataFrame, documents: DataFrame, threshold: int = S.COLD_START, where: Column | None = None) -> DataFrame:
    """Engagement by week and the documents' specialty: clicks, views, CTR, weighted score, dwell time, physicians, documents, cold documents.

    Interactions are summed by week, document and physician before they meet the documents. where: which interactions
    count for the weeks; documents are cold or not by all of them.
    """
    t = F.col("timestamp")
    counted = interactions.where("doc_id is not null") if where is None else interactions.where("doc_id is not null").where(where)
    pairs = counted.groupBy(S.year_text(t).alias("year"), S.week_text(t).alias("week_num"), "doc_id", "physician_id").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("interaction_type") == "click", 1)).alias("clicks"), F.count(F.when(F.col("interaction_type") == "view", 1)).alias("views"),
        F.sum(S.interaction_weight(F.col("interaction_type"))).alias("weight"), F.sum("dwell_time_seconds").alias("dwell"), F.count("dwell_time_seconds").alias("dwells"),
    )
    docs = cold_start_documents(documents, interactions, threshold).select("doc_id", "specialty", "is_cold_start")
    g = pairs.join(docs, "doc_id").groupBy("year", "week_num", "specialty").agg(
        F.sum("n").alias("interactions"), F.sum("clicks").alias("click_count"), F.sum("views").alias("view_count"), S.guarded_ratio(F.sum("clicks"), F.sum("views")).alias("ctr"), F.sum("weight").alias("weighted_score"),
        (F.sum("dwell") / F.nullif(F.sum("dwells"), F.lit(0))).alias("mean_dwell"), F.count_distinct("physician_id").alias("active_physicians"), F.count_distinct("doc_id").alias("docs_interacted"),
        F.count_distinct(F.when(F.col("is_cold_start") == 1, F.col("doc_id"))).alias("cold_docs"),
    )
    return g


def document_engagement(documents: DataFrame, interactions: DataFrame, threshold: int = S.COLD_START) -> DataFrame:
    """Engagement of every document, those without any included: the measures of weekly_engagement, and the words of its text.

    Interactions are summed by document and physician, then by document, before they meet the documents.
    """
    by_pair = interactions.where("doc_id is not null").groupBy("doc_id", "physician_id").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("interaction_type") == "click", 1)).alias("clicks"), F.count(F.when(F.col("interaction_type") == "view", 1)).alias("views"),
        F.sum(S.interaction_weight(F.col("interaction_type"))).alias("weight"), F.sum("dwell_time_seconds").alias("dwell"), F.count("dwell_time_seconds").alias("dwells"),
    )
    by_doc = by_pair.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("n", "clicks", "views", "weight", "dwell", "dwells")), F.count("physician_id").alias("people"))
    d = documents.select("doc_id", "specialty", F.coalesce(S.word_count(F.col("body_text")), F.lit(0)).cast("long").alias("words")).join(by_doc, "doc_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return d.select(
        "doc_id", "specialty", none("n").alias("interactions"), none("clicks").alias("click_count"), none("views").alias("view_count"), S.guarded_ratio(none("clicks"), none("views")).alias("ctr"), none("weight").alias("weighted_score"),
        (F.col("dwell") / F.nullif(F.col("dwells"), F.lit(0))).alias("mean_dwell"), none("people").alias("active_physicians"), S.cold_flag(none("n"), threshold).alias("is_cold_start"), "words",
    )


def sparsity(documents: DataFrame, physicians: DataFrame, interactions: DataFrame) -> DataFrame:
    """One row: sizes, possible and observed pairs, sparsity and its percent text."""
    one = documents.agg(F.count("*").alias("n_documents")).crossJoin(physicians.agg(F.count("*").alias("n_physicians"))).crossJoin(interactions.agg(F.count_distinct("physician_id", "doc_id").alias("observed_pairs")))
    possible = F.col("n_documents") * F.col("n_physicians")
    share = F.when(possible > 0, 1 - F.col("observed_pairs").cast("double") / possible).otherwise(F.lit(1.0))
    return one.select("n_documents", "n_physicians", possible.alias("total_possible_pairs"), "observed_pairs", share.alias("sparsity"), S.percent_text(share).alias("sparsity_pct"))


def table_counts(t: Tables) -> DataFrame:
    out = None
    for name, df in t.items():
        r = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = r if out is None else out.union(r)
    return out


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(value, cnt) of a column."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("cnt"))


def summary_histograms(t: Tables) -> DataFrame:
    """Distributions of document type, specialty, interaction type and grade."""
    parts = (("doc_type", t.documents, "doc_type"), ("specialty", t.documents, "specialty"), ("interaction_type", t.interactions, "interaction_type"), ("relevance", t.query_document_relevance, "relevance_score"))
    out = None
    for name, df, column in parts:
        r = histogram(df, column).select(F.lit(name).alias("distribution"), "value", "cnt")
        out = r if out is None else out.union(r)
    return out


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.count_distinct(c).alias(f"n_{c}") for c in columns))


def equal_width_bins(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n): counts in equal bins from the least to the largest value; the last bin holds the largest."""
    edge = F.broadcast(df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")))  # one row
    b = F.least(F.floor((F.col(column) - F.col("lo")) * bins / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))), F.lit(bins - 1))
    return df.crossJoin(edge).where(F.col(column).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def exact_percentiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row with a column for each share: the exact percentile, linearly interpolated; null without values.

    Values are counted, dealt in ranges and counted up inside a range; only the two values around each percentile are picked.
    """
    counts = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    ranged = written(counts.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "ranges")
    starts = ranged.groupBy("part").agg(F.sum("n").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    total = starts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    end = F.col("start") + F.sum("n").over(Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.join(F.broadcast(starts.select("part", "start")), "part").withColumn("end", end).crossJoin(F.broadcast(total))
    at = {name: (F.col("total") - 1) * F.lit(float(p)) for name, p in shares.items()}
    holds = lambda i: (i >= F.col("end") - F.col("n")) & (i < F.col("end"))
    low = {f"{name}_low": F.max(F.when(holds(F.floor(x)), F.col("x"))) for name, x in at.items()}
    high = {f"{name}_high": F.max(F.when(holds(F.ceil(x)), F.col("x"))) for name, x in at.items()}
    r = placed.agg(F.first("total").alias("total"), *(v.alias(k) for k, v in (low | high).items()))
    return r.select(*((F.col(f"{name}_low") + (x - F.floor(x)) * (F.col(f"{name}_high") - F.col(f"{name}_low"))).alias(name) for name, x in at.items()))


# ------------------------------------------------------------------ matrix coordinates


def index_of(df: DataFrame, column: str) -> DataFrame:
    """(column, idx): dense positions of the distinct ids in their order, from 0.

    Ids are dealt in ranges; each range's size gives the next one's start, so no task sees them all. The ranges are stored,
    as sizes and positions must come from the same ones.
    """
    ids = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = written(ids.repartitionByRange(column).withColumn("part", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    ranged = ranged.withColumn("inside", inside)
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(starts.select("part", "start"), "part").select(column, (F.col("start") + F.col("inside")).cast("int").alias("idx"))


def sparse_coordinates(matrix: DataFrame) -> DataFrame:
    """(user_idx, item_idx, confidence) of an interaction matrix."""
    m = matrix.select("physician_id", "doc_id", "confidence")
    u, i = index_of(m, "physician_id").withColumnRenamed("idx", "user_idx"), index_of(m, "doc_id").withColumnRenamed("idx", "item_idx")
    return m.join(u, "physician_id").join(i, "doc_id").select("user_idx", "item_idx", F.col("confidence").cast("double").alias("confidence"))


def item_counts(matrix: DataFrame) -> DataFrame:
    """(doc_id, n): physicians in each document's column."""
    return matrix.groupBy("doc_id").agg(F.count("*").alias("n"))


def als_cold_items(matrix: DataFrame, threshold: int = S.COLD_START) -> DataFrame:
    """Documents of the matrix with fewer physicians than the threshold (not raw interactions)."""
    return item_counts(matrix).where(F.col("n") < threshold)


def matrix_stats(matrix: DataFrame, factors: int = 128, threshold: int = S.COLD_START) -> DataFrame:
    """One row: users, items, pairs, sparsity, cold items and the factors' size in MiB (4-byte floats)."""
    cold = als_cold_items(matrix, threshold).agg(F.count("*").alias("n_cold_start_items"))
    s = matrix.agg(F.count_distinct("physician_id").alias("n_users"), F.count_distinct("doc_id").alias("n_items"), F.count("*").alias("n_interactions")).crossJoin(cold)
    mb = lambda n: F.col(n) * (factors * 4) / 1048576
    return s.select(
        "n_users", "n_items", "n_interactions", (1 - F.try_divide(F.col("n_interactions").cast("double"), F.col("n_users") * F.col("n_items"))).alias("sparsity"), "n_cold_start_items",
        (F.try_divide(F.col("n_cold_start_items").cast("double"), F.col("n_items")) * 100).alias("cold_start_pct"), mb("n_items").alias("item_factors_mb"), mb("n_users").alias("user_factors_mb"),
        (mb("n_items") + mb("n_users")).alias("total_factors_mb"),
    )


# ------------------------------------------------------------------ judged queries


def ideal_ranks(judgments: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("relevance_score").desc(), "doc_id")
    return judgments.withColumn("ideal_rank", F.row_number().over(w))


def ndcg_evaluation(judgments: DataFrame, queries: DataFrame) -> DataFrame:
    """Ideal rank, discount, gain, contribution and running DCG of every judgment; both windows share one shuffle."""
    j = ideal_ranks(judgments.join(queries.select("query_id", "query_text"), "query_id"))
    j = j.withColumn("discount", S.discount(F.col("ideal_rank"))).withColumn("gain", S.gain(F.col("relevance_score")))
    j = j.withColumn("dcg_contribution", F.col("gain") * F.col("discount"))
    w = Window.partitionBy("query_id").orderBy("ideal_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return j.withColumn("cumulative_dcg", F.sum("dcg_contribution").over(w)).select("query_id", "query_text", "doc_id", "relevance_score", "ideal_rank", "discount", "gain", "dcg_contribution", "cumulative_dcg")


def queries_with_context(queries: DataFrame, physicians: DataFrame) -> DataFrame:
    return queries.join(physicians.withColumnRenamed("specialty", "physician_specialty"), "physician_id").select("query_id", "physician_id", "query_text", "timestamp", "physician_specialty", "years_experience")


def relevance_view(judgments: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    d = documents.select("doc_id", F.col("title").alias("doc_title"), F.col("specialty").alias("doc_specialty"), "doc_type")
    return judgments.join(queries.select("query_id", "query_text"), "query_id").join(d, "doc_id").select("query_id", "doc_id", "relevance_score", "query_text", "doc_title", "doc_specialty", "doc_type")


def judged_pairs(judgments: DataFrame, queries: DataFrame, physicians: DataFrame, documents: DataFrame, default_specialty: str = "oncology") -> DataFrame:
    """The rankers' input: judgments with texts, types and both specialties; a missing query specialty becomes the default."""
    context = queries_with_context(queries, physicians).select("query_id", "physician_specialty").dropDuplicates(["query_id", "physician_specialty"])
    judgments = written(judgments, "judgments")  # its size is known then: few judgments are broadcast, and no text moves
    j = judgments.join(documents.select("doc_id", "body_text", "doc_type", F.col("specialty").alias("doc_specialty")), "doc_id").join(queries.select("query_id", "query_text"), "query_id")
    j = j.join(context, "query_id", "left")
    return j.select("query_id", "doc_id", "relevance_score", "query_text", "body_text", "doc_type", F.coalesce("physician_specialty", F.lit(default_specialty)).alias("query_specialty"), "doc_specialty", (F.col("relevance_score") >= 2).cast("int").alias("label"))


def hash_split(df: DataFrame, key: str, share: float = 0.7, seed: int = 42, stratum: str | None = None) -> DataFrame:
    """Adds is_train: the share of each stratum's keys with the smallest hashes. Rows of one key stay together.

    Keys are ordered by ranges over all tasks (index_of), and a stratum's first position is taken off.
    """
    group = F.col(stratum) if stratum else F.lit(0)
    ordered = index_of(df.select(F.struct(group.alias("s"), F.xxhash64(F.lit(seed), key).alias("h"), F.col(key).alias("key")).alias("k")), "k")
    ordered = ordered.select("k.s", "k.key", "idx")
    sizes = ordered.groupBy("s").agg(F.min("idx").alias("first"), F.count("*").alias("n"))
    keys = ordered.join(sizes, "s").select(F.col("key").alias(key), F.col("s"), (F.col("idx") - F.col("first") < F.ceil(F.col("n") * share)).alias("is_train"))
    return df.join(keys.withColumnRenamed("s", stratum), [key, stratum]) if stratum else df.join(keys.drop("s"), key)


def seen_filter(candidates: DataFrame, interactions: DataFrame) -> DataFrame:
    """Candidates (physician_id, doc_id, ...) without the pairs already seen."""
    return candidates.join(interactions.select("physician_id", "doc_id").distinct(), ["physician_id", "doc_id"], "left_anti")


def only(df: DataFrame, ids: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """Rows whose key is among ids, or is not."""
    return df.join(ids.select(key).distinct(), key, "left_semi" if inside else "left_anti")


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group; the limit is applied before the shuffle too."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
