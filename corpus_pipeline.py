"""A corpus pipeline of five training-data operators.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
to the shared folder as Parquet and reads again as the next stage's docs. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm import language_id, quality
from sparkwell.llm.common import drop_stored, stored
from sparkwell.llm.mixing import OWN, mixture
from sparkwell.llm.ngram_join import ngram_jaccard_join
from sparkwell.llm.packing import pack


#: Ids of dropped documents are broadcast up to this number (32 MB); more are joined by shuffle.
MOST_BROADCAST = 4_000_000
#: Of a kept text's windows at least this share is known in its language.
LEAST_KNOWN = 0.3


def _beside(docs: DataFrame, results: tuple[str, ...]) -> tuple[DataFrame, list]:
    """docs with columns named like an operator's results renamed, and the columns that give the old names back."""
    names = {c: f"__own_{c}" for c in docs.columns if c in results}
    return docs.withColumnsRenamed(names), [F.col(names[c]).alias(c) if c in names else F.col(c) for c in docs.columns]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Those that are ``und`` (no text, no letter) go, and those of which too few windows are known in any language: their
    share, plus one over the root of the number of windows, is below LEAST_KNOWN, so short texts are never judged by it.
    """
    docs, old = _beside(docs, language_id.OWN)
    model = language_id.learn(spark, docs, F.lit(True))
    found = language_id.identify(spark, docs, model, docs.columns)
    known = F.col("known") + 1 / F.sqrt(F.greatest("windows", F.lit(1)))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (known >= LEAST_KNOWN)).select(*old)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, by text, source and language within the source."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, old = _beside(docs, quality.OWN)
    return quality.assess(spark, docs, labels, "source", "lang", docs.columns).where("kept").select(*old)


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with __key, and the ids that several rows have or that are null, if there are any.

    __key is the doc_id where one row has it. Rows of the other ids are told apart by their text: their key is a hash of
    id and text that no other text of these ids and no other id has (checked; the next seed is taken otherwise).
    """
    ids = docs.groupBy("doc_id").count()
    repeated = stored(ids.where("count > 1 or doc_id is null").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return docs.withColumn("__key", F.col("doc_id")), None
    held = repeated.withColumnRenamed("doc_id", "__id").withColumn("__again", F.lit(True))
    marked = docs.join(held, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    texts = stored(marked.where("__again").select("doc_id", "text").distinct(), "texts")
    for seed in range(100):
        key = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))
        keys = texts.select(key.alias("__key")).groupBy("__key").count()
        if keys.where("count > 1").isEmpty() and keys.join(ids.select(F.col("doc_id").alias("__key")), "__key", "left_semi").isEmpty():
            break
    drop_stored(texts)
    return marked.withColumn("__key", F.when(F.col("__again"), key).otherwise(F.col("doc_id"))), repeated


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each group of near copies (5-word shingles, Jaccard of 0.8 or more): that of the smallest doc_id.

    Rows of one doc_id with different texts are documents of their own, as are rows without an id. Of rows equal in id and
    text the smallest stays, by all columns.
    """
    columns = docs.columns
    keyed, repeated = _keyed(docs)
    members, _ = ngram_jaccard_join(spark, keyed, k=5, percent=80, id_col="__key", complete=False)
    members = members.withColumnRenamed("doc_id", "__key")
    if repeated is None:
        dropped = members.where("__key <> component_id")
    else:  # a hashed key says nothing of the order of ids
        members = members.join(keyed.select("__key", "doc_id").distinct(), "__key")
        best = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("best"))
        dropped = members.join(best, "component_id").where("__key <> best.__key")
    copies = stored(dropped.select("__key").distinct(), "copies")
    if copies.count() <= MOST_BROADCAST:
        copies = F.broadcast(copies)
    kept = keyed.join(copies, "__key", "left_anti")
    if repeated is None:
        return kept.select(*columns)
    again = kept.where("__again").groupBy("__key").agg(F.min(F.struct(*columns)).alias("row")).select(*(F.col("row")[c].alias(c) for c in columns))
    return kept.where("__again is null").select(*columns).union(again)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; smaller sources are repeated, the smallest at most twice."""
    docs, old = _beside(docs, OWN)
    drawn, _ = mixture(spark, docs, most_repeats=2.0)
    return drawn.select(*old)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    pieces = pack(spark, docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "begins", "ends")


STAGES = [
    ("language_id", identify_languages),
    ("quality", classify_quality),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the learned stages nor the packing; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        drop_stored(before)
    return docs
