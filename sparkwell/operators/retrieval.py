"""BM25 over a stored index with a row a document, TF-IDF, and retrieval reports.

``fit`` tokenizes the corpus once and writes (doc_id, dl, terms, tfs). Retrieval searches the rows' segments (blockmax) with
the terms of all queries, which are broadcast up to MOST_TERMS, and keeps the best k of each task: pairs of query and document
are never shuffled. More query terms than that are joined instead.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..functions.words import ENGLISH_STOP_WORDS
from ..sources.shared import LARGE_ROWS, bounded_batches, spread, written
from . import blockmax
from .analytics import exact_percentiles, top
from .matching import term_hits

#: Terms of queries (a row for each query and term) that are broadcast: 100 MB at most.
MOST_TERMS = 4_000_000
#: Bytes of text tokenized at once.
SLICE = 4 << 20
K1, B = 1.5, 0.75

# The report's queries, each with terms for the same concept that share no token with it.
MISMATCH_CASES = (
    ("cardiac adverse events in EGFR inhibitor trials", ("cardiotoxicity", "cardiovascular toxicity", "TKI-induced cardiac events", "cardiac dysfunction")),
    ("hepatotoxicity in checkpoint inhibitor therapy", ("drug-induced liver injury", "hepatic failure", "transaminase elevation", "DILI")),
    ("immune-mediated adverse reactions to PD-1 inhibitors", ("immunogenicity", "cytokine storm", "autoimmune activation", "hypersensitivity")),
    ("nephrotoxicity from platinum-based chemotherapy", ("acute kidney injury", "renal impairment", "creatinine elevation", "tubular necrosis")),
    ("myelosuppression management in AML treatment", ("hematologic toxicity", "pancytopenia", "neutropenia", "bone marrow suppression")),
)


@dataclass
class Index:
    """docs (doc_id, dl, terms, tfs), a row a document; segments of them for search, and (term, df), made when first asked for."""

    docs: DataFrame
    stored_segments: DataFrame | None = None
    df: DataFrame | None = None
    stored_stats: DataFrame | None = None

    @property
    def segments(self) -> DataFrame:
        if self.stored_segments is None:
            self.stored_segments = written(blockmax.segments(self.docs), "segments", options=LARGE_ROWS)
        return self.stored_segments

    @property
    def postings(self) -> DataFrame:
        """(term, doc_id, tf)."""
        return self.docs.select("doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("x.terms", "doc_id", F.col("x.tfs").alias("tf")).toDF("term", "doc_id", "tf")

    @property
    def stats(self) -> DataFrame:
        """One row: n_docs, avgdl."""
        if self.stored_stats is not None:
            return self.stored_stats
        return self.docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))

    @property
    def terms(self) -> DataFrame:
        """(term, df, idf)."""
        return self.weights().select("term", "df", "idf")

    def weights(self, vocabulary: DataFrame | None = None) -> DataFrame:
        """(term, df, idf, avgdl) of the terms in the vocabulary, or of all.

        Where no search has made segments, the documents' rows are counted: none are made for it. Where nothing is counted yet,
        only the vocabulary's rows are, in passing.
        """
        terms = self.docs.select(F.explode("terms").alias("term"))
        count = lambda t: t.groupBy("term").agg(F.count("*").alias("df"))
        if self.df is None and self.stored_segments is None and vocabulary is not None:
            df = count(terms.join(vocabulary, "term", "left_semi"))
        else:
            if self.df is None:
                self.df = written(count(terms) if self.stored_segments is None else document_frequencies(self.segments), "frequencies")
            df = self.df if vocabulary is None else self.df.join(vocabulary, "term", "left_semi")
        return df.crossJoin(F.broadcast(self.stats)).select("term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl")  # one row of stats


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document length, distinct terms and their counts of lower-cased texts (the last column); the others are passed on."""
    for b in batches:
        text = b.column(b.num_columns - 1)
        size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE, "right")))
            n = stop - start
            lists = pc.split_pattern_regex(pc.fill_null(text.slice(start, n), ""), "[^a-z0-9]+")
            word, row = lists.flatten(), np.repeat(np.arange(n), lists.value_lengths().to_numpy())
            real = pc.not_equal(word, "")
            word, row = word.filter(real), row[real.to_numpy(zero_copy_only=False)]
            coded = word.dictionary_encode()
            width = max(1, len(coded.dictionary))
            key, tf = np.unique(row * width + coded.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(n + 1) * width), pa.int32())
            terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(key % width)))
            yield pa.RecordBatch.from_arrays([*(c.slice(start, n) for c in b.columns[:-1]), pa.array(np.bincount(row, minlength=n)), terms, pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))], [*b.schema.names[:-1], "dl", "terms", "tfs"])
            start = stop


def counted(docs: DataFrame, id_col: str = "doc_id", text: str = "body_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The index's rows of docs: (doc_id, kept columns, dl, terms, tfs)."""
    d = docs.select(F.col(id_col).alias("doc_id"), *keep, F.lower(text).alias("__text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema[:-1])
    return d.mapInArrow(_counted, f"{types}, dl long, terms array<string>, tfs array<long>")


def document_frequencies(segments: DataFrame) -> DataFrame:
    """(term, df): a segment has a row a term, so its documents are counted already."""
    t = segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x"))
    return t.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))


def fit(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "body_text") -> Index:
    """Tokenize docs once and store the index, under path to be loaded again, else for this session."""
    bounded_batches(docs.sparkSession)
    rows = counted(spread(docs.select(id_col, text)), id_col, text)
    if path is None:
        return Index(written(rows, "index"))
    stored = written(rows, "index", f"{path}/docs")
    segments = written(blockmax.segments(stored), "segments", f"{path}/segments", LARGE_ROWS)
    document_frequencies(segments).write.parquet(f"{path}/terms")
    Index(stored).stats.coalesce(1).write.parquet(f"{path}/stats")
    return load(docs.sparkSession, path)


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{x}") for x in ("docs", "segments", "terms", "stats")))


def idf(n: Column, df: Column) -> Column:
    """Smoothed and always positive; terms outside the corpus have no row, which counts as 0."""
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_score(tf: Column, idf_: Column, dl: Column, avgdl: Column, k1: Column | float = K1, b: Column | float = B) -> Column:
    k1, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (k1, b))
    return idf_ * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / avgdl))


def query_terms(queries: DataFrame, distinct: bool = False, id_col: str = "query_id", text: str = "query_text") -> DataFrame:
    """(query_id, term, qtf): repeated terms count repeatedly unless distinct."""
    q = queries.select(F.col(id_col).alias("query_id"), F.explode(S.tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    return q.withColumn("qtf", F.lit(1).cast("long")) if distinct else q


def _weighted(index: Index, queries: DataFrame, distinct: bool) -> DataFrame:
    """(query_id, term, qtf, idf, avgdl) of the query terms that the corpus has."""
    q = query_terms(queries, distinct)
    return q.join(index.weights(q.select("term").distinct()), "term").select("query_id", "term", "qtf", "idf", "avgdl")


def _scorer(held, pairs: list[tuple[float, float]], k: int | None, margin: float, blocks=None):
    """Scores of a task's segments; of each query the best k (and all within the margin of the k-th) where k is given.

    blocks: accumulators of the blocks that hold a query's terms, and of those that were read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, vocabulary, term, first, weight, avgdl = held.value
        if not len(query):
            return
        words, least = pa.array(vocabulary, pa.string()), np.full(len(query), -np.inf)
        kept: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        names = ["query_id", "doc_id", *(f"s{i}" for i in range(len(pairs)))]

        def best() -> None:
            """Drop what cannot be among the k best: by score, then id."""
            ids, q, s = pa.chunked_array([i for i, _, _ in kept]).combine_chunks(), np.concatenate([x for _, x, _ in kept]), np.concatenate([x for _, _, x in kept])
            order = np.lexsort((pc.rank(ids, tiebreaker="dense").to_numpy(), -s, q))
            q, s = q[order], s[order]
            new = np.ones(len(q), bool)
            new[1:] = (q[1:] != q[:-1]) | (s[1:] != s[:-1])
            at = np.flatnonzero(new)
            among = np.arange(len(q)) - np.repeat(at, np.diff(np.append(at, len(q))))  # place among equal scores
            start = np.searchsorted(q, np.arange(len(query)))
            last = np.minimum(start + k - 1, len(q) - 1)
            full = np.append(start[1:], len(q)) - start >= k
            least[full] = s[last[full]] - margin
            stay = (among < k) & (s >= least[q])
            kept[:] = [(ids.take(pa.array(order[stay])), q[stay], s[stay])]

        for b in batches:
            for r in range(b.num_rows):
                s = blockmax.Segment(b.slice(r, 1), avgdl)
                lists = pc.fill_null(pc.index_in(words, s.terms), -1).to_numpy(zero_copy_only=False)
                postings = [s.postings(*p) for p in pairs]
                bounds = s.bounds(*pairs[0]) if k is not None else None
                for q in np.unique(np.repeat(np.arange(len(query)), np.diff(first))[lists[term] >= 0]):  # those with a term here
                    asked = blockmax.Query(s, lists[term[first[q] : first[q + 1]]], weight[first[q] : first[q + 1]])
                    if k is None:
                        slot, sums = asked.scores(postings)
                        yield pa.RecordBatch.from_arrays([pa.array(query).take(pa.array(np.full(len(slot), q))), s.ids.take(pa.array(slot)), *map(pa.array, sums)], names)
                        continue
                    slot, score, n, read = asked.best(k, least[q], margin, bounds, postings[0])
                    if blocks is not None:
                        blocks[0].add(n)
                        blocks[1].add(read)
                    kept.append((s.ids.take(pa.array(slot)), np.full(len(slot), q), score))
                if kept:  # the k-th best scores hold for the next segment
                    best()
        if kept:
            ids, q, s = kept[0]
            yield pa.RecordBatch.from_arrays([pa.array(query).take(pa.array(q)), ids, pa.array(s)], names)

    return run


def matched_scores(index: Index, queries: DataFrame, k1: float = K1, b: float = B, distinct: bool = False, grid: DataFrame | None = None, best: int | None = None, margin: float = 0.0, blocks=None) -> DataFrame:
    """(query_id, doc_id, score) of all pairs that share a term.

    With grid (columns k1, b) every pair of parameters is scored. best: only pairs that may be among a query's best are
    needed, by score and then id; those within the margin of them are given too, and blocks of documents that cannot hold
    any are skipped. blocks: two accumulators, of the blocks that share a term and of those read.
    """
    pairs = [(k1, b)] if grid is None else [(r["k1"], r["b"]) for r in grid.collect()]  # a small parameter table
    names = [f"s{i}" for i in range(len(pairs))]
    segments = index.segments
    w = _weighted(index, queries, distinct)
    types = {"query_id": w.schema["query_id"].dataType.simpleString(), "doc_id": index.docs.schema["doc_id"].dataType.simpleString()}
    rows = w.limit(MOST_TERMS + 1).toArrow()
    if rows.num_rows <= MOST_TERMS:
        rows = rows.sort_by([("query_id", "ascending"), ("term", "ascending")]).combine_chunks()
        query, vocabulary = rows["query_id"].combine_chunks().dictionary_encode(), rows["term"].combine_chunks().dictionary_encode()
        first = np.searchsorted(query.indices.to_numpy(), np.arange(len(query.dictionary) + 1))
        weight = rows["qtf"].to_numpy() * rows["idf"].to_numpy() if rows.num_rows else np.zeros(0)
        data = (query.dictionary, vocabulary.dictionary.to_pylist(), vocabulary.indices.to_numpy(), first, weight, float(rows["avgdl"][0].as_py()) if rows.num_rows else 1.0)
        run = _scorer(index.docs.sparkSession.sparkContext.broadcast(data), pairs, best if grid is None else None, margin, blocks)
        sums = segments.mapInArrow(run, ", ".join([*(f"{n} {t}" for n, t in types.items()), *(f"{n} double" for n in names)]))
    else:
        hits = index.docs.select("doc_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("doc_id", "dl", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
        part = lambda x, y: F.sum(F.col("qtf") * term_score(F.col("tf"), F.col("idf"), F.col("dl"), F.col("avgdl"), x, y))
        sums = hits.join(w, "term").groupBy("query_id", "doc_id").agg(*(part(x, y).alias(n) for n, (x, y) in zip(names, pairs, strict=True)))
    if grid is None:
        return sums.select("query_id", "doc_id", F.col("s0").alias("score"))
    each = F.array(*(F.struct(F.lit(x).alias("k1"), F.lit(y).alias("b"), F.col(n).alias("score")) for n, (x, y) in zip(names, pairs, strict=True)))
    return sums.select("query_id", "doc_id", F.explode(each).alias("e")).select("e.k1", "e.b", "query_id", "doc_id", "e.score")


def pair_scores(index: Index, pairs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, distinct: bool = False, least_avgdl: float = 0.0) -> DataFrame:
    """(query_id, doc_id, score) of the given pairs alone, 0 where no term is shared; other documents' texts aren't scored."""
    w = _weighted(index, queries, distinct).groupBy("query_id").agg(F.collect_list(F.struct("term", "qtf", "idf")).alias("w"), F.first("avgdl").alias("avgdl"))
    p = written(pairs.select("query_id", "doc_id").distinct(), "asked")  # its size is known then: few pairs are broadcast, and no document moves
    p = p.join(index.docs, "doc_id").join(w, "query_id", "left")
    avgdl = F.greatest("avgdl", F.lit(float(least_avgdl)))
    tf = lambda t: F.element_at("tfs", F.array_position("terms", t).cast("int"))
    one = lambda x: F.when(F.array_contains("terms", x["term"]), x["qtf"] * term_score(tf(x["term"]), x["idf"], F.col("dl"), avgdl, k1, b)).otherwise(0.0)
    return p.select("query_id", "doc_id", F.coalesce(F.aggregate("w", F.lit(0.0), lambda a, x: a + one(x)), F.lit(0.0)).alias("score"))


def retrieve(index: Index, queries: DataFrame, top_k: int = 10, k1: float = K1, b: float = B, padded: bool = False, digits: int = 6, blocks=None) -> DataFrame:
    """(query_id, rank, doc_id, score): the best documents by the rounded score, ties by doc_id.

    padded: a query with fewer matches is filled up with unmatched documents of score 0 in the order of doc_id. Only the
    top_k smallest ids and the matches can ever be needed for that, so no query meets the whole corpus. blocks: as in
    matched_scores.
    """
    s = matched_scores(index, queries, k1, b, best=top_k, margin=2 * 10.0**-digits, blocks=blocks).withColumn("score", F.round("score", digits))
    if padded:
        # among the first top_k + m ids at least top_k are unmatched, where m < top_k matches are all a short list has
        first = index.docs.select("doc_id").orderBy("doc_id").limit(2 * top_k)
        blank = queries.select("query_id").crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
        s = s.union(blank.select("query_id", "doc_id", "score")).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return top(s, ["query_id"], [F.col("score").desc(), F.col("doc_id")], top_k).select("query_id", "rank", "doc_id", "score")


def mismatch_report(index: Index, docs: DataFrame, cases=MISMATCH_CASES, examples: int = 5) -> DataFrame:
    """Documents that hold an expected term, with the query's score: (case_id, query, found, n, doc_id, matched_term, bm25_score, text_preview).

    A document appears once for each matched term; found counts all, and the first examples by (term, doc_id) are listed.
    """
    spark = docs.sparkSession
    terms = spark.createDataFrame([(i, q, j, t) for i, (q, ts) in enumerate(cases) for j, t in enumerate(ts)], "case_id int, query string, term_no int, matched_term string")
    queries = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(cases)], "query_id int, query_text string")
    hit = term_hits(docs.withColumn("text_preview", F.substring("body_text", 1, 200)), terms, "body_text", "matched_term", ("doc_id", "text_preview")).withColumnRenamed("term", "matched_term")
    hit = hit.join(terms, "matched_term").select("case_id", "query", "term_no", "matched_term", "doc_id", "text_preview")
    found = hit.groupBy("case_id").agg(F.count("*").alias("found"))
    hit = top(hit, ["case_id"], [F.col("term_no"), F.col("doc_id")], examples, "n").join(found, "case_id")
    scores = pair_scores(index, hit.select(F.col("case_id").alias("query_id"), "doc_id"), queries).withColumnRenamed("query_id", "case_id").withColumnRenamed("score", "bm25_score")
    hit = hit.join(scores, ["case_id", "doc_id"])
    return hit.select("case_id", "query", "found", "n", "doc_id", "matched_term", "bm25_score", "text_preview")


def parameter_grid(spark: SparkSession, k1s: tuple[float, ...] = (1.0, 1.5, 2.0, 2.5), bs: tuple[float, ...] = (0.5, 0.75, 1.0)) -> DataFrame:
    return spark.createDataFrame([(float(k), float(b)) for k in k1s for b in bs], "k1 double, b double")


def measure_latency(index: Index, queries: list[str], top_k: int = 10) -> dict[str, float]:
    """Wall-clock percentiles (linearly interpolated) of single-query retrieval from a stored index, in milliseconds."""
    spark, ms = index.docs.sparkSession, []
    for q in queries:
        t = time.perf_counter()
        retrieve(index, spark.createDataFrame([(0, q)], "query_id int, query_text string"), top_k).collect()
        ms.append((time.perf_counter() - t) * 1000)
    a = np.array(ms)
    return {"p50_ms": float(np.percentile(a, 50)), "p95_ms": float(np.percentile(a, 95)), "p99_ms": float(np.percentile(a, 99)), "mean_ms": float(a.mean()), "num_queries": len(ms)}


def latency_summary(latencies: DataFrame, column: str = "ms") -> DataFrame:
    """p50, p95, p99 (linearly interpolated), mean and number of a column of latencies."""
    shares = exact_percentiles(latencies, column, {f"p{p}_ms": p / 100 for p in (50, 95, 99)})
    return shares.crossJoin(F.broadcast(latencies.agg(F.avg(column).alias("mean_ms"), F.count(column).alias("num_queries"))))  # a row each


def tfidf(docs: DataFrame, max_features: int = 10_000, stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS, text: str = "body_text") -> DataFrame:
    """(doc_id, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), of unit length per document.

    Terms have two characters or more and are no stop words (by default the English ones; others can be given); the
    max_features terms of the largest total count are kept (ties by term).

    Texts are tokenized once and stored a row a document; only terms' counts are shuffled, and a document is weighted where its
    row lies, by the kept terms, which are broadcast. Rows that share a doc_id are one document: only their terms are shuffled.
    """
    bounded_batches(docs.sparkSession)
    rows = written(counted(spread(docs.select("doc_id", text)), "doc_id", text).select("doc_id", "terms", "tfs"), "counts")
    repeated = written(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id")), "repeated")
    real = (F.length("term") > 1) & ~F.col("term").isin(*stop_words) if stop_words else F.length("term") > 1
    postings = lambda d: d.select("doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("doc_id", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf")).where(real)
    shared = None
    if repeated.isEmpty():
        tf = postings(rows)
    else:
        same = rows["doc_id"].eqNullSafe(repeated["__id"])
        shared = postings(rows.join(repeated, same, "left_semi")).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
        one = rows.join(repeated, same, "left_anti")
        tf = postings(one).union(shared)
    top = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.col("total").desc(), "term").limit(max_features).select("term", "df").toArrow()  # a parameter
    weight = np.log((1 + rows.count()) / (1 + top["df"].to_numpy())) + 1
    held = docs.sparkSession.sparkContext.broadcast((top["term"].to_pylist(), weight))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weight = pa.array(held.value[0], pa.string()), held.value[1]
        for b in batches:
            at = pc.fill_null(pc.index_in(b.column(1).flatten(), words), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
            ok = at >= 0
            at, row = at[ok], row[ok]
            w = b.column(2).flatten().to_numpy()[ok] * weight[at]
            length = np.sqrt(np.bincount(row, w * w, b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), words.take(pa.array(at)), pa.array(w / length[row])], ["doc_id", "term", "weight"])

    types = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, term string, weight double"
    if shared is None:
        return rows.mapInArrow(weigh, types)
    kept = F.broadcast(docs.sparkSession.createDataFrame(list(zip(held.value[0], weight.tolist(), strict=True)), "term string, idf double"))  # max_features rows
    w = shared.join(kept, "term").withColumn("w", F.col("tf") * F.col("idf"))
    w = w.withColumn("length", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id"))))
    return one.mapInArrow(weigh, types).union(w.select("doc_id", "term", F.col("w") / F.col("length")))
