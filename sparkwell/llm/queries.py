"""The registered queries of this subpackage: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, Jaccard of 0.9 or more: doc_id, n_shingles, component_id."""
    from .ngram_join import ngram_jaccard_join

    members, _ = ngram_jaccard_join(spark, read(spark, sf_dir, "documents"), k=3, percent=90, complete=False)
    return members.select("doc_id", "n_shingles", "component_id")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    from .warc import write_and_read

    r = write_and_read(spark, read(spark, sf_dir, "pages"), min_payload=0)
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.93 or more inside a label: vec_id, n_links, component_id, kept."""
    from .embedding_dedup import near_dedup

    return near_dedup(spark, read(spark, sf_dir, "embeddings"), 0.93)


def op4_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best integer inner products of each 50th vector: query_id, rank, vec_id, score."""
    from .topk_search import top_k

    return top_k(spark, read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, 256.0)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    from .language_model import lm_scores

    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return lm_scores(spark, read(spark, sf_dir, "documents"), held_out)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text: doc_id, held_out, lang_pred, score."""
    from .language_id import identify, learn

    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = learn(spark, docs, ~held_out)
    return identify(spark, docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: page_id, host, path, rule, verdict."""
    from .url_filter import Rule, url_filter

    rules = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("block", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]
    d = url_filter(spark, read(spark, sf_dir, "pages"), rules)
    return d.select("page_id", "host", "path", "rule", "pattern", "verdict")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids: one row per piece, with the CRC of its ids."""
    from .packing import pack

    p = pack(spark, read(spark, sf_dir, "documents"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "begins", "ends")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by text, source and language within the source: evidence, posteriors, kept."""
    from .quality import assess

    return assess(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "source", "lang", ["doc_id", "source", "lang"])


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature mixing, every source seen at least once and at most twice: a row per drawn copy of a document."""
    from .mixing import mixture

    d, _ = mixture(spark, read(spark, sf_dir, "documents"), most_repeats=2.0)
    return d.select("doc_id", "source", "n_tokens", "epoch", "weight", "block", "block_key")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 10 code points or more stay in the first of the documents that share them: doc_id, n_lines, n_dropped, kept_sha256."""
    from .line_dedup import line_dedup

    d = line_dedup(spark, read(spark, sf_dir, "documents"), least_length=10, least_documents=2)
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 centroids, 5 rounds: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    from .centroid_clustering import centroid_clustering

    return centroid_clustering(spark, read(spark, sf_dir, "embeddings"), k=40, rounds=5)


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_exact_topk_search": op4_exact_topk_search,
    "op5_language_model": op5_language_model,
    "op6_language_id": op6_language_id,
    "op7_url_filter": op7_url_filter,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_mixing_sources": op10_mixing_sources,
    "op11_line_dedup": op11_line_dedup,
    "op12_centroid_clustering": op12_centroid_clustering,
}

#: Least node reachable over the links l(a, b) from every node of n(x).
_REACH = """
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT x, x FROM n UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
comp AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)"""



def _clustering_sql(k: int = 40, rounds: int = 5, d: int = 64) -> str:
    """The rounds written out one after another; a distance and its centroid are compared as one number."""
    out = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {d} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1 AS INTEGER) AS j, e AS c FROM v WHERE vec_id IS NOT NULL ORDER BY j LIMIT {k})",
    ]
    nearest = "(SELECT min(list_sum(list_transform(list_zip(v.e, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * 1000 + c.j) FROM c{0} c)"
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, e, {nearest.format(r)} AS m FROM v)")
        if r < rounds:
            sums = f"SELECT CAST(m % 1000 AS INTEGER) AS j, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM a{r}"
            means = f"SELECT j, i, sum(x) AS s, count(*) AS n FROM ({sums}) GROUP BY 1, 2"
            lists = f"SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM ({means}) GROUP BY 1"
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT o.j, coalesce(x.c, o.c) AS c FROM c{r} o LEFT JOIN ({lists}) x ON x.j = o.j)")
    out.append(f"f AS (SELECT vec_id, CAST(m % 1000 AS INTEGER) AS cluster, CAST(m // 1000 AS BIGINT) AS distance FROM a{rounds})")
    last = f"SELECT j, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM c{rounds}"
    return f"WITH {', '.join(out)} SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM f JOIN ({last}) ON j = cluster"


ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
p AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m FROM p a JOIN p b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * k >= 90 * (n + m - k)),
n AS (SELECT doc_id AS x FROM s),""" + _REACH + """
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, comp.component_id FROM s JOIN comp ON comp.x = s.doc_id""",
    "op2_warc_revisits": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d""",
    "op3_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT vec_id AS x FROM embeddings),""" + _REACH + """,
k AS (SELECT a AS x, count(*) AS n_links FROM e GROUP BY a)
SELECT comp.x AS vec_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links, comp.component_id, comp.x = comp.component_id AS kept FROM comp LEFT JOIN k ON k.x = comp.x""",
    "op4_exact_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest, lower(coalesce(url, '')) AS low FROM pages),
h AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '/.*$') AS path FROM u),
w AS (SELECT *, CASE
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
  CASE WHEN contains(low, 'cheap-pills.') THEN 'cheap-pills.' WHEN contains(low, '/casino-') THEN '/casino-' WHEN contains(low, '://ads.') THEN '://ads.'
  WHEN contains(low, '/adserver/') THEN '/adserver/' WHEN regexp_matches(low, '/track/.*\.gif([^a-z0-9_.%-]|$)', 's') THEN '/track/*.gif^'
  WHEN regexp_matches(low, '://click\..*/redirect([^a-z0-9_.%-]|$)', 's') THEN '://click.*/redirect^'
  WHEN regexp_matches(low, '/wp-login\.php([^a-z0-9_.%-]|$)', 's') THEN '/wp-login.php^' END AS pattern FROM h)
SELECT page_id, host, path, rule, pattern, CASE WHEN rule IN ('example.com/en/7', 'example.net/de/8') THEN 'allow' WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM w""",
    "op11_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, pos, line, coalesce(k.doc_id <> first, false) AS gone FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op12_centroid_clustering": _clustering_sql(),
}
