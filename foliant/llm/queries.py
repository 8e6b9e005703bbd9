"""The registered queries of this subpackage and, where SQL can say it, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import counts, fingerprints, jaccard, mixing, negatives, packing, pieces, quality, simhash, substrings, topk, urls, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.judge(_read(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"), urls.rule_table(spark, urls.RULES))


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rhost, rpath, says) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rows AS (SELECT row_number() OVER () AS n, * FROM parts),
hits AS (
  SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(says, length(rhost || rpath)) AS says
  FROM rows JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(says, 'allow') AS verdict FROM rows LEFT JOIN hits USING (n)
"""


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(_read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(_read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_read(spark, sf_dir, "documents"))
    return packed.select("shard", "pack", "n_tokens", "n_segments", "doc_ids", "piece_nos", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("position_ids", 256).alias("positions_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(_read(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(_read(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS n, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT n, doc_id, list_sort(list_distinct(list_transform(range(1, CASE WHEN len(ws) = 0 THEN 1 WHEN len(ws) < 5 THEN 2 ELSE len(ws) - 3 END), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')))) AS g FROM w),
k AS (SELECT n, doc_id, g, md5(array_to_string(g, chr(10))) AS h FROM s),
c AS (SELECT h, min(doc_id) AS same_id, count(*) AS n_copies, any_value(g) AS g FROM k GROUP BY h),
e AS (SELECT same_id, len(g) AS z, unnest(g) AS x FROM c),
p AS (SELECT a.same_id AS a, b.same_id AS b, count(*) AS common, any_value(a.z) AS za, any_value(b.z) AS zb FROM e a JOIN e b ON a.x = b.x AND a.same_id <> b.same_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE common >= 0.8 * (za + zb - common)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a AS same_id, count(*) AS n_links FROM l GROUP BY 1),
m AS (SELECT a AS same_id, min(b) AS least FROM r GROUP BY 1)
SELECT doc_id, least(same_id, coalesce(least, same_id)) AS class_id, n_copies, coalesce(n_links, 0) AS n_links, same_id FROM k JOIN c USING (h) LEFT JOIN n USING (same_id) LEFT JOIN m USING (same_id)
"""


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked(_read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_read(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS l, a.e AS of, r.vec_id, r.label, CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id OR a.label <> r.label WHERE a.vec_id % 50 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id, l, of ORDER BY score DESC, vec_id) AS n FROM s WHERE label = l),
w AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.l, p.of, p.n ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND p.l = s.l AND p.of = s.of AND s.label <> s.l AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
  WHERE p.n <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 3
"""


QUERIES = {
    "op1_quality": op1_quality,
    "op2_substrings": op2_substrings,
    "op3_url_filters": op3_url_filters,
    "op4_fingerprints": op4_fingerprints,
    "op5_mixing": op5_mixing,
    "op6_topk": op6_topk,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_jaccard": op10_jaccard,
    "op11_simhash": op11_simhash,
    "op12_whitening": op12_whitening,
    "op13_negatives": op13_negatives,
}
ORACLES = {"op3_url_filters": OP3_SQL, "op6_topk": OP6_SQL, "op10_jaccard": OP10_SQL, "op13_negatives": OP13_SQL}
