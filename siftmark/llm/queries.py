"""Queries p1 to p3 and p5 to p10 and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.llm.bpe import encode
from siftmark.llm.credentials import find_credentials, redact_credentials
from siftmark.llm.handwritten import judged_files
from siftmark.llm.mixing import mixed
from siftmark.llm.neighbours import most_similar, similar_pairs, usable_vectors
from siftmark.llm.rankagg import aggregate_ranks, channel_scores
from siftmark.llm.repetition import with_flag, with_share
from siftmark.llm.split import oversized_pieces
from siftmark.llm.topn import best_per_file
from siftmark.runtime import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return oversized_pieces(table(spark, sf, "chunks")).where(F.col("piece_no") == 1).select("chunk_id")


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return oversized_pieces(table(spark, sf, "chunks"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return similar_pairs(most_similar(usable_vectors(table(spark, sf, "embedding_cache")), 5))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    scores = channel_scores(table(spark, sf, "raw_candidates"), table(spark, sf, "score_channels"))
    return aggregate_ranks(scores, top=3).select("request_id", "repo", "path", "line")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return best_per_file(table(spark, sf, "candidates")).select("candidate_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return find_credentials(table(spark, sf, "blobs")).select("blob", "line").distinct()


def p6_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return redact_credentials(table(spark, sf, "blobs"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return judged_files(table(spark, sf, "files"), table(spark, sf, "blobs")).where(~F.col("by_hand")).select("repo", "path")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(table(spark, sf, "documents").select("doc_id", "text"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixed(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixed(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return with_flag(table(spark, sf, "documents").select("doc_id", "text")).where("repetitive").select("doc_id")


def p10_share(spark: SparkSession, sf: str) -> DataFrame:
    return with_share(table(spark, sf, "documents").select("doc_id", "text"))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_share": p10_share,
}

ORACLE = {
    "p1_found": r"""
WITH c AS (SELECT chunk_id, chr(10) || card AS t FROM chunks WHERE card IS NOT NULL),
k AS (SELECT chunk_id, substr(t, strpos(t, chr(10) || 'Code:' || chr(10)) + 7) AS code FROM c WHERE strpos(t, chr(10) || 'Code:' || chr(10)) > 0)
SELECT DISTINCT chunk_id FROM k
WHERE length(code) > 2048 OR length(code) - length(replace(code, chr(10), '')) + (CASE WHEN code <> '' AND right(code, 1) <> chr(10) THEN 1 ELSE 0 END) > 80""",
    "p2_found": r"""
WITH latest AS (
  SELECT cache_key, pack_id, dimension, TRY_CAST(vector_json AS DOUBLE[]) AS v FROM (
    SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY last_used_at DESC NULLS LAST, created_at DESC NULLS LAST, pack_id DESC, dimension DESC, vector_json DESC) AS rn
    FROM embedding_cache WHERE cache_key IS NOT NULL) WHERE rn = 1),
u AS (
  SELECT * FROM latest WHERE pack_id IS NOT NULL AND len(v) = dimension
  AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = dimension AND len(list_filter(v, lambda x: x <> 0)) > 0),
n AS (
  SELECT a.cache_key AS a, b.cache_key AS b,
    row_number() OVER (PARTITION BY a.cache_key ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.cache_key) AS rn
  FROM u a JOIN u b ON a.pack_id = b.pack_id AND a.dimension = b.dimension AND a.cache_key <> b.cache_key)
SELECT DISTINCT least(a, b) AS cache_key_a, greatest(a, b) AS cache_key_b FROM n WHERE rn <= 5""",
    "p3_found": r"""
WITH ch AS (SELECT lower(trim(channel)) AS channel, lower(trim(kind)) AS kind, coalesce(higher_is_better, true) AS up FROM score_channels),
r0 AS (
  SELECT request_id, repo, path, line, score, lower(trim(kind)) AS kind,
    list_filter(list_transform(coalesce(found_by, []), lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '') AS names
  FROM raw_candidates WHERE score IS NOT NULL AND NOT isnan(score)),
r AS (
  SELECT request_id, repo, path, line, score, unnest(list_distinct(names)) AS channel FROM r0 WHERE len(names) > 0
  UNION ALL SELECT request_id, repo, path, line, score, ch.channel FROM r0 JOIN ch USING (kind) WHERE len(names) = 0),
s AS (SELECT request_id, repo, path, line, channel, max(CASE WHEN up THEN score ELSE -score END + 0.0) AS score FROM r JOIN ch USING (channel) GROUP BY ALL),
p AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY request_id, channel, score) - 1) / 2 AS place FROM s WINDOW w AS (PARTITION BY request_id, channel ORDER BY score DESC)),
n AS (SELECT request_id, count(DISTINCT channel) AS m, (SELECT count(*) FROM (SELECT DISTINCT repo, path, line FROM s t WHERE t.request_id = s.request_id)) AS items FROM s GROUP BY request_id),
q AS (
  SELECT *, place / items AS x, row_number() OVER (PARTITION BY request_id, repo, path, line ORDER BY place) AS k FROM p JOIN n USING (request_id)),
terms AS (
  SELECT request_id, repo, path, line, k, m, x, unnest(range(k, m + 1)) AS j FROM q),
probs AS (
  SELECT request_id, repo, path, line, k, m, x, sum(factorial(m::INT) / factorial(j::INT) / factorial((m - j)::INT) * pow(x, j) * pow(1 - x, m - j)) AS p
  FROM terms GROUP BY ALL),
score AS (
  SELECT request_id, repo, path, line, round(ln(least(1.0, min(p) * max(m))), 9) AS sig, round((sum(x) + max(m) - count(*)) / max(m), 12) AS mean
  FROM probs GROUP BY request_id, repo, path, line)
SELECT request_id, repo, path, line FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY sig, mean, repo NULLS LAST, path NULLS LAST, line NULLS LAST) AS rn FROM score) WHERE rn <= 3""",
    "p5_found": """
WITH latest AS (
  SELECT * FROM (
    SELECT candidate_id, repo, path, line, score, row_number() OVER (
      PARTITION BY candidate_id ORDER BY found_at DESC NULLS LAST, score DESC NULLS LAST, line NULLS LAST, repo NULLS LAST, path NULLS LAST) AS l
    FROM candidates) WHERE l = 1 AND repo IS NOT NULL AND path IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))
SELECT candidate_id FROM (
  SELECT candidate_id, row_number() OVER (PARTITION BY repo, path ORDER BY score DESC, line NULLS LAST, candidate_id) AS rn FROM latest) WHERE rn <= 3""",
}
