"""What queries share: tables in the roles of the engine, and the SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.operators.corpus import corpus
from siftmark.operators.corpus import stored_blobs
from siftmark.operators.ranking import fuse
from siftmark.runtime import table


def source(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The corpus of the last snapshot, and the blobs."""
    files, blobs = table(spark, sf, "files"), table(spark, sf, "blobs")
    return corpus(files, blobs), blobs


def texts(spark: SparkSession, sf: str, paths: str | None = None) -> DataFrame:
    """(repo, path, blob, content) of the corpus, or of its paths that match an expression; only their contents are moved."""
    files, blobs = source(spark, sf)
    if paths:
        files = files.where(F.col("path").rlike(paths))
        blobs = blobs.where(F.col("blob").isNotNull()).withColumn("blob", F.lower("blob")).join(files.select("blob").distinct(), "blob", "left_semi")
    return files.join(stored_blobs(blobs), "blob").select("repo", "path", "blob", "content")


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Fused candidates with a place and a score, in the form of hits."""
    rows = table(spark, sf, "candidates")
    usable = F.col("repo").isNotNull() & F.col("path").isNotNull() & F.col("line").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score")
    return rows.where(usable).select("repo", "path", "line", F.col("candidate_id").alias("text"), "kind", "score", "found_by")


def fused(spark: SparkSession, sf: str) -> DataFrame:
    return fuse(hits(spark, sf))


CORPUS = r"""
f0 AS (SELECT snapshot, repo, regexp_replace(replace(path, '\', '/'), '^\./', '') AS path, lower(blob) AS blob, delivered_at FROM files WHERE snapshot IS NOT NULL),
entries AS (SELECT snapshot, repo, path, blob FROM (SELECT *, row_number() OVER (PARTITION BY snapshot, repo, path ORDER BY delivered_at DESC NULLS LAST, blob DESC NULLS LAST) AS rn FROM f0) WHERE rn = 1),
stored AS (SELECT lower(blob) AS blob, min(content) AS content FROM blobs WHERE blob IS NOT NULL AND content IS NOT NULL GROUP BY 1),
corpus AS (SELECT repo, path, blob, content FROM entries JOIN stored USING (blob) WHERE snapshot = (SELECT max(snapshot) FROM files)
  AND NOT regexp_matches(path, '(^|/)(\.git|\.idea|\.venv|node_modules|target|build|dist)/')
  AND NOT regexp_matches(path, '(?i)(^|/)(\.env|\.envrc|credentials|credentials\.json|service-account\.json|id_rsa|id_ed25519|keystore)$|\.(key|pem|p12|pfx|jks)$')),
parts0 AS (SELECT repo, path, blob, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) AS p FROM corpus),
parts AS (SELECT repo, path, blob, CASE WHEN p[len(p)] = '' THEN list_slice(p, 1, len(p) - 1) ELSE p END AS p FROM parts0),
lines AS (SELECT repo, path, blob, unnest(range(1, len(p) + 1))::INT AS line, unnest(p) AS text FROM parts)"""

HITS = """
hits AS (SELECT repo, path, line, candidate_id AS text, kind, score, found_by FROM candidates
  WHERE repo IS NOT NULL AND path IS NOT NULL AND line IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),"""

FUSED = """
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, line ORDER BY score DESC, kind DESC, found_by DESC, text DESC) AS rn FROM hits) WHERE rn = 1),
chan AS (SELECT repo, path, line, list_sort(list_distinct(flatten(list(found_by)))) AS channels FROM hits GROUP BY ALL),
fused AS (
  SELECT repo, path, line, text, kind, channels AS found_by, round(score
    + (CASE WHEN contains(kind, 'definition') THEN 14 ELSE 0 END) + (CASE WHEN contains(kind, 'requested') THEN 30 ELSE 0 END)
    + (CASE WHEN contains(kind, 'test') THEN 8 ELSE 0 END) + (CASE WHEN contains(kind, 'relationship') THEN 6 ELSE 0 END)
    - (CASE WHEN contains('/' || lower(path) || '/', '/generated/') OR contains('/' || lower(path) || '/', '/vendor/') THEN 25 ELSE 0 END)
    + 100 * coalesce(list_sum(list_transform(range(1, len(channels) + 1), lambda i: 1.0::DOUBLE / (60 + i))), 0), 3) AS score
  FROM best JOIN chan USING (repo, path, line))"""

HITS = HITS + FUSED


def regions(distance: int) -> str:
    """The fold of fused hits into regions: repo, path, line, score, kinds and channels of each. The query has to be recursive."""
    parts = "list_transform(string_split({k}, ','), lambda x: trim(x))"
    near = f"n.line - f.line > {distance}"
    return f"""
n AS MATERIALIZED (SELECT repo, path, line, score, {parts.format(k="kind")} AS kinds, found_by, row_number() OVER (PARTITION BY repo, path ORDER BY line) AS i FROM fused),
fold AS (
  SELECT repo, path, 1::BIGINT AS i, 1 AS region, line, score, kinds, found_by FROM n WHERE i = 1
  UNION ALL
  SELECT n.repo, n.path, n.i, CASE WHEN {near} THEN f.region + 1 ELSE f.region END,
    CASE WHEN {near} OR n.score > f.score THEN n.line ELSE f.line END, CASE WHEN {near} OR n.score > f.score THEN n.score ELSE f.score END,
    CASE WHEN {near} THEN n.kinds ELSE list_concat(f.kinds, list_filter(n.kinds, lambda x: NOT list_contains(f.kinds, x))) END,
    CASE WHEN {near} THEN n.found_by ELSE list_sort(list_distinct(list_concat(f.found_by, n.found_by))) END
  FROM fold f JOIN n ON n.repo = f.repo AND n.path = f.path AND n.i = f.i + 1),
regions AS (SELECT repo, path, arg_max(line, i) AS line, arg_max(score, i) AS score, arg_max(kinds, i) AS kinds, arg_max(found_by, i) AS found_by FROM fold GROUP BY repo, path, region)"""
