"""Fusion, selection and evidence over the candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.operators import ranking as R
from siftmark.operators.corpus import blob_lines
from siftmark.queries.base import CORPUS, HITS, fused, hits, regions, source
from siftmark.runtime import table

RERANK = "harbor-core code java c0000000123 kind:"
QUERY = "Roughly some rows were affected by the old ledger writer"


def fusion_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return fused(spark, sf).select("repo", "path", "line", "kind", "score", F.array_join("found_by", ",").alias("channels"))


def channel_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = hits(spark, sf)
    return R.merged_channels(rows.where(F.col("kind") == "definition"), rows.where(F.col("kind") == "code")).select("repo", "path", "line", "kind", "score", F.array_join("found_by", ",").alias("channels"))


def region_anchor_merge(spark: SparkSession, sf: str) -> DataFrame:
    return R.anchor_regions(fused(spark, sf), 40).select("repo", "path", "line", "score", "kind", F.array_join("found_by", ",").alias("channels"))


def diversity_quota(spark: SparkSession, sf: str) -> DataFrame:
    return R.diversity(fused(spark, sf), 2, 8, 60).select("repo", "path", "line", "score", "selected")


def candidate_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return R.numbered(fused(spark, sf)).select("candidate", "repo", "path", "line", "score")


def _shown(spark: SparkSession, sf: str) -> DataFrame:
    files, blobs = source(spark, sf)
    lines = files.join(blob_lines(blobs), "blob").select("repo", "path", "line", "text")
    return lines


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _shown(spark, sf).groupBy("repo", "path").agg(F.max("line").alias("lines"))
    rows = R.source_window(fused(spark, sf), sizes, window=60, full=50)
    return rows.where(F.col("line_start") <= F.col("line_end"))


def source_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf).select("repo", "path", "line", "line_start", "line_end")


def interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    return R.merge_intervals(_windows(spark, sf)).select("repo", "path", "line_start", "line_end", "score", F.array_join("found_by", ",").alias("channels"))


def evidence_stitch(spark: SparkSession, sf: str) -> DataFrame:
    merged = R.merge_intervals(_windows(spark, sf))
    return R.stitch(merged, _shown(spark, sf)).select("repo", "path", "line_start", "line_end", F.md5("content").alias("content"))


def min_max_rerank(spark: SparkSession, sf: str) -> DataFrame:
    rows = fused(spark, sf).where(F.col("kind") == "code").select("repo", "path", "line", "score")
    return R.min_max_bonus(rows, "score", group=("repo",))


def token_overlap_rank(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", R.token_overlap(F.lit(QUERY), F.col("text")).alias("common")).where(F.col("common") > 0)


def bounded_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return R.rerank(fused(spark, sf), RERANK).select("repo", "path", "line", "score", F.array_join("found_by", ",").alias("channels"))


def budget_with_skips(spark: SparkSession, sf: str) -> DataFrame:
    rows = fused(spark, sf).withColumn("size", F.col("line") * 7)
    return R.within_budget(rows, "size", 20_000, 40)


QUERIES = {f.__name__: f for f in (fusion_rrf, channel_union, region_anchor_merge, diversity_quota, candidate_numbers, source_windows, interval_merge, evidence_stitch, min_max_rerank, token_overlap_rank, bounded_rerank, budget_with_skips)}

_WINDOWS = f"""{CORPUS}, {HITS},
sizes AS (SELECT repo, path, max(line) AS n FROM lines GROUP BY ALL),
win AS (SELECT f.*, CASE WHEN n <= 50 THEN 1 ELSE greatest(1, line - 30) END::INT AS line_start, CASE WHEN n <= 50 THEN n ELSE least(n, line + 30) END::INT AS line_end FROM fused f JOIN sizes USING (repo, path)),
w AS (SELECT * FROM win WHERE line_start <= line_end)"""
_ISLANDS = f"""{_WINDOWS},
o AS (SELECT *, max(line_end) OVER (PARTITION BY repo, path ORDER BY line_start, line_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR line_start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path ORDER BY line_start, line_end) AS island FROM o),
m AS (SELECT repo, path, min(line_start) AS line_start, max(line_end) AS line_end, max(score) AS score, array_to_string(list_sort(list_distinct(flatten(list(found_by)))), ',') AS channels FROM i GROUP BY repo, path, island)"""
_RANK = "ORDER BY score DESC, repo, path, line"

ORACLE = {
    "fusion_rrf": f"WITH {HITS} SELECT repo, path, line, kind, score, array_to_string(found_by, ',') AS channels FROM fused",
    "channel_union": f"""WITH {HITS}, u AS (SELECT * FROM hits WHERE kind IN ('definition', 'code'))
SELECT repo, path, line, max(kind) AS kind, max(score) AS score, array_to_string(list_sort(list_distinct(flatten(list(found_by)))), ',') AS channels FROM u GROUP BY repo, path, line""",
    "region_anchor_merge": f"WITH RECURSIVE {HITS}, {regions(40)} SELECT repo, path, line, score, array_to_string(kinds, ', ') AS kind, array_to_string(found_by, ',') AS channels FROM regions",
    "diversity_quota": f"""WITH {HITS}, top AS (SELECT repo, path, line, score FROM fused {_RANK} LIMIT 500),
f AS (SELECT *, row_number() OVER (PARTITION BY repo, path {_RANK}) AS a FROM top),
r AS (SELECT *, row_number() OVER (PARTITION BY repo {_RANK}) AS b FROM f WHERE a <= 2),
t AS (SELECT *, row_number() OVER ({_RANK}) AS c FROM r WHERE b <= 8)
SELECT repo, path, line, score, EXISTS (SELECT 1 FROM t WHERE t.repo = top.repo AND t.path = top.path AND t.line = top.line AND c <= 60) AS selected FROM top""",
    "candidate_numbers": f"WITH {HITS} SELECT 'C' || row_number() OVER ({_RANK}) AS candidate, repo, path, line, score FROM fused {_RANK} LIMIT 50",
    "source_windows": f"WITH {_WINDOWS} SELECT repo, path, line, line_start, line_end FROM w",
    "interval_merge": f"WITH {_ISLANDS} SELECT repo, path, line_start, line_end, score, channels FROM m",
    "evidence_stitch": f"""WITH {_ISLANDS},
e AS (SELECT repo, path, line_start, line_end, unnest(range(line_start, line_end + 1)) AS line FROM m)
SELECT e.repo, e.path, line_start, line_end, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY e.line)) AS content FROM e LEFT JOIN lines l ON l.repo = e.repo AND l.path = e.path AND l.line = e.line GROUP BY ALL""",
    "min_max_rerank": f"""WITH {HITS}, c AS (SELECT repo, path, line, score FROM fused WHERE kind = 'code'),
x AS (SELECT *, min(score) OVER (PARTITION BY repo) AS lo, max(score) OVER (PARTITION BY repo) AS hi FROM c)
SELECT repo, path, line, score, round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END * 20.0, 3) AS bonus FROM x""",
    "token_overlap_rank": rf"""WITH q AS (SELECT list_distinct(regexp_split_to_array(lower('{QUERY}'), '\s+')) AS q),
d AS (SELECT doc_id, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '\s+')), q))::INT AS common FROM documents, q WHERE text IS NOT NULL)
SELECT * FROM d WHERE common > 0""",
    "bounded_rerank": rf"""WITH {HITS}, free AS (SELECT * FROM fused WHERE NOT contains(lower(coalesce(kind, '')), 'definition') AND NOT contains(lower(coalesce(kind, '')), 'requested') {_RANK} LIMIT 40),
v AS (SELECT *, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower('Repository: ' || repo || chr(10) || 'Path: ' || path || chr(10) || 'Language: '
    || CASE WHEN regexp_extract(string_split(path, '/')[-1], '.\.([^.]*)$', 1) <> '' THEN lower(regexp_extract(string_split(path, '/')[-1], '.\.([^.]*)$', 1)) ELSE 'text' END || chr(10) || 'Kind: ' || coalesce(kind, '') || chr(10) || 'Snippet: ' || trim(coalesce(text, ''))), '\s+'), lambda w: w <> '')),
    list_distinct(regexp_split_to_array(lower('{RERANK}'), '\s+'))))::DOUBLE AS v FROM free),
b AS (SELECT repo, path, line, round(CASE WHEN max(v) OVER () = min(v) OVER () THEN 1.0 ELSE (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) END * 20, 3) AS n FROM v)
SELECT f.repo, f.path, f.line, CASE WHEN n IS NULL THEN f.score ELSE round(f.score + n, 3) END AS score, array_to_string(CASE WHEN n IS NULL THEN f.found_by ELSE list_sort(list_append(f.found_by, 'reranker')) END, ',') AS channels
FROM fused f LEFT JOIN b ON b.repo = f.repo AND b.path = f.path AND b.line = f.line""",
    "budget_with_skips": f"""WITH RECURSIVE {HITS}, t AS MATERIALIZED (SELECT repo, path, line, line * 7::BIGINT AS size, row_number() OVER ({_RANK}) AS i FROM fused {_RANK} LIMIT 40),
g AS (SELECT repo, path, line, size, i, size AS used, true AS taken FROM t WHERE i = 1
  UNION ALL SELECT t.repo, t.path, t.line, t.size, t.i, CASE WHEN g.used + t.size <= 20000 THEN g.used + t.size ELSE g.used END, g.used + t.size <= 20000 FROM g JOIN t ON t.i = g.i + 1)
SELECT repo, path, line, size, taken FROM g""",
}
