"""Snapshot comparison over the files table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftmark.operators.snapshots import consecutive, entries_by_key, snapshot_changes
from siftmark.runtime import table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshots are those that TESTDATA.md names."""
    snapshots = [1, 2, 3, 4]
    entries = entries_by_key(table(spark, sf, "files"), snapshots)
    return snapshot_changes(entries, consecutive(snapshots), placed=True).select("snapshot", "repo", "path", "change")


QUERIES = {"p4_found": p4_found}

ORACLE = {
    "p4_found": r"""
WITH rows AS (
  SELECT snapshot, repo, regexp_replace(replace(path, '\', '/'), '^\./', '') AS path, lower(blob) AS blob, delivered_at
  FROM files WHERE snapshot IS NOT NULL),
kept AS (
  SELECT snapshot, repo, path, blob FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot, repo, path ORDER BY delivered_at DESC NULLS LAST, blob DESC NULLS LAST) AS rn FROM rows)
  WHERE rn = 1),
pairs AS (SELECT unnest([2, 3, 4]) AS s),
a AS (SELECT s, repo, path, blob, 1 AS one FROM kept JOIN pairs ON snapshot = s - 1),
b AS (SELECT s, repo, path, blob, 1 AS one FROM kept JOIN pairs ON snapshot = s)
SELECT coalesce(a.s, b.s)::INT AS snapshot, coalesce(a.repo, b.repo) AS repo, coalesce(a.path, b.path) AS path,
  CASE WHEN a.one IS NULL THEN 'added' WHEN b.one IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.s = b.s AND a.repo IS NOT DISTINCT FROM b.repo AND a.path IS NOT DISTINCT FROM b.path
WHERE a.one IS NULL OR b.one IS NULL OR a.blob IS DISTINCT FROM b.blob""",
}
