"""Evaluations, sessions, states of sources and what is written about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmark.functions import text as X
from siftmark.operators import corpus as C
from siftmark.operators import history as H
from siftmark.operators import lexical as L
from siftmark.operators import measure as M
from siftmark.operators import models as MO
from siftmark.operators import relations as R
from siftmark.plans import report
from siftmark.queries.base import CORPUS, source, texts
from siftmark.runtime import table
from siftmark.sources.readers import flattened

FOUND = "score IS NOT NULL AND NOT isnan(score) AND repo IS NOT NULL AND path IS NOT NULL"


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_candidates").where(FOUND).withColumn("item", F.concat_ws(":", "repo", "path"))


def _shown(spark: SparkSession, sf: str) -> DataFrame:
    """What each ticket's session has shown: the code hits of its requests by score."""
    tickets = table(spark, sf, "requests").select("request_id", "ticket")
    rows = _found(spark, sf).where(F.col("kind") == "code").join(tickets, "request_id").select("ticket", "item", "line", "score").distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("ticket").orderBy(F.col("score").desc(), "item", "line")))


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    """What commits of a ticket changed: here, the locations of similar cases."""
    tickets = table(spark, sf, "requests").select("request_id", "ticket")
    rows = _found(spark, sf).where(F.col("kind") == "similar case").join(tickets, "request_id")
    lists = rows.groupBy("ticket").agg(F.array_sort(F.collect_set("item")).alias("paths"), F.array_sort(F.collect_set("repo")).alias("repos"))
    return lists.withColumn("test_paths", F.filter("paths", lambda p: X.is_test(F.regexp_replace(p, "^[^:]*:", ""))))


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def session_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.session_evaluation(_shown(spark, sf), _changed(spark, sf))
    return _rounded(rows.withColumn("missed", F.size("missed")))


def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.session_summary(M.session_evaluation(_shown(spark, sf), _changed(spark, sf))))


def golden_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    rows = _found(spark, sf)
    ranked = rows.where(F.col("kind") == "code").select(F.col("request_id").alias("case"), "item", "line", "score").distinct()
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy(F.col("score").desc(), "item", "line")))
    split = F.when(F.col("request_id") % 3 == 0, "calibration").when(F.col("request_id") % 3 == 1, "validation")
    role = F.when(F.col("kind") == "reranked", "excluded").when(X.is_test(F.col("path")), "tests").otherwise("production")
    suite = rows.where(F.col("kind").isin("semantic", "reranked") & (F.col("line") % 2 == 0)).select(F.col("request_id").alias("case"), split.alias("split"), "item", role.alias("role"))
    return _rounded(M.golden_evaluation(ranked, suite, 15))


def evidence_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds of a user are hours; the evidence of one is the types of its events with their last digit."""
    events = table(spark, sf, "events")
    rows = events.select(F.col("user_id").alias("session"), F.floor(F.col("event_id") / 50).cast("int").alias("number"), F.concat_ws(":", "event_type", (F.col("event_id") % 10).cast("string")).alias("key"))
    return M.with_progress(rows.select("session", "number").distinct(), rows)


def backend_counters(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "events").select((F.col("user_id") % 7).alias("run"), F.col("event_type").alias("backend"), F.round("value").alias("elapsed_ms"), F.lit(1).alias("files"), F.get_json_object("props", "$.k").cast("int").alias("raw_hits"), (F.col("event_id") % 2 == 0).alias("cache_hit"))
    return M.backend_counters(calls, ["run"]).select("run", "operations", "files_visited", "raw_hits", "cache_hits", F.explode("backend_ms").alias("backend", "ms"))


def _sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    repos = table(spark, sf, "repositories")
    n = F.length("name") % 5
    status = F.when(n == 0, "fetch-failed").when(n == 1, "non-git").otherwise("current")
    sources = repos.select("name", F.col("source_sha").alias("sha"), status.alias("status"), F.when(n == 2, F.lit("old branch")).alias("warning"))
    indexed = repos.where(F.length("name") % 7 != 0).select("name", F.when(F.length("name") % 4 == 0, F.lit("0000")).otherwise(F.col("source_sha")).alias("sha"))
    return sources, indexed


def project_status(spark: SparkSession, sf: str) -> DataFrame:
    return C.project_status(*_sources(spark, sf))


def index_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return C.freshness(*_sources(spark, sf)).select("name", "fresh")


def tree_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Which of the snapshots of a repository are alike, by signature: the earliest one with the same tree."""
    from siftmark.operators.snapshots import latest_entries

    signed = C.tree_signature(latest_entries(table(spark, sf, "files")), ["repo", "snapshot"], ["path", "blob"])
    first = F.min("snapshot").over(Window.partitionBy("repo", "signature"))
    return signed.select("repo", "snapshot", first.alias("same_as"))


def repeated_plans(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("number"), F.sha2(F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")), 256).alias("signature"), F.lit("s").alias("source"))
    return M.repeated_plans(rows, "session", "number", "signature", "source").select("session", "number", "repeats")


def pinned_rows(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "files").where(F.col("repo").isNotNull() & F.col("path").isNotNull()).select(F.lit("T").alias("session"), "repo", F.col("snapshot").cast("string").alias("sha"), "path")
    pins = table(spark, sf, "repositories").select(F.lit("T").alias("session"), F.col("name").alias("repo"), (F.length("name") % 5).cast("string").alias("sha"))
    return M.pinned(files, pins).groupBy("repo").agg(F.count_distinct("path").alias("paths"))


def missing_pins(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "files").select("repo", F.col("snapshot").cast("string").alias("sha"))
    pins = table(spark, sf, "repositories").select(F.lit("T").alias("session"), F.col("name").alias("repo"), (F.length("name") % 5).cast("string").alias("sha"))
    return M.missing_pins(pins, stored)


def session_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "raw_candidates").where(F.col("repo").isNotNull() & F.col("path").isNotNull()).select("request_id", "repo", "path", F.col("kind"))
    pick = lambda kind: rows.where(F.col("kind") == kind)
    return M.session_coverage(rows, ["request_id"], relationships=pick("structural definition"), cases=pick("similar case"))


def text_pieces(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.posexplode(X.cut_text(F.col("text"), 900)).alias("piece", "text")).select("doc_id", "piece", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def new_repositories(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "files").where(F.col("repo").isNotNull()).select(F.concat(F.lit("./work/"), F.col("repo")).alias("path"))
    known = table(spark, sf, "repositories").select(F.col("name"), F.concat(F.lit("work/"), F.when(F.length("name") % 2 == 0, F.col("name")).otherwise(F.concat(F.col("name"), F.lit("-old")))).alias("path"))
    return C.named(found, known)


def git_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Trees as the version control prints them, read again: regular files only."""
    files = C.snapshot_files(table(spark, sf, "files"))
    mode = F.when(F.length("path") % 11 == 0, "120000").when(F.length("path") % 7 == 0, "100755").otherwise("100644")
    record = F.concat(mode, F.lit(" blob "), F.col("blob"), F.lit("\t"), F.col("path"), F.lit("\x00"))
    part = F.pmod(F.xxhash64("path"), F.lit(8))
    trees = files.where(F.col("repo").isNotNull() & F.col("path").isNotNull()).groupBy("repo", part.alias("part")).agg(F.array_join(F.collect_list(record), "").alias("text"))
    return H.git_manifest(trees.select("repo", "text"))


def fetchable_blobs(spark: SparkSession, sf: str) -> DataFrame:
    blobs = table(spark, sf, "blobs").where(F.col("blob").isNotNull() & F.col("content").isNotNull()).select(F.lower("blob").alias("blob"), F.octet_length("content").alias("n"))
    lines = F.concat(F.col("blob"), F.lit(" blob "), F.col("n").cast("string"), F.lit("\n"))
    sizes = blobs.groupBy(F.substring("blob", 1, 1).alias("p")).agg(F.array_join(F.collect_list(lines), "").alias("text"))
    known = blobs.where(F.col("blob").rlike("^[0-7]")).select("blob")
    return H.fetchable(C.snapshot_files(table(spark, sf, "files")), sizes, known, 2000)


def payload_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects at any depth of nested payloads, those within texts and tables too."""
    rows = table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.struct(F.array("props", F.lit("[no json")).alias("inner"), F.col("user_id").alias("line")).alias("a"), F.array(F.lit("k"), F.lit("path")).alias("columns"), F.array(F.array(F.col("value").cast("string"), F.col("event_type"))).alias("rows"))).alias("payload"))
    out = flattened(rows, "event_id", "payload").where(F.size("fields") > 0)
    return out.select("event_id", F.try_element_at("fields", F.lit("k")).alias("k"), F.try_element_at("fields", F.lit("path")).alias("path"), F.try_element_at("fields", F.lit("line")).alias("line")).where("k IS NOT NULL OR line IS NOT NULL")


def project_facts(spark: SparkSession, sf: str) -> DataFrame:
    files, blobs = source(spark, sf)
    return report.fact_lines(table(spark, sf, "repositories").select(F.col("name").alias("repo"), "description"), L.framework_facts(files, blobs), R.maven_facts(texts(spark, sf, r"(^|/)pom\.xml$")))


def vector_conformance(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a label are a case; every seventh differs from its single call, the reference is the vector with its first number turned."""
    rows = table(spark, sf, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    single = F.transform("v", lambda x: x + F.when(F.col("vec_id") % 7 == 0, 0.001).otherwise(0.00001))
    turned = F.concat(F.array(-F.element_at("v", 1)), F.slice("v", 2, 1000))
    place = F.row_number().over(Window.partitionBy("label", F.pmod("vec_id", F.lit(50))).orderBy("vec_id")) - 1
    cases = rows.select(F.concat_ws(":", F.col("label").cast("string"), F.pmod("vec_id", F.lit(50)).cast("string")).alias("case"), place.alias("position"), F.col("v").alias("batch"), single.alias("single"), turned.alias("reference"), F.lit(0.9).alias("minimum"), F.lit(None).cast("int").alias("expected"))
    return MO.vector_conformance(cases)


def score_conformance(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("case"), "event_id", "value", F.floor(F.col("event_id") / 400).alias("part"))
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("case", "part").orderBy("event_id")) - 1)
    cases = rows.select(F.concat_ws(":", F.col("case").cast("string"), F.col("part").cast("string")).alias("case"), "position", F.col("value").alias("batch"), (F.col("value") + F.when(F.col("event_id") % 29 == 0, 0.1).otherwise(0.0)).alias("single"), F.lit(None).cast("double").alias("reference"), F.lit(None).cast("double").alias("maximum"), F.lit(0).alias("top"))
    return MO.score_conformance(cases)


def model_tuning(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").where(F.col("value") > 0)
    pick = lambda sizes: F.element_at(F.array(*[F.lit(s) for s in sizes]), (F.col("event_id") % len(sizes) + 1).cast("int"))
    batch = MO.tuned_batch(events.select(F.col("event_type").alias("pack"), pick(MO.BATCHES).alias("size"), F.round("value", 2).cast("decimal(18,2)").alias("ms")))
    pool = MO.tuned_pool(events.select(F.col("event_type").alias("pack"), pick(MO.POOLS).alias("size"), (F.col("value") * pick(MO.POOLS)).alias("ms")), 900.0)
    return batch.select("pack", F.col("size").alias("batch")).join(pool.select("pack", F.col("size").alias("pool")), "pack")


QUERIES = {
    f.__name__: f
    for f in (
        vector_conformance, score_conformance, model_tuning,
        session_evaluation, session_summary, golden_evaluation, evidence_rounds, backend_counters, project_status, index_freshness, tree_signatures, repeated_plans, pinned_rows, missing_pins, session_coverage, text_pieces,
        new_repositories, git_manifest, fetchable_blobs, payload_objects, project_facts,
    )
}

_TEST = r"(?i)(^|/)(test|tests|src/test)/|(?:Test|Tests|IT|Spec)\."
_HITS = f"hits AS (SELECT *, repo || ':' || path AS item FROM raw_candidates WHERE {FOUND})"
_SESSIONS = f"""{_HITS},
s0 AS (SELECT DISTINCT ticket, item, repo, line, score FROM hits JOIN requests USING (request_id) WHERE kind = 'code'),
shown AS (SELECT *, row_number() OVER (PARTITION BY ticket ORDER BY score DESC, item, line) AS place FROM s0),
want AS (SELECT DISTINCT ticket, item, repo, regexp_matches(path, '{_TEST}') AS test FROM hits JOIN requests USING (request_id) WHERE kind = 'similar case'),
need AS (SELECT ticket, count(DISTINCT item)::INT AS actual_files, count(DISTINCT repo)::INT AS actual_repos, count(DISTINCT CASE WHEN test THEN item END)::INT AS actual_tests FROM want GROUP BY 1),
got AS (SELECT ticket, count(DISTINCT item) AS retrieved_files, count(*) AS n FROM shown GROUP BY 1),
hit AS (SELECT s.ticket, count(DISTINCT s.item) AS matched_files, count(DISTINCT CASE WHEN test THEN s.item END) AS matched_tests FROM shown s JOIN want w ON s.ticket = w.ticket AND s.item = w.item GROUP BY 1),
rep AS (SELECT s.ticket, count(DISTINCT s.repo) AS matched_repos FROM shown s JOIN want w ON s.ticket = w.ticket AND s.repo = w.repo GROUP BY 1),
top AS (SELECT s.ticket, min(place) AS best, sum(1 / log2(place + 1)) AS gain FROM shown s WHERE place <= 10 AND EXISTS (SELECT 1 FROM want w WHERE w.ticket = s.ticket AND w.item = s.item) GROUP BY 1),
e AS (SELECT ticket, actual_files, retrieved_files, coalesce(matched_files, 0) AS matched_files, actual_repos, coalesce(matched_repos, 0) AS matched_repos, actual_tests, coalesce(matched_tests, 0) AS matched_tests,
  coalesce(1 / best, 0.0) AS mrr, coalesce(gain, 0) / list_sum(list_transform(range(1, least(10, actual_files) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, 1 - retrieved_files / n AS duplicate_ratio
  FROM need JOIN got USING (ticket) LEFT JOIN hit USING (ticket) LEFT JOIN rep USING (ticket) LEFT JOIN top USING (ticket))"""
_SUITE = f"""{_HITS},
r0 AS (SELECT DISTINCT request_id AS c, item, line, score FROM hits WHERE kind = 'code'),
r1 AS (SELECT c, item, row_number() OVER (PARTITION BY c ORDER BY score DESC, item, line) AS rank FROM r0),
r2 AS (SELECT c, item, min(rank) AS rank FROM r1 GROUP BY ALL),
r AS (SELECT *, string_split(item, ':')[1] AS repo, row_number() OVER (PARTITION BY c ORDER BY rank, item) AS place FROM r2),
s AS (SELECT DISTINCT request_id AS c, coalesce(CASE request_id % 3 WHEN 0 THEN 'calibration' WHEN 1 THEN 'validation' END, 'holdout') AS split, item, repo, CASE WHEN kind = 'reranked' THEN 'excluded' WHEN regexp_matches(path, '{_TEST}') THEN 'tests' ELSE 'production' END AS role
  FROM hits WHERE kind IN ('semantic', 'reranked') AND line % 2 = 0),
cases AS (SELECT c, split, count(DISTINCT CASE WHEN role <> 'excluded' THEN item END) AS nf, count(DISTINCT CASE WHEN role <> 'excluded' THEN repo END) AS nr, count(DISTINCT CASE WHEN role = 'tests' THEN item END) AS nt FROM s GROUP BY ALL),
m AS (SELECT r.c, place, r.item, r.repo, bool_or(role IN ('production', 'tests')) AS f, bool_or(role = 'tests') AS t, bool_or(role = 'excluded') AS x FROM r JOIN s ON r.c = s.c AND r.item = s.item GROUP BY ALL),
rr AS (SELECT c, repo, min(place) AS place FROM r GROUP BY ALL),
mr AS (SELECT DISTINCT rr.c, rr.repo, place FROM rr JOIN s ON s.c = rr.c AND s.repo = rr.repo AND role <> 'excluded'),
size AS (SELECT c, count(*) AS n FROM r GROUP BY 1), raw AS (SELECT c, count(*) AS n FROM r1 GROUP BY 1)"""


def _count(table_: str, condition: str) -> str:
    return f"(SELECT count(*) FROM {table_} m WHERE m.c = k.c AND {condition})"


# up to the last line end of the second half of 900 characters
_HEAD = r"CASE WHEN length({t}) <= 900 THEN {t} WHEN contains(substr({t}, 451, 450), chr(10)) THEN substr({t}, 1, 450 + length(regexp_extract(substr({t}, 451, 450), '(?s)^(.*\n)', 1))) ELSE substr({t}, 1, 900) END"

ORACLE = {
    "session_evaluation": f"""WITH {_SESSIONS} SELECT ticket, actual_files, retrieved_files, matched_files, actual_repos, matched_repos, actual_tests, matched_tests, round(matched_files / actual_files, 6) AS file_recall, round(matched_repos / actual_repos, 6) AS repo_recall,
  CASE WHEN actual_tests > 0 THEN round(matched_tests / actual_tests, 6) END AS test_recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, round(matched_files / retrieved_files, 6) AS precision, round(duplicate_ratio, 6) AS duplicate_ratio, (actual_files - matched_files)::INT AS missed FROM e""",
    "session_summary": f"""WITH {_SESSIONS} SELECT count(*) AS sessions, round(sum(matched_repos) / sum(actual_repos), 6) AS repo_recall, round(sum(matched_files) / sum(actual_files), 6) AS file_recall, round(sum(matched_tests) / nullif(sum(actual_tests), 0), 6) AS test_recall,
  round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(matched_files / retrieved_files), 6) AS precision, round(avg(duplicate_ratio), 6) AS duplicate_ratio FROM e""",
    "golden_evaluation": f"""WITH {_SUITE} SELECT k.c AS "case", split, CASE WHEN nr > 0 THEN round({_count("mr", "place <= 5")} / nr, 6) END AS repo_recall_at_5, CASE WHEN nr > 0 THEN round({_count("mr", "place <= 10")} / nr, 6) END AS repo_recall_at_10,
  {", ".join(f"CASE WHEN nf > 0 THEN round({_count('m', f'f AND place <= {n}')} / nf, 6) END AS file_recall_at_{n if n != 15 else 'limit'}" for n in (5, 10, 20, 15))},
  CASE WHEN nt > 0 THEN round({_count("m", "t AND place <= 15")} / nt, 6) END AS test_recall_at_limit, CASE WHEN nt > 0 THEN round({_count("m", "t AND place <= 10")} / nt, 6) END AS test_recall_at_10,
  CASE WHEN nf > 0 THEN round(coalesce((SELECT 1 / min(place) FROM m WHERE m.c = k.c AND f AND place <= 10), 0), 6) END AS mrr_at_10,
  CASE WHEN nf > 0 THEN round(coalesce((SELECT sum(1 / log2(place + 1)) FROM m WHERE m.c = k.c AND f AND place <= 10), 0) / list_sum(list_transform(range(1, least(10, nf) + 1), lambda i: 1 / log2(i + 1))), 6) END AS ndcg_at_10,
  CASE WHEN size.n > 0 THEN round({_count("m", "f AND place <= 5")} / least(5, size.n), 6) END AS precision_at_5, CASE WHEN size.n > 0 THEN round({_count("m", "f AND place <= 10")} / least(10, size.n), 6) END AS precision_at_10,
  {_count("m", "x AND place <= 10")}::INT AS false_positives_at_10, round(coalesce(1 - size.n / raw.n, 0), 6) AS duplicate_ratio FROM cases k LEFT JOIN size ON size.c = k.c LEFT JOIN raw ON raw.c = k.c""",
    "evidence_rounds": """WITH e AS (SELECT DISTINCT user_id AS session, (event_id // 50)::INT AS number, event_type || ':' || (event_id % 10) AS key FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY session, key ORDER BY number) = 1 AS new FROM e),
c AS (SELECT session, number, count(*) FILTER (new) AS new_evidence, count(*) FILTER (NOT new) AS known_evidence FROM n GROUP BY ALL),
g AS (SELECT *, sum((new_evidence > 0)::INT) OVER (PARTITION BY session ORDER BY number) AS run FROM c)
SELECT session, number, new_evidence, known_evidence, sum((new_evidence = 0)::INT) OVER (PARTITION BY session, run ORDER BY number)::INT AS no_progress FROM g""",
    "backend_counters": """WITH c AS (SELECT user_id % 7 AS run, event_type AS backend, round(value) AS ms, json_extract_string(props, '$.k')::INT AS k, event_id % 2 = 0 AS hit FROM events),
t AS (SELECT run, count(*) AS operations, count(*) AS files_visited, sum(k)::BIGINT AS raw_hits, count(*) FILTER (hit) AS cache_hits FROM c GROUP BY 1)
SELECT t.run, operations, files_visited, raw_hits, cache_hits, backend, round(sum(ms), 3) AS ms FROM t JOIN c ON c.run = t.run GROUP BY ALL""",
    "project_status": """WITH s AS (SELECT r.name, length(name) % 5 AS n, length(name) % 7 <> 0 AND length(name) % 4 <> 0 AND source_sha <> '' AS fresh FROM repositories r)
SELECT count(*) AS repositories, count(*) FILTER (n = 1 OR n > 1 AND fresh) AS current, count(*) FILTER (n IN (0, 2) OR NOT fresh) AS warnings FROM s""",
    "index_freshness": "SELECT name, coalesce(length(name) % 7 <> 0 AND length(name) % 4 <> 0 AND source_sha <> '', false) AS fresh FROM repositories",
    "tree_signatures": f"""WITH {CORPUS}, t AS (SELECT repo, snapshot::INT AS snapshot, list_sort(list(coalesce(path, '?') || '|' || coalesce(blob, '?'))) AS tree FROM entries GROUP BY ALL)
SELECT repo, snapshot, min(snapshot) OVER (PARTITION BY repo, tree) AS same_as FROM t""",
    "repeated_plans": """SELECT user_id AS session, event_id AS number, min(event_id) OVER (PARTITION BY user_id, event_type, json_extract_string(props, '$.k') ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS repeats FROM events""",
    "pinned_rows": "SELECT repo, count(DISTINCT path) AS paths FROM files JOIN repositories ON name = repo AND length(name) % 5 = snapshot WHERE path IS NOT NULL GROUP BY 1",
    "missing_pins": "SELECT 'T' AS session, name AS repo, (length(name) % 5)::VARCHAR AS sha FROM repositories WHERE NOT EXISTS (SELECT 1 FROM files WHERE repo = name AND snapshot = length(name) % 5)",
    "session_coverage": rf"""WITH c AS (SELECT request_id, kind, regexp_matches(path, '{_TEST}') OR kind = 'test' AS t, lower(regexp_extract(string_split(path, '/')[-1], '.\.([^.]*)$', 1)) IN ('conf', 'gradle', 'json', 'properties', 'toml', 'xml', 'yaml', 'yml') AS c FROM raw_candidates WHERE path IS NOT NULL AND repo IS NOT NULL)
SELECT request_id, bool_or(NOT coalesce(t, false) AND NOT c) AS production_source, bool_or(coalesce(t, false)) AS tests, bool_or(c) AS configuration, bool_or(coalesce(kind = 'structural definition', false)) AS relationships, false AS git_history, bool_or(coalesce(kind = 'similar case', false)) AS similar_tickets FROM c GROUP BY 1""",
    "text_pieces": rf"""WITH RECURSIVE c AS (
  SELECT doc_id, 0 AS piece, {_HEAD.format(t="text")} AS head, text FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, piece + 1, {_HEAD.format(t="rest")}, rest FROM (SELECT doc_id, piece, substr(text, length(head) + 1) AS rest FROM c) WHERE rest <> '')
SELECT doc_id, piece::INT AS piece, length(head)::INT AS chars, md5(head) AS digest FROM c""",
    "new_repositories": """WITH n AS (SELECT DISTINCT repo FROM files WHERE repo IS NOT NULL AND NOT EXISTS (SELECT 1 FROM repositories WHERE name = repo AND length(name) % 2 = 0))
SELECT CASE WHEN EXISTS (SELECT 1 FROM repositories WHERE name = repo) THEN repo || '-2' ELSE repo END AS name, 'work/' || repo AS path FROM n""",
    "git_manifest": f"WITH {CORPUS} SELECT repo, path, blob FROM entries WHERE snapshot = (SELECT max(snapshot) FROM files) AND blob IS NOT NULL AND repo IS NOT NULL AND path IS NOT NULL AND length(path) % 11 <> 0",
    "fetchable_blobs": rf"""WITH {CORPUS} SELECT DISTINCT s.blob, strlen(content)::BIGINT AS size FROM stored s JOIN entries e ON e.blob = s.blob AND snapshot = (SELECT max(snapshot) FROM files) WHERE strlen(content) <= 2000 AND NOT regexp_matches(s.blob, '^[0-7]')
  AND NOT regexp_matches(path, '(^|/)(\.git|\.idea|\.venv|node_modules|target|build|dist)/') AND NOT regexp_matches(path, '(?i)(^|/)(\.env|\.envrc|credentials|credentials\.json|service-account\.json|id_rsa|id_ed25519|keystore)$|\.(key|pem|p12|pfx|jks)$')""",
    "payload_objects": """SELECT event_id, NULL::VARCHAR AS k, NULL::VARCHAR AS path, user_id::VARCHAR AS line FROM events
UNION ALL SELECT event_id, json_extract_string(props, '$.k'), NULL, NULL FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
UNION ALL SELECT event_id, props, '[no json', NULL FROM events WHERE props IS NOT NULL
UNION ALL SELECT event_id, value::VARCHAR, event_type, NULL FROM events WHERE value IS NOT NULL""",
    "project_facts": rf"""WITH {CORPUS},
f AS (SELECT repo, '- `' || path || ':' || line || '` — `' || trim(text) || '`' AS text, path, line FROM lines WHERE regexp_matches(text, '{L.FRAMEWORK}') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, line) <= 300),
deps AS (SELECT repo, unnest(regexp_extract_all(content, '(?s)<dependency>(.*?)</dependency>', 1)) AS d FROM corpus WHERE regexp_matches(path, '(^|/)pom\.xml$')),
m AS (SELECT DISTINCT repo, '- `' || CASE WHEN regexp_extract(d, '<groupId>\s*([^<\s]+)\s*</groupId>', 1) = '' THEN '?' ELSE regexp_extract(d, '<groupId>\s*([^<\s]+)\s*</groupId>', 1) END || ':' || regexp_extract(d, '<artifactId>\s*([^<\s]+)\s*</artifactId>', 1) || '`' AS text FROM deps WHERE regexp_extract(d, '<artifactId>\s*([^<\s]+)\s*</artifactId>', 1) <> ''),
l AS (SELECT name AS repo, 1 AS part, '' AS a, 0 AS b, '## ' || name AS text FROM repositories UNION ALL SELECT name, 2, '', 0, description FROM repositories WHERE description IS NOT NULL
  UNION ALL SELECT name, 3, '', 0, '### Framework facts' FROM repositories UNION ALL SELECT repo, 4, path, line, text FROM f WHERE repo IN (SELECT name FROM repositories) UNION ALL SELECT name, 4, '', 0, '- none' FROM repositories WHERE name NOT IN (SELECT repo FROM f)
  UNION ALL SELECT name, 5, '', 0, '### Dependencies' FROM repositories UNION ALL SELECT repo, 6, text, 0, text FROM m WHERE repo IN (SELECT name FROM repositories) UNION ALL SELECT name, 6, '', 0, '- none' FROM repositories WHERE name NOT IN (SELECT repo FROM m))
SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY part, a, b)::INT AS n, text FROM l""",
    "vector_conformance": """WITH e AS (SELECT label || ':' || (vec_id % 50) AS c, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, embedding[1]::DOUBLE AS a FROM embeddings),
n AS (SELECT c, vec_id % 7 = 0 AS off, list_sum(list_transform(v, lambda x: x * x)) AS q, a FROM e)
SELECT c AS "case", count(*) AS texts, bool_and(NOT off) AS parity, bool_and(abs(sqrt(q) - 1) <= 0.001) AS length, bool_and((q - 2 * a * a) / q >= 0.9) AS reference, true AS order_ok,
  bool_and(NOT off) AND bool_and(abs(sqrt(q) - 1) <= 0.001) AND bool_and((q - 2 * a * a) / q >= 0.9) AS passed FROM n GROUP BY 1""",
    "score_conformance": """WITH e AS (SELECT user_id || ':' || (event_id // 400) AS c, event_id, value FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY event_id) - 1 AS position, row_number() OVER (PARTITION BY c ORDER BY value DESC, event_id) AS n FROM e)
SELECT c AS "case", count(*) AS documents, bool_and(event_id % 29 <> 0) AS parity, true AS delta, bool_and(n > 1 OR position = 0) AS top_ok, bool_and(event_id % 29 <> 0) AND bool_and(n > 1 OR position = 0) AS passed FROM n GROUP BY 1""",
    "model_tuning": """WITH e AS (SELECT event_type AS pack, [1, 8, 16][event_id % 3 + 1] AS b, [10, 20, 40, 80][event_id % 4 + 1] AS p, round(value, 2)::DECIMAL(18, 2) AS ms, value FROM events WHERE value > 0),
r AS (SELECT pack, b, round(sum(b) * 1000 / sum(ms), 3) AS rate FROM e GROUP BY ALL),
q AS (SELECT pack, p, quantile_disc(value * p, 0.95) AS p95 FROM e GROUP BY ALL)
SELECT r.pack, max_by(b, (rate, b)) AS batch, (SELECT coalesce(max(CASE WHEN p95 <= 900 THEN p END), min(p)) FROM q WHERE q.pack = r.pack) AS pool FROM r GROUP BY r.pack""",
}
