"""The corpus store, relationships, history, chunks, vectors, measures, plans and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.functions import text as X
from siftmark.operators import corpus as C
from siftmark.operators import history as H
from siftmark.operators import lexical as L
from siftmark.operators import measure as M
from siftmark.operators import relations as R
from siftmark.operators import semantic as S
from siftmark.plans import request as P
from siftmark.queries.base import CORPUS, FUSED, regions, source, texts
from siftmark.runtime import cut, shared_folder, table
from siftmark.streaming import refresh as ST

PROPERTIES, YAML, POM, PACK = r"\.properties$", r"\.ya?ml$", r"(^|/)pom\.xml$", "keel-mini-64"
ASK = "The old ledger writer twice duplicated pending vouchers after the harbor migration, see OPS-203"


def blob_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return C.stored_blobs(table(spark, sf, "blobs")).select("blob", F.length("content").alias("chars"), F.sha2("content", 256).alias("digest"))


def missing_blobs(spark: SparkSession, sf: str) -> DataFrame:
    return C.missing_blobs(table(spark, sf, "files"), table(spark, sf, "blobs"))


def orphan_blobs(spark: SparkSession, sf: str) -> DataFrame:
    return C.orphan_blobs(table(spark, sf, "files"), table(spark, sf, "blobs"), [3, 4])


def changed_sources(spark: SparkSession, sf: str) -> DataFrame:
    return C.changed_repositories(table(spark, sf, "files"), 3, 4)


def storage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return C.storage(table(spark, sf, "files"), table(spark, sf, "blobs"))


def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return C.index_stats(table(spark, sf, "files"), table(spark, sf, "blobs"), 3, 4)


def keep_newest(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "files").groupBy("repo", "snapshot").agg(F.max("delivered_at").alias("at")).withColumn("pinned", F.col("snapshot") == 1)
    return C.keep_newest(rows, ["repo"], [F.col("at").desc(), F.col("snapshot").desc()], 2, "pinned").select("repo", "snapshot", "removable")


def lru_trim(spark: SparkSession, sf: str) -> DataFrame:
    return C.trim_cache(table(spark, sf, "embedding_cache"), "cache_key", "last_used_at", 100).select("cache_key")


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "chunks").select("chunk_id", "blob_sha", "start_line", "symbol").distinct()
    return rows.select("chunk_id", X.content_hash(F.col("blob_sha"), F.col("start_line"), F.col("symbol")).alias("hash"))


def config_values(spark: SparkSession, sf: str) -> DataFrame:
    return R.config_values(texts(spark, sf, PROPERTIES)).select("repo", "key", "value", "path", "line")


def yaml_values(spark: SparkSession, sf: str) -> DataFrame:
    return R.yaml_values(texts(spark, sf, YAML))


def all_settings(spark: SparkSession, sf: str) -> DataFrame:
    return R.settings(texts(spark, sf, f"{PROPERTIES}|{YAML}")).select("repo", "key", "value", "path", "line")


def config_resolve(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.config_values(texts(spark, sf, PROPERTIES))
    asked = rows.select("repo", F.col("key").alias("name"), F.concat(F.lit("${"), F.when(F.length("value") % 2 == 0, F.col("key")).otherwise(F.concat(F.lit("no."), F.col("key"), F.lit(":"), F.lit("fallback"))), F.lit("}")).alias("value"))
    return R.resolve(asked, rows.select("repo", "key", "value")).select("repo", "name", "value")


def kafka_producers(spark: SparkSession, sf: str) -> DataFrame:
    code = texts(spark, sf, rf"{PROPERTIES}|{YAML}|\.(java|kt|kts)$")
    return R.kafka_facts(code, R.settings(code)).select("repo", "kind", "key", "path", "line", "detail")


def maven_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return R.maven_facts(texts(spark, sf, POM)).select("repo", "kind", "key", "path")


def dependency_edges(spark: SparkSession, sf: str) -> DataFrame:
    facts = R.maven_facts(texts(spark, sf, POM)).where(F.col("kind") == "maven-consumer")
    names = table(spark, sf, "repositories").select(F.col("name").alias("target"))
    pairs = facts.join(names, X.service_name(F.element_at(F.split("key", ":"), -1)) == X.service_name(F.col("target"))).where(F.col("repo") != F.col("target"))
    return pairs.select(F.col("repo").alias("source"), "target", "key").distinct()


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    e = dependency_edges(spark, sf)
    return e.select("source", "target", F.lit("MAVEN").alias("kind"), "key", F.concat("source", F.lit(":pom.xml:1")).alias("source_evidence"), F.concat("target", F.lit(":pom.xml:1")).alias("target_evidence"), F.lit("high").alias("confidence"))


def relationship_slice(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "repositories").where(F.col("name").rlike("^[a-d]")).select(F.col("name").alias("repo"), F.lit("pom.xml").alias("path"))
    return R.relationship_slice(_edges(spark, sf), paths, ["ledger", "harbor"]).select("source", "target", "key", "score")


def workflow_paths(spark: SparkSession, sf: str) -> DataFrame:
    region, nation, supplier = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    a = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("r_name").alias("source"), F.col("n_name").alias("target"))
    b = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(F.col("n_name").alias("source"), F.col("s_name").alias("target"))
    return R.workflow_paths(a.unionByName(b)).select(F.array_join("path", ">").alias("path"))


def route_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "chunks").select("chunk_id", "path").distinct()
    return rows.select("chunk_id", X.route(F.concat(F.lit("//"), F.regexp_replace("path", "mod-(\\d+)", "{mod$1}"), F.lit("/"))).alias("route"))


def annotation_extract(spark: SparkSession, sf: str) -> DataFrame:
    t = texts(spark, sf).select("repo", "path", F.explode(F.regexp_extract_all("content", F.lit(r"@Value\s*\(([^()\n]*)\)"), F.lit(1))).alias("body"))
    return t.select("repo", "path", R.annotation_value(F.col("body")).alias("value")).distinct()


def workflow_chain(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    after = nation.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("next"))
    edges = nation.join(after, "n_nationkey")
    return R.workflow_paths(edges, "n_name", "next", F.concat(F.lit("--"), F.col("n_nationkey").cast("string"), F.lit("-->"))).select(F.array_join("path", " ").alias("path"))


def service_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "repositories").select("name", X.service_name(F.col("name")).alias("service"), X.safe_name(F.concat(F.lit(".x y/"), "name", F.lit("-"))).alias("safe"))


def ticket_extract_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", "source", F.explode(X.ticket_ids(F.col("text"))).alias("id"))
    return rows.groupBy("id").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_doc"))


def _commits(spark: SparkSession, sf: str) -> DataFrame:
    """Commit messages as raw logs in the layout of the version control, parsed again."""
    docs = table(spark, sf, "documents").where((F.col("source") == "commit-messages") & F.col("text").isNotNull())
    subject = F.substring_index(X.unified(F.col("text")), "\n", 1)
    names = F.concat(F.lit("M\tsrc/test/"), "doc_id", F.lit(".java\nR100\tconf/old.yaml\tconf/"), "doc_id", F.lit(".yaml\n"))
    record = F.concat(F.lit("\x1e"), F.col("doc_id").cast("string"), F.lit("\x1f"), F.date_format("created_at", "yyyy-MM-dd"), F.lit("\x1f"), subject, F.lit("\n"), names)
    logs = docs.groupBy(F.coalesce("repo", F.lit("none")).alias("repo"), F.pmod("doc_id", F.lit(16)).alias("part")).agg(F.array_join(F.collect_list(record), "").alias("text"))
    return H.parse_log(logs.select("repo", "text"))


def commit_log(spark: SparkSession, sf: str) -> DataFrame:
    return _commits(spark, sf).select("repo", "sha", "date", "subject", F.array_join("tickets", ",").alias("tickets"), F.to_json("changes").alias("changes"))


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "requests").groupBy("ticket").agg(F.min("objective").alias("ticket_text"))
    return H.cases(_commits(spark, sf), asked.withColumn("knowledge_text", F.lit(None).cast("string")))


def ticket_cases(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).select("ticket", "latest_date", F.array_join("repos", ",").alias("repos"), F.size("paths").alias("paths"), F.size("test_paths").alias("tests"), F.size("config_paths").alias("configs"), "commits", F.array_join("terms", " ").alias("terms"), F.length("ticket_excerpt").alias("told"))


def similar_cases(spark: SparkSession, sf: str) -> DataFrame:
    return H.similar_cases(_cases(spark, sf), ASK).select("ticket", "score")


def token_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "requests").select("request_id", F.array_join(X.terms(F.col("objective")), " ").alias("terms"))


def term_overlap_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return H.similar_by_terms(None, H.term_lists(table(spark, sf, "documents"), "doc_id", "text"), "asked", "doc_id", "text")


def redaction(spark: SparkSession, sf: str) -> DataFrame:
    return C.stored_blobs(table(spark, sf, "blobs")).select("blob", F.md5(H.redacted(F.col("content"))).alias("digest"))


def pickaxe_history(spark: SparkSession, sf: str) -> DataFrame:
    diffs = H.snapshot_diffs(table(spark, sf, "files"), table(spark, sf, "blobs"), [(1, 2), (2, 3), (3, 4)])
    return H.pickaxe(diffs, "this.").select("repo", "sha", "date", "path", "how")


def chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    return S.chunk_source(C.stored_blobs(table(spark, sf, "blobs")))


def chunk_cards(spark: SparkSession, sf: str) -> DataFrame:
    blobs = C.stored_blobs(table(spark, sf, "blobs"))
    cards = S.cards(S.with_code(S.chunk_source(blobs), blobs).withColumn("repo", F.lit("r")).withColumn("path", F.concat("blob", F.lit(".kt"))))
    return cards.select("chunk_id", "blob", "start_line", "end_line", "symbol", F.md5("card").alias("card"))


def _asked_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and every hundredth as a query."""
    vectors = table(spark, sf, "embeddings")
    return vectors, vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return S.vector_top(*_asked_vectors(spark, sf))


def vector_topk_per_label(spark: SparkSession, sf: str) -> DataFrame:
    return S.vector_top(*_asked_vectors(spark, sf), 5, group="label")


def hashed_embedding(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.embed(table(spark, sf, "requests").select("request_id", "objective"), "objective")
    return rows.select("request_id", F.posexplode("vector").alias("place", "value")).where(F.col("value") != 0)


def _cached(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All keys of a pack and all chunks, with what the cache has; and the cache."""
    cache = table(spark, sf, "embedding_cache")
    keys = cache.where((F.col("pack_id") == PACK) & (F.col("dimension") == 64) & F.col("cache_key").isNotNull()).select("cache_key").distinct().withColumn("card", F.lit(None).cast("string"))
    chunks = table(spark, sf, "chunks").where(F.col("chunk_id").isNotNull()).groupBy(F.col("chunk_id").alias("cache_key")).agg(F.min("card").alias("card"))
    return S.with_cached(keys.unionByName(chunks), S.cached_vectors(cache, PACK, 64), "cache_key", "card"), cache


def cached_embedding(spark: SparkSession, sf: str) -> DataFrame:
    rows = _cached(spark, sf)[0]
    return rows.select("cache_key", "from_cache", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"), F.get("vector", F.lit(3)).alias("fourth"))


def cache_after_use(spark: SparkSession, sf: str) -> DataFrame:
    used, cache = _cached(spark, sf)
    return S.refreshed_cache(cache, used, PACK, 64, F.lit("2030-01-01 00:00:00").cast("timestamp"), 700).select("cache_key", "pack_id", F.date_format("last_used_at", "yyyy-MM-dd").alias("day"))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return M.percentiles(table(spark, sf, "events"), "event_type", "value")


def latest_per_event(spark: SparkSession, sf: str) -> DataFrame:
    return M.latest(table(spark, sf, "events").select("event_type", "ts", "event_id", "value"), "event_type", ["ts", "event_id"]).select("event_type", "event_id", "value")


def payload_timings(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.timings(table(spark, sf, "events").select(F.col("event_type").alias("event"), "props"), "props", "k")
    return M.percentiles(rows.withColumn("name", F.concat_ws(".", "event", "metric")), "name", "value")


def _evaluation(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "raw_candidates").where(F.col("score").isNotNull() & ~F.isnan("score")).select(F.col("request_id").alias("case"), F.concat_ws(":", "repo", "path").alias("item"), "kind", "score", "line")
    best = rows.where(F.col("kind") == "code").groupBy("case", "item", "line").agg(F.max("score").alias("score"))
    from pyspark.sql import Window

    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy(F.col("score").desc(), "item", "line"))).select("case", "item", "rank")
    return ranked, rows.where(F.col("kind") == "semantic").select("case", "item")


def case_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg", "precision")]
    return M.case_metrics(*_evaluation(spark, sf), 10).select("case", "expected", "returned", "found", *rounded)


def macro_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = M.case_metrics(*_evaluation(spark, sf), 10)
    columns = ["recall", "reciprocal_rank", "ndcg", "precision"]
    return M.macro(m, columns).withColumn("nulls", F.lit("skipped")).unionByName(M.macro(m, columns, True).withColumn("nulls", F.lit("zero")))


def micro_recall(spark: SparkSession, sf: str) -> DataFrame:
    return M.micro_recall(M.case_metrics(*_evaluation(spark, sf), 10))


def duplicate_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return M.duplicate_ratio(_evaluation(spark, sf)[0])


def _rounds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_id", "event_type", (F.col("value") * 0 + F.when(F.col("event_type") == "purchase", 1).otherwise(0)).cast("int").alias("new"))


def session_progress(spark: SparkSession, sf: str) -> DataFrame:
    return M.progress(_rounds(spark, sf), "user_id", "event_id", "new").select("user_id", "event_id", "no_progress")


def first_seen_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return M.first_seen(_rounds(spark, sf), "user_id", "event_type", ["event_id"]).select("user_id", "event_id", "is_new")


def cumulative_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rounds(spark, sf).withColumn("bought", F.col("event_type") == "purchase").withColumn("failed", F.col("event_type") == "error")
    return M.cumulative_or(rows, "user_id", "event_id", ["bought", "failed"]).select("user_id", "event_id", "bought", "failed")


def coverage_flags(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return M.coverage(table(spark, sf, "raw_candidates"), ["request_id"], p, X.is_test(p), X.is_config(p))


def reply_classify(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", M.reply_kind(F.coalesce("text", F.lit(""))).alias("kind"))


REQUEST = """Some words before.
CONTEXT_REQUEST:
  version: 2
  objective: Find who forgets vouchers
  searches:
    - query: requireNonNull
      repos: [tide-ledger, harbor-core]
    - query: logger.(debug|info)
  paths:
    - query: ledger
  symbols:
    - name: Keel.compactHeader
      include: [definition, callers, callees]
  files:
    - repo: harbor-core
      path: platform/shared/src/main/java/dev/keelworks/Anchors.java
      lines: 5-30
  history:
    - query: OPS-203
"""


def plan_explain(spark: SparkSession, sf: str) -> DataFrame:
    return P.explain(spark, P.compile_plan(P.parse_request(REQUEST))).select("step", "tier", "cost", "kind", "value", F.array_join("repos", ",").alias("repos"))


def _retrieved(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return P.Engine(table(spark, sf, "files"), table(spark, sf, "blobs")).retrieve(P.parse_request(REQUEST))


def retrieve_context(spark: SparkSession, sf: str) -> DataFrame:
    evidence = _retrieved(spark, sf)["evidence"]
    return evidence.select("repo", "path", "line_start", "line_end", "kind", "score", F.array_join("found_by", ",").alias("channels"), F.md5("content").alias("content"))


def retrieve_calls(spark: SparkSession, sf: str) -> DataFrame:
    parts = _retrieved(spark, sf)
    return parts["calls"].select(F.lit("call").alias("part"), F.concat_ws(" ", "symbol", "callee").alias("name")).unionByName(parts["unresolved"].select(F.lit("unresolved").alias("part"), F.col("asked").alias("name")))


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, be it a folder of files or one file among others."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def stream_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """The changes that the stream has written, in their final state; read back before its folders are removed."""
    with shared_folder(spark, "refresh") as root:
        ST.refresh(_stream(spark, sf, "files"), f"{root}/out", f"{root}/state").awaitTermination()
        return cut(spark.read.parquet(f"{root}/out").select("snapshot", "repo", "path", "blob"))


def stream_windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    with shared_folder(spark, "windows") as root:
        # one batch holds the whole table, so no row is late; windows of over two days ago are given out and forgotten
        query = ST.windowed_counts(rows, "ts", "event_type").writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{root}/out/batch={n}"))
        query.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
        out = spark.read.parquet(f"{root}/out")
        return cut(out.groupBy(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type").agg(F.max("n").alias("n")))


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds of every user as a stream: the plan is the type of event and its hundred, the evidence its key."""
    rows = _stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("ticket"), F.col("event_id").cast("int").alias("number"), F.concat_ws(":", "event_type", (F.col("event_id") % 3).cast("string")).alias("signature"), F.array("event_type").alias("evidence"))
    with shared_folder(spark, "sessions") as root:
        query = ST.session_rounds(rows).writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
        query.trigger(availableNow=True).start().awaitTermination()
        return cut(spark.read.parquet(f"{root}/out").select("ticket", "number", "new_evidence", "no_progress", "duplicate"))


QUERIES = {
    f.__name__: f
    for f in (
        all_settings, index_stats, workflow_chain, commit_log, cache_after_use, stream_sessions, retrieve_calls, blob_dedup, missing_blobs, orphan_blobs, changed_sources, storage_totals, keep_newest, lru_trim, content_hash, config_values, yaml_values, config_resolve, kafka_producers, maven_dependencies,
        dependency_edges, relationship_slice, workflow_paths, route_normalize, annotation_extract, service_names, ticket_extract_group, ticket_cases, similar_cases, token_terms, term_overlap_similarity, redaction,
        pickaxe_history, chunk_lines, chunk_cards, vector_topk, vector_topk_per_label, hashed_embedding, cached_embedding, latency_percentiles, latest_per_event, payload_timings, case_metrics, macro_metrics, micro_recall,
        duplicate_ratio, session_progress, first_seen_evidence, cumulative_coverage, coverage_flags, reply_classify, plan_explain, retrieve_context, stream_refresh, stream_windowed_counts,
    )
}

_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


def _terms(text: str) -> str:
    spread = rf"regexp_replace({text}, '([a-z0-9])([A-Z])', '\1 \2', 'g')"
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({spread}, '[A-Za-z][A-Za-z0-9]{{2,}}'), lambda x: lower(x)), lambda x: NOT list_contains({_STOP}, x))))"


# what stands between two ids is doubled, since this dialect cannot look around
_TICKETS = "list_distinct(regexp_extract_all(regexp_replace({t}, '([^A-Z0-9-])', '\\1\\1', 'g'), '(^|[^A-Z0-9])([A-Z][A-Z0-9]+-[0-9]+)([^A-Z0-9]|$)', 2))"
_MARKS = chr(39) + chr(34) + chr(39) * 3  # both kinds of quotes as a text of SQL
_SQL = lambda pattern: pattern.replace("'", "''")
_PROPS = rf"""{CORPUS},
props0 AS (SELECT repo, path, line, regexp_extract(text, '{_SQL(R.PROPERTY)}', 1) AS key, regexp_replace(regexp_extract(text, '{_SQL(R.PROPERTY)}', 2), '^["'']+|["'']+$', '', 'g') AS value
  FROM lines WHERE path LIKE '%.properties' AND regexp_matches(text, '{_SQL(R.PROPERTY)}')),
props AS (SELECT repo, key, value, path, line FROM props0 QUALIFY row_number() OVER (PARTITION BY repo, key ORDER BY path DESC, line DESC, value DESC) = 1)"""
# the level above an entry: the last line without a value that is less indented, with no entry of its depth or less between
_YAML = rf"""{_PROPS},
y AS MATERIALIZED (SELECT repo, path, line, length(regexp_extract(text, '{R.YAML_ENTRY}', 1)) AS d, regexp_extract(text, '{R.YAML_ENTRY}', 2) AS k, trim(regexp_extract(text, '{R.YAML_ENTRY}', 3), {_MARKS}) AS v
  FROM lines WHERE regexp_matches(path, '\.ya?ml$') AND regexp_matches(text, '{R.YAML_ENTRY}') AND ltrim(text) NOT LIKE '#%'),
up AS MATERIALIZED (SELECT a.repo, a.path, a.line, max(b.line) AS above FROM y a LEFT JOIN y b ON a.repo = b.repo AND a.path = b.path AND b.line < a.line AND b.v = '' AND b.d < a.d
  AND NOT EXISTS (SELECT 1 FROM y c WHERE c.repo = a.repo AND c.path = a.path AND c.line > b.line AND c.line < a.line AND c.d <= b.d) GROUP BY ALL),
full_key AS (SELECT y.repo, y.path, y.line, y.k AS key, above FROM y JOIN up USING (repo, path, line)
  UNION ALL SELECT f.repo, f.path, f.line, y.k || '.' || f.key, up.above FROM full_key f JOIN y ON y.repo = f.repo AND y.path = f.path AND y.line = f.above JOIN up ON up.repo = y.repo AND up.path = y.path AND up.line = y.line),
yaml AS (SELECT repo, key, v AS value, path, line FROM full_key JOIN y USING (repo, path, line) WHERE above IS NULL AND v <> ''),
settings AS (SELECT repo, key, value, path, line FROM (SELECT repo, key, value, path, line FROM props0 UNION ALL SELECT * FROM yaml) QUALIFY row_number() OVER (PARTITION BY repo, key ORDER BY path DESC, line DESC, value DESC) = 1)"""
_RESOLVED = "CASE WHEN NOT regexp_matches({v}, '^\\s*\\$\\{{[^}}:]+(?::[^}}]*)?\\}}\\s*$') THEN {v} ELSE coalesce((SELECT value FROM settings s WHERE s.repo = {t}.repo AND s.key = regexp_extract({v}, '^\\s*\\$\\{{([^}}:]+)', 1)), nullif(regexp_extract({v}, '^\\s*\\$\\{{[^}}:]+:([^}}]*)\\}}', 1), ''), {v}) END"
_CONST = rf"""
const0 AS (SELECT repo, path, 0 AS n, unnest(regexp_extract_all(content, '{_SQL(R.CONSTANT)}', 1)) AS name, unnest(regexp_extract_all(content, '{_SQL(R.CONSTANT)}', 2)) AS value FROM corpus WHERE regexp_matches(path, '\.(java|kt|kts)$')
  UNION ALL SELECT repo, path, 1, unnest(regexp_extract_all(content, '{_SQL(R.INJECTED)}', 2)), unnest(regexp_extract_all(content, '{_SQL(R.INJECTED)}', 1)) FROM corpus WHERE regexp_matches(path, '\.(java|kt|kts)$')),
const AS (SELECT repo, path, name, value FROM (SELECT repo, path, n, name, {_RESOLVED.format(v="const0.value", t="const0")} AS value FROM const0) QUALIFY row_number() OVER (PARTITION BY repo, path, name ORDER BY n DESC, value DESC) = 1)"""
_MAVEN = rf"""{CORPUS},
deps AS (SELECT repo, path, unnest(regexp_extract_all(content, '(?s)<dependency>(.*?)</dependency>', 1)) AS d FROM corpus WHERE regexp_matches(path, '(^|/)pom\.xml$')),
d2 AS (SELECT repo, path, regexp_extract(d, '<groupId>\s*([^<\s]+)\s*</groupId>', 1) AS g, regexp_extract(d, '<artifactId>\s*([^<\s]+)\s*</artifactId>', 1) AS a FROM deps),
facts AS (SELECT DISTINCT repo, 'maven-consumer' AS kind, (CASE WHEN g = '' THEN '?' ELSE g END) || ':' || a AS key, path, a FROM d2 WHERE a <> '')"""
_SERVICE = "regexp_replace(regexp_replace(lower({n}), '[^a-z0-9]', '', 'g'), 'service$', '')"
_EDGES = f"""{_MAVEN}, edges AS (SELECT DISTINCT repo AS source, name AS target, key FROM facts JOIN repositories ON {_SERVICE.format(n="a")} = {_SERVICE.format(n="name")} WHERE repo <> name)"""
def _redact(text: str) -> str:
    """The chain of replacements as nested calls; the last pattern's flags differ in this dialect."""
    for pattern, mark in H.REDACTION:
        pattern = pattern.replace("(?imd)", "(?im)").replace("(?d)", "")
        mark = mark.replace("$1", "\\1")
        text = f"regexp_replace({text}, '{pattern}', '{mark}', 'g')"
    return text


_CASES = f"""
docs0 AS (SELECT coalesce(repo, 'none') AS repo, doc_id, strftime(created_at, '%Y-%m-%d') AS date, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))[1] AS first FROM documents WHERE source = 'commit-messages' AND text IS NOT NULL),
docs AS (SELECT repo, doc_id, date, {_redact("first")} AS subject FROM docs0),
ex AS (SELECT repo, doc_id, date, subject, unnest({_TICKETS.format(t="subject")}) AS ticket FROM docs),
asked AS (SELECT ticket, min(objective) AS told FROM requests GROUP BY 1),
cases0 AS (SELECT ticket, max(date) AS latest_date, array_to_string(list_sort(list(DISTINCT repo)), ',') AS repos, (count(DISTINCT doc_id) * 2)::INT AS paths, count(DISTINCT doc_id)::INT AS tests, count(DISTINCT doc_id)::INT AS configs, count(*) AS commits,
  array_to_string(list_sort(list(DISTINCT subject)), ' ') || ' ' || string_agg(repo || ':src/test/' || doc_id || '.java ' || repo || ':conf/' || doc_id || '.yaml', ' ') AS words FROM ex GROUP BY ticket),
cases AS (SELECT c.*, {_terms("(words || ' ' || coalesce(told, ''))")} AS terms, length({_redact("coalesce(told, '')")})::INT AS told FROM cases0 c LEFT JOIN asked USING (ticket))"""
# a marker begins with the blank lines right above it: line numbers minus those of the run of blank lines before
_CHUNKS = rf"""{CORPUS},
q0 AS (SELECT blob, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) AS p FROM stored),
q AS (SELECT blob, CASE WHEN p[len(p)] = '' THEN list_slice(p, 1, len(p) - 1) ELSE p END AS p FROM q0),
l AS (SELECT blob, len(p) AS n, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS text FROM q WHERE len(p) > 0),
b AS (SELECT *, max(CASE WHEN regexp_matches(text, '\S') THEN line ELSE 0 END) OVER (PARTITION BY blob ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM l),
k AS (SELECT blob, n, coalesce(last, 0) + 1 AS s, regexp_extract(text, '^\s*{S.MARKER}', 1) AS symbol FROM b WHERE regexp_matches(text, '^\s*{S.MARKER}')),
r AS (SELECT blob, s, coalesce(lead(s) OVER (PARTITION BY blob ORDER BY s) - 1, n) AS e, symbol FROM k
  UNION ALL SELECT blob, 1, len(p), 'file' FROM q WHERE blob NOT IN (SELECT blob FROM k)),
c0 AS (SELECT blob, unnest(range(s, greatest(s, e) + 1, 80)) AS f, e, symbol FROM r),
c AS (SELECT blob, f::INT AS start_line, least(f + 79, e)::INT AS end_line, CASE WHEN symbol = 'file' THEN 'file' ELSE 'symbol' END AS kind, symbol FROM c0)"""
_COS = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_VECTORS = f"""q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL),
v AS (SELECT query_id, vec_id, label, round(50 + 50 * {_COS.format(a="embedding", b="q")} / (sqrt({_COS.format(a="embedding", b="embedding")}) * sqrt({_COS.format(a="q", b="q")})), 3) AS score FROM embeddings, q WHERE embedding IS NOT NULL)"""
_HASHED = r"""
w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS word FROM t),
h AS (SELECT id, sha256(word) AS h FROM w),
m AS (SELECT id, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS place, CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS sign FROM h),
p AS (SELECT id, place, sum(sign) AS s FROM m GROUP BY ALL),
vec AS (SELECT id, place, round(s / sqrt(sum(s * s) OVER (PARTITION BY id)), 7) AS value FROM p)"""
_CACHED = f"""
last AS (SELECT cache_key, vector_json FROM embedding_cache WHERE pack_id = '{PACK}' AND dimension = 64 AND cache_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY last_used_at DESC NULLS LAST, created_at DESC NULLS LAST, vector_json DESC NULLS LAST) = 1),
hit AS (SELECT cache_key, TRY_CAST(vector_json AS DOUBLE[]) AS v FROM last WHERE len(TRY_CAST(vector_json AS DOUBLE[])) = 64 AND len(list_filter(TRY_CAST(vector_json AS DOUBLE[]), lambda x: isfinite(x))) = 64),
t AS (SELECT cache_key AS id, NULL::VARCHAR AS text FROM last WHERE cache_key NOT IN (SELECT cache_key FROM hit) UNION ALL SELECT chunk_id, min(card) FROM chunks WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT cache_key FROM hit) GROUP BY 1)"""
_EVAL = """
rows AS (SELECT request_id AS "case", repo || ':' || path AS item, kind, score, line FROM raw_candidates WHERE score IS NOT NULL AND NOT isnan(score)),
b AS (SELECT "case", item, line, max(score) AS score FROM rows WHERE kind = 'code' GROUP BY ALL),
ranked AS (SELECT "case", item, row_number() OVER (PARTITION BY "case" ORDER BY score DESC, item, line) AS rank FROM b),
firsts AS (SELECT "case", item, min(rank) AS rank FROM ranked GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY rank, item) AS place FROM firsts QUALIFY place <= 10),
want AS (SELECT DISTINCT "case", item FROM rows WHERE kind = 'semantic'),
need AS (SELECT "case", count(*) AS expected FROM want GROUP BY 1),
got AS (SELECT top."case" AS "case", count(*) AS returned, count(want.item) AS found, min(CASE WHEN want.item IS NOT NULL THEN place END) AS best,
  sum(CASE WHEN want.item IS NOT NULL THEN 1 / log2(place + 1) ELSE 0 END) AS dcg FROM top LEFT JOIN want ON top."case" = want."case" AND top.item = want.item GROUP BY 1),
m AS (SELECT need."case" AS "case", expected, coalesce(returned, 0) AS returned, coalesce(found, 0) AS found, coalesce(found, 0) / expected AS recall, coalesce(1 / best, 0.0) AS reciprocal_rank,
  coalesce(dcg, 0.0) / list_sum(list_transform(range(1, least(expected, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, CASE WHEN returned > 0 THEN found / returned END AS precision
  FROM need LEFT JOIN got ON need."case" = got."case")"""

_FIRST = "QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, line) <= 100"
_OF = lambda form: form.replace("{name}", "compactHeader")
_RETRIEVED = rf"""{CORPUS},
s1 AS (SELECT repo, path, line, text, 'code' AS kind, 95.0 AS score, ['fts'] AS found_by FROM lines WHERE contains(text, 'requireNonNull') AND repo IN ('tide-ledger', 'harbor-core') {_FIRST}),
s2l AS (SELECT repo, path, line, text, 'code' AS kind, 95.0 AS score, ['fts'] AS found_by FROM lines WHERE contains(text, 'logger.(debug|info)') {_FIRST}),
s2 AS (SELECT * FROM s2l UNION ALL SELECT * FROM (SELECT repo, path, line, text, 'code', 80.0, ['regex'] FROM lines WHERE regexp_matches(text, 'logger.(debug|info)') {_FIRST}) WHERE NOT EXISTS (SELECT 1 FROM s2l)),
p0 AS (SELECT DISTINCT repo, path, CASE WHEN lower(path) = 'ledger' OR lower(string_split(path, '/')[-1]) = 'ledger' OR regexp_replace(lower(string_split(path, '/')[-1]), '(.)\.[^.]*$', '\1') = 'ledger' THEN 100.0 ELSE 95.0 END AS score FROM corpus WHERE contains(lower(path), 'ledger')),
p1 AS (SELECT repo, path, 1 AS line, path AS text, 'verified path' AS kind, score, ['path'] AS found_by FROM p0 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY score DESC, length(path), path) <= 12),
d0 AS (SELECT repo, path, line, text, 'definition' AS kind, 100.0 AS score, ['symbol'] AS found_by FROM lines WHERE contains(text, 'compactHeader') AND regexp_matches(text, '{_OF(L.DECLARATION)}') {_FIRST}),
d1 AS (SELECT * FROM d0 UNION ALL SELECT * FROM (SELECT repo, path, line, text, 'symbol reference', 60.0, ['symbol'] FROM lines WHERE regexp_matches(text, '\bcompactHeader\b') {_FIRST}) WHERE NOT EXISTS (SELECT 1 FROM d0)),
traced AS (SELECT repo, path, line, text, CASE WHEN regexp_matches(text, '{_OF(L.DEFINED)}') THEN 'definition' ELSE 'caller' END AS kind, CASE WHEN regexp_matches(text, '{_OF(L.DEFINED)}') THEN 100.0 ELSE 96.0 END AS score, ['trace'] AS found_by
  FROM (SELECT * FROM lines WHERE regexp_matches(text, '\bcompactHeader\s*\(') {_FIRST})),
cnt AS (SELECT e.*, coalesce((length(content) - length(replace(content, 'OPS-203', ''))) // 7, 0) AS n FROM entries e LEFT JOIN stored USING (blob) WHERE blob IS NOT NULL),
was AS (SELECT *, lag(n) OVER (PARTITION BY repo, path ORDER BY snapshot) AS was FROM cnt),
chg AS (SELECT repo, path, max(snapshot) AS changed FROM was WHERE was IS NOT NULL AND n <> was GROUP BY ALL),
few AS (SELECT c.repo, c.path FROM chg c JOIN corpus USING (repo, path) ORDER BY changed DESC, c.repo, c.path LIMIT 20),
hist AS (SELECT few.repo, few.path, coalesce(min(l.line), 1)::INT AS line, coalesce(arg_min(l.text, l.line), '') AS text, 'history' AS kind, 50.0 AS score, ['history'] AS found_by FROM few LEFT JOIN lines l ON l.repo = few.repo AND l.path = few.path AND contains(l.text, 'OPS-203') GROUP BY ALL),
hits AS (SELECT repo, path, line, text, kind, score::DOUBLE AS score, found_by FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM traced UNION ALL SELECT * FROM hist)),{FUSED}"""

ORACLE = {
    "blob_dedup": f"WITH {CORPUS} SELECT blob, length(content)::INT AS chars, sha256(content) AS digest FROM stored",
    "missing_blobs": f"WITH {CORPUS} SELECT DISTINCT blob FROM entries WHERE snapshot = 4 AND blob IS NOT NULL AND blob NOT IN (SELECT blob FROM stored)",
    "orphan_blobs": f"WITH {CORPUS} SELECT DISTINCT lower(blob) AS blob FROM blobs WHERE blob IS NOT NULL AND lower(blob) NOT IN (SELECT blob FROM entries WHERE snapshot IN (3, 4) AND blob IS NOT NULL)",
    "changed_sources": f"""WITH {CORPUS}, d AS (SELECT coalesce(a.repo, b.repo) AS repo, a.path IS NULL OR b.path IS NULL OR a.blob IS DISTINCT FROM b.blob AS diff
  FROM (SELECT * FROM entries WHERE snapshot = 3) a FULL JOIN (SELECT * FROM entries WHERE snapshot = 4) b ON a.repo = b.repo AND a.path = b.path)
SELECT repo, bool_or(diff) AS changed FROM d GROUP BY 1""",
    "storage_totals": f"""WITH {CORPUS}, e AS (SELECT e.repo, e.path, e.blob, strlen(s.content) AS bytes FROM entries e LEFT JOIN stored s USING (blob) WHERE snapshot = 4 AND blob IS NOT NULL),
h AS (SELECT repo, count(*) AS blobs, sum(bytes)::BIGINT AS bytes FROM (SELECT DISTINCT repo, blob, bytes FROM e WHERE bytes IS NOT NULL) GROUP BY 1)
SELECT n.repo, files, coalesce(blobs, 0) AS blobs, coalesce(bytes, 0)::BIGINT AS bytes FROM (SELECT repo, count(*) AS files FROM e GROUP BY 1) n LEFT JOIN h ON n.repo = h.repo""",
    "index_stats": f"""WITH {CORPUS}, n AS (SELECT repo, path, blob FROM entries WHERE snapshot = 4 AND blob IS NOT NULL), o AS (SELECT DISTINCT repo, blob FROM entries WHERE snapshot = 3 AND blob IS NOT NULL),
d AS (SELECT repo, blob FROM n EXCEPT SELECT repo, blob FROM o), c AS (SELECT repo, count(*) AS k, sum(strlen(content))::BIGINT AS b FROM d JOIN stored USING (blob) GROUP BY 1)
SELECT t.repo, files, coalesce(k, 0) AS changed_blobs, coalesce(b, 0)::BIGINT AS bytes FROM (SELECT repo, count(*) AS files FROM n GROUP BY 1) t LEFT JOIN c ON c.repo = t.repo""",
    "keep_newest": """WITH r AS (SELECT repo, snapshot, max(delivered_at) AS d FROM files GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY repo, snapshot = 1 ORDER BY d DESC, snapshot DESC) AS n FROM r)
SELECT repo, snapshot, snapshot <> 1 AND n > 2 AS removable FROM k""",
    "lru_trim": "SELECT cache_key FROM (SELECT cache_key, max(last_used_at) AS u FROM embedding_cache GROUP BY 1) ORDER BY u DESC NULLS LAST, cache_key LIMIT 100",
    "content_hash": r"""SELECT chunk_id, sha256(coalesce(blob_sha, chr(1) || 'null') || chr(0) || coalesce(start_line::VARCHAR, chr(1) || 'null') || chr(0) || coalesce(symbol, chr(1) || 'null')) AS hash
FROM (SELECT DISTINCT chunk_id, blob_sha, start_line, symbol FROM chunks)""",
    "config_values": f"WITH {_PROPS} SELECT repo, key, value, path, line FROM props",
    "config_resolve": f"""WITH {_PROPS} SELECT repo, key AS name, CASE WHEN length(value) % 2 = 0 THEN value ELSE 'fallback' END AS value FROM props""",
    "yaml_values": f"WITH RECURSIVE {_YAML} SELECT * FROM yaml",
    "all_settings": f"WITH RECURSIVE {_YAML} SELECT * FROM settings",
    "kafka_producers": rf"""WITH RECURSIVE {_YAML}, {_CONST},
sends AS (SELECT repo, path, line, regexp_replace(unnest(regexp_extract_all(text, '{_SQL(R.SENDERS["KafkaTemplate.send"])}')), '(?s)^[^(]*\(\s*', '') AS raw, 'KafkaTemplate.send' AS detail FROM lines WHERE regexp_matches(path, '\.(java|kt|kts)$')
  UNION ALL SELECT repo, path, line, regexp_replace(unnest(regexp_extract_all(text, '{_SQL(R.SENDERS["StreamBridge.send"])}')), '(?s)^[^(]*\(\s*', ''), 'StreamBridge.send' FROM lines WHERE regexp_matches(path, '\.(java|kt|kts)$')),
named AS (SELECT s.repo, s.path, s.line, s.detail, coalesce(c.value, trim(raw, {_MARKS})) AS k FROM sends s LEFT JOIN const c ON c.repo = s.repo AND c.path = s.path AND c.name = trim(raw, {_MARKS})),
f AS (SELECT DISTINCT repo, path, line, detail, {_RESOLVED.format(v="named.k", t="named")} AS key FROM named)
SELECT repo, 'kafka-producer' AS kind, key, path, line, detail FROM f WHERE key <> '' AND key NOT LIKE '${{%'""",
    "maven_dependencies": f"WITH {_MAVEN} SELECT repo, kind, key, path FROM facts",
    "dependency_edges": f"WITH {_EDGES} SELECT source, target, key FROM edges",
    "relationship_slice": f"""WITH {_EDGES}, s AS (SELECT *, 100 * (regexp_matches(source, '^[a-d]') OR regexp_matches(target, '^[a-d]'))::INT
  + 10 * (contains(lower(source || ' ' || target || ' MAVEN ' || key), 'ledger')::INT + contains(lower(source || ' ' || target || ' MAVEN ' || key), 'harbor')::INT) AS score FROM edges)
SELECT source, target, key, score FROM s WHERE score > 0 ORDER BY score DESC, source, target, key LIMIT 12""",
    "workflow_paths": """WITH RECURSIVE e AS (SELECT r_name AS s, n_name AS t FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
w AS (SELECT [s, t] AS p, t AS last FROM e UNION ALL SELECT list_append(w.p, e.t), e.t FROM w JOIN e ON w.last = e.s WHERE NOT list_contains(w.p, e.t))
SELECT DISTINCT array_to_string(p, '>') AS path FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.s = w.last AND NOT list_contains(w.p, e.t))""",
    "workflow_chain": """WITH RECURSIVE n AS (SELECT n_nationkey AS k, n_name AS name FROM nation), e AS (SELECT a.k, a.name AS s, b.name AS t FROM n a JOIN n b ON b.k = a.k + 1),
w AS (SELECT s || ' --' || k || '--> ' || t AS p, k FROM e UNION ALL SELECT p || ' --' || e.k || '--> ' || e.t, e.k FROM w JOIN e ON e.k = w.k + 1)
SELECT p AS path FROM w WHERE k = (SELECT max(k) FROM e)""",
    "route_normalize": r"""WITH r AS (SELECT DISTINCT chunk_id, '///' || regexp_replace(path, 'mod-(\d+)', '{mod\1}', 'g') || '/' AS r FROM chunks)
SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(r, '\{[^}]*\}', '{}', 'g'), '/+', '/', 'g'), '/$', '') AS route FROM r""",
    "annotation_extract": rf"""WITH {CORPUS}, a AS (SELECT repo, path, unnest(regexp_extract_all(content, '@Value\s*\(([^()\n]*)\)', 1)) AS body FROM corpus)
SELECT DISTINCT repo, path, CASE WHEN regexp_matches(body, '\bvalue\s*=\s*["'']([^"'']*)["'']') THEN regexp_extract(body, '\bvalue\s*=\s*["'']([^"'']*)["'']', 1) ELSE regexp_extract(body, '["'']([^"'']*)["'']', 1) END AS value FROM a""",
    "service_names": f"SELECT name, {_SERVICE.format(n='name')} AS service, 'x-y-' || name AS safe FROM repositories",
    "ticket_extract_group": f"""WITH t AS (SELECT doc_id, source, unnest({_TICKETS.format(t="text")}) AS id FROM documents WHERE text IS NOT NULL)
SELECT id, count(*) AS documents, count(DISTINCT source) AS sources, min(doc_id) AS first_doc FROM t GROUP BY 1""",
    "ticket_cases": f"WITH {_CASES} SELECT ticket, latest_date, repos, paths, tests, configs, commits, array_to_string(terms, ' ') AS terms, told FROM cases",
    "commit_log": f"""WITH {_CASES}, t AS (SELECT repo, doc_id, date, subject, list_sort({_TICKETS.format(t="subject")}) AS tickets FROM docs)
SELECT repo, doc_id::VARCHAR AS sha, date, subject, array_to_string(tickets, ',') AS tickets, '[{{"status":"M","path":"src/test/' || doc_id || '.java"}},{{"status":"R100","path":"conf/' || doc_id || '.yaml"}}]' AS changes FROM t WHERE len(tickets) > 0""",
    "similar_cases": f"""WITH {_CASES}, q AS (SELECT {_terms(f"'{ASK}'")} AS q),
s AS (SELECT ticket, latest_date, (CASE WHEN ticket = 'OPS-203' THEN 1000 ELSE 0 END + coalesce(list_sum(list_transform(list_intersect(terms, q), lambda t: least(12, length(t)))), 0))::INT AS score FROM cases, q)
SELECT ticket, score FROM s WHERE score > 0 ORDER BY score DESC, latest_date DESC NULLS LAST, ticket DESC LIMIT 5""",
    "token_terms": f"SELECT request_id, array_to_string({_terms('objective')}, ' ') AS terms FROM requests",
    "term_overlap_similarity": f"""WITH t AS (SELECT DISTINCT doc_id, unnest({_terms("text")}) AS term FROM documents WHERE text IS NOT NULL),
s AS (SELECT a.doc_id AS asked, b.doc_id, sum(least(12, length(a.term)))::BIGINT AS score FROM t a JOIN t b USING (term) GROUP BY ALL)
SELECT asked, doc_id, score, row_number() OVER (PARTITION BY asked ORDER BY score DESC, doc_id DESC)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score DESC, doc_id DESC) <= 5""",
    "redaction": f"WITH {CORPUS} SELECT blob, md5({_redact('content')}) AS digest FROM stored",
    "chunk_lines": f"WITH {_CHUNKS} SELECT * FROM c",
    "chunk_cards": rf"""WITH {_CHUNKS},
code AS (SELECT c.*, coalesce(array_to_string(list_slice(p, start_line, end_line), chr(10)), '') AS full_code FROM c JOIN q USING (blob)),
capped AS (SELECT *, CASE WHEN length(full_code) > 2048 THEN substr(full_code, 1, 2048) || chr(10) || '[semantic card code capped]' ELSE full_code END AS code FROM code)
SELECT sha256(concat_ws(chr(0), blob, '1', start_line, end_line, symbol, '80', '2048', '1')) AS chunk_id, blob, start_line, end_line, symbol,
  md5(concat_ws(chr(10), 'Repository: r', 'Path: ' || blob || '.kt', 'Language: Kotlin', 'Kind: ' || kind, 'Symbol: ' || symbol,
    'Identifiers: ' || substr(array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*'))), 1, 40), ' '), 1, 256), 'Code:', code)) AS card FROM capped""",
    "pickaxe_history": rf"""WITH {CORPUS}, days AS (SELECT snapshot, strftime(max(delivered_at), '%Y-%m-%d') AS date FROM files GROUP BY 1),
ch AS (SELECT coalesce(a.s, b.s)::INT AS snapshot, coalesce(a.repo, b.repo) AS repo, coalesce(a.path, b.path) AS path, a.blob AS old, b.blob AS new
  FROM (SELECT snapshot + 1 AS s, * FROM entries WHERE snapshot < 4) a FULL JOIN (SELECT snapshot AS s, * FROM entries WHERE snapshot > 1) b ON a.s = b.s AND a.repo = b.repo AND a.path = b.path
  WHERE a.path IS NULL OR b.path IS NULL OR a.blob IS DISTINCT FROM b.blob),
d AS (SELECT repo, snapshot || ':' || path AS sha, date, path, coalesce(n.content, '') AS added, coalesce(o.content, '') AS removed FROM ch JOIN days USING (snapshot) LEFT JOIN stored n ON n.blob = ch.new LEFT JOIN stored o ON o.blob = ch.old),
h AS (SELECT *, CASE WHEN length(added) - length(replace(added, 'this.', '')) <> length(removed) - length(replace(removed, 'this.', '')) THEN 'count' ELSE 'line' END AS how FROM d WHERE contains(added, 'this.') OR contains(removed, 'this.')),
g AS (SELECT *, min(how) OVER (PARTITION BY repo) AS best FROM h)
SELECT repo, sha, date, path, how FROM g WHERE how = best QUALIFY row_number() OVER (PARTITION BY repo ORDER BY date DESC, sha) <= 20""",
    "vector_topk": f"WITH {_VECTORS} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM v QUALIFY rank <= 40",
    "vector_topk_per_label": f"WITH {_VECTORS} SELECT query_id, label, vec_id, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id)::INT AS rank FROM v QUALIFY rank <= 5",
    "hashed_embedding": f"WITH t AS (SELECT request_id AS id, objective AS text FROM requests), {_HASHED} SELECT id AS request_id, place::INT AS place, value FROM vec WHERE value <> 0",
    "cached_embedding": f"""WITH {_CACHED}, {_HASHED},
made AS (SELECT id AS cache_key, round(sum(value * value), 4) AS norm, max(CASE WHEN place = 3 THEN value ELSE 0 END) + min(CASE WHEN place = 3 THEN value ELSE 0 END) AS fourth FROM vec GROUP BY 1)
SELECT cache_key, true AS from_cache, round(list_sum(list_transform(v, lambda x: x * x)), 4) AS norm, v[4] AS fourth FROM hit
UNION ALL SELECT id, false, coalesce(norm, 0.0), coalesce(fourth, 0.0) FROM t LEFT JOIN made ON made.cache_key = t.id""",
    "cache_after_use": f"""WITH {_CACHED},
old AS (SELECT cache_key, pack_id, CASE WHEN pack_id = '{PACK}' AND dimension = 64 AND cache_key IN (SELECT cache_key FROM hit) THEN TIMESTAMP '2030-01-01' ELSE last_used_at END AS used FROM embedding_cache),
every AS (SELECT * FROM old UNION ALL SELECT id, '{PACK}', TIMESTAMP '2030-01-01' FROM t)
SELECT cache_key, pack_id, strftime(used, '%Y-%m-%d') AS day FROM every ORDER BY used DESC NULLS LAST, cache_key LIMIT 700""",
    "latency_percentiles": "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY 1",
    "latest_per_event": "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1",
    "payload_timings": """WITH p AS (SELECT event_type || '.k' AS name, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events)
SELECT name, count(*) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, max(v) AS max FROM p WHERE v IS NOT NULL GROUP BY 1""",
    "case_metrics": f'WITH {_EVAL} SELECT "case", expected, returned, found, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg, round(precision, 6) AS precision FROM m',
    "macro_metrics": f"""WITH {_EVAL} SELECT round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS reciprocal_rank, round(avg(ndcg), 6) AS ndcg, round(avg(precision), 6) AS precision, 'skipped' AS nulls FROM m
UNION ALL SELECT round(avg(coalesce(recall, 0)), 6), round(avg(coalesce(reciprocal_rank, 0)), 6), round(avg(coalesce(ndcg, 0)), 6), round(avg(coalesce(precision, 0)), 6), 'zero' FROM m""",
    "micro_recall": f"WITH {_EVAL} SELECT round(sum(found) / sum(expected), 6) AS recall FROM m",
    "duplicate_ratio": f'WITH {_EVAL} SELECT "case", round(1 - count(DISTINCT item) / count(*), 6) AS ratio FROM ranked GROUP BY 1',
    "session_progress": """WITH r AS (SELECT user_id, event_id, event_type = 'purchase' AS new, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)
SELECT user_id, event_id, sum((NOT new)::INT) OVER (PARTITION BY user_id, run ORDER BY event_id)::INT AS no_progress FROM r""",
    "first_seen_evidence": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS is_new FROM events",
    "cumulative_coverage": """SELECT user_id, event_id, bool_or(event_type = 'purchase') OVER w AS bought, bool_or(event_type = 'error') OVER w AS failed FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "coverage_flags": r"""WITH c AS (SELECT request_id, regexp_matches(path, '(?i)(^|/)(test|tests|src/test)/|(?:Test|Tests|IT|Spec)\.') AS t,
  lower(regexp_extract(string_split(path, '/')[-1], '.\.([^.]*)$', 1)) IN ('conf', 'gradle', 'json', 'properties', 'toml', 'xml', 'yaml', 'yml') AS c FROM raw_candidates WHERE path IS NOT NULL)
SELECT request_id, bool_or(NOT t AND NOT c) AS production_source, bool_or(t) AS tests, bool_or(c) AS configuration FROM c GROUP BY 1""",
    "reply_classify": """SELECT doc_id, CASE WHEN contains(coalesce(text, ''), 'FINAL_SOLUTION:') AND NOT contains(string_split(text, 'FINAL_SOLUTION:')[-1], 'CONTEXT_REQUEST:') THEN 'final'
  WHEN contains(coalesce(text, ''), 'CONTEXT_REQUEST:') THEN 'request' ELSE 'conversation' END AS kind FROM documents""",
    "plan_explain": """SELECT * FROM (VALUES (1, 0, 0, 'file', 'harbor-core:platform/shared/src/main/java/dev/keelworks/Anchors.java', 'harbor-core'), (2, 0, 1, 'callees', 'Keel.compactHeader', ''), (3, 0, 1, 'callers', 'Keel.compactHeader', ''),
(4, 0, 1, 'definition', 'Keel.compactHeader', ''), (5, 0, 1, 'path', 'ledger', ''), (6, 1, 2, 'search', 'requireNonNull', 'tide-ledger,harbor-core'), (7, 3, 4, 'history', 'OPS-203', ''), (8, 4, 2, 'search', 'logger.(debug|info)', '')) t(step, tier, cost, kind, value, repos)""",
    "stream_refresh": f"WITH {CORPUS}, e AS (SELECT *, lag(blob) OVER (PARTITION BY repo, path ORDER BY snapshot) AS before FROM entries WHERE blob IS NOT NULL) SELECT snapshot, repo, path, blob FROM e WHERE blob IS DISTINCT FROM before",
    "stream_sessions": """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type, event_id % 3 ORDER BY event_id) > 1 AS dup, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS new FROM events),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r)
SELECT user_id::VARCHAR AS ticket, event_id::INT AS number, new::INT AS new_evidence, sum((NOT dup AND NOT new)::INT) OVER (PARTITION BY user_id, run ORDER BY event_id)::INT AS no_progress, dup AS duplicate FROM g""",
    "retrieve_context": f"""WITH RECURSIVE {_RETRIEVED}, {regions(150)},
ranked AS (SELECT * FROM regions ORDER BY score DESC, repo, path, line LIMIT 500),
a AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY score DESC, repo, path, line) AS x FROM ranked),
b AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, repo, path, line) AS y FROM a WHERE x <= 2),
chosen AS (SELECT * FROM b WHERE y <= 8 ORDER BY score DESC, repo, path, line LIMIT 18),
iv AS (SELECT repo, path, CASE WHEN len(p) <= 350 THEN 1 ELSE greatest(1, line - 75) END AS s, CASE WHEN len(p) <= 350 THEN len(p) ELSE least(len(p), line + 75) END AS e, array_to_string(kinds, ', ') AS kind, score, found_by FROM chosen JOIN parts USING (repo, path)
  UNION ALL SELECT repo, path, 5, least(30, len(p)), 'requested file', 100.0, ['file'] FROM parts WHERE repo = 'harbor-core' AND path = 'platform/shared/src/main/java/dev/keelworks/Anchors.java'),
o AS (SELECT *, max(e) OVER (PARTITION BY repo, path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path ORDER BY s, e) AS island FROM o),
k AS (SELECT repo, path, island, trim(unnest(string_split(kind, ','))) AS k, unnest(range(1, len(string_split(kind, ',')) + 1)) AS pos, row_number() OVER (PARTITION BY repo, path, island ORDER BY s, e, kind) AS rn FROM i),
k2 AS (SELECT repo, path, island, string_agg(k, ', ' ORDER BY o) AS kind FROM (SELECT repo, path, island, k, min(rn * 100 + pos) AS o FROM k GROUP BY ALL) GROUP BY ALL),
m AS (SELECT repo, path, island, min(s)::INT AS line_start, max(e)::INT AS line_end, max(score)::DOUBLE AS score, array_to_string(list_sort(list_distinct(flatten(list(found_by)))), ',') AS channels FROM i GROUP BY ALL)
SELECT m.repo, m.path, line_start, line_end, kind, score, channels, md5(array_to_string(list_slice(p, line_start, line_end), chr(10))) AS content FROM m JOIN k2 USING (repo, path, island) JOIN parts USING (repo, path)""",
    "retrieve_calls": rf"""WITH {_RETRIEVED},
d5 AS (SELECT DISTINCT repo, path, line FROM traced WHERE kind = 'definition' ORDER BY repo, path, line LIMIT 5),
src AS (SELECT d5.line, CASE WHEN len(p) <= 350 THEN p ELSE list_slice(p, greatest(1, line - 75), line + 75) END AS p FROM d5 JOIN parts USING (repo, path)),
calls AS (SELECT DISTINCT callee FROM (SELECT unnest(regexp_extract_all(array_to_string(p, chr(10)), '{L.CALL}', 1)) AS callee FROM src) WHERE string_split(callee, '.')[-1] NOT IN ({", ".join(repr(w) for w in [*L.NO_CALLS, "compactHeader"])}) ORDER BY callee LIMIT 80),
found AS (SELECT 'search:requireNonNull' AS a FROM s1 UNION SELECT 'search:logger.(debug|info)' FROM s2 UNION SELECT 'path:ledger' FROM p1 UNION SELECT 'definition:Keel.compactHeader' FROM d1 UNION SELECT 'callers:Keel.compactHeader' FROM traced WHERE kind = 'caller'
  UNION SELECT 'callees:Keel.compactHeader' FROM calls UNION SELECT 'file:harbor-core:platform/shared/src/main/java/dev/keelworks/Anchors.java' FROM corpus WHERE repo = 'harbor-core' AND path = 'platform/shared/src/main/java/dev/keelworks/Anchors.java' UNION SELECT 'history:OPS-203' FROM hist)
SELECT 'call' AS part, 'Keel.compactHeader ' || callee AS name FROM calls
UNION ALL SELECT 'unresolved', a FROM (VALUES ('search:requireNonNull'), ('search:logger.(debug|info)'), ('path:ledger'), ('definition:Keel.compactHeader'), ('callers:Keel.compactHeader'), ('callees:Keel.compactHeader'),
  ('file:harbor-core:platform/shared/src/main/java/dev/keelworks/Anchors.java'), ('history:OPS-203')) t(a) WHERE a NOT IN (SELECT a FROM found)""",
    "stream_windowed_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
