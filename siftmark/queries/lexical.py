"""Search over lines, paths and declarations of the last snapshot."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.functions.text import basename, is_config, is_test, language, stem, suffix
from siftmark.operators import lexical as L
from siftmark.operators.corpus import GenerationStore
from siftmark.queries.base import CORPUS, source, texts
from siftmark.runtime import checkpoint_folder, cut, table

LITERAL, REGEX, FALLBACK, SYMBOL, TRACED, BUDGET = ".ifPresent(", r"\b(raise|throw new) [A-Z]\w+\(", r"logger\.(debug|info)\(", "compactHeader", "clampRule", 20


def literal_search_lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.literal_search(*source(spark, sf), LITERAL, BUDGET).select("repo", "path", "line", "text", "score")


def regex_search_lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.regex_search(*source(spark, sf), REGEX, BUDGET).select("repo", "path", "line", "text", "score")


def literal_then_regex_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return L.literal_or_regex(*source(spark, sf), FALLBACK, BUDGET).select("repo", "path", "line", "score")


def _store(spark: SparkSession, sf: str) -> GenerationStore:
    """The corpus as a published generation with postings, written once per session and folder of tables."""
    root = f"{checkpoint_folder(spark)}/store-{hashlib.sha256(sf.encode()).hexdigest()[:16]}-{spark.sparkContext.applicationId}"
    store = GenerationStore(spark, root)
    if not store.current():
        files, blobs = source(spark, sf)
        store.publish(files, blobs, index=True)
    return store


def trigram_search(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, sf)
    return L.trigram_search(store.files(), store, LITERAL, BUDGET).select("repo", "path", "line")


def published_corpus(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, sf)
    return store.files().join(store.blobs(), "blob").groupBy("repo").agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("chars"))


def trigram_postings(spark: SparkSession, sf: str) -> DataFrame:
    return L.trigram_index(table(spark, sf, "blobs")).groupBy("trigram").agg(F.count("*").alias("blobs"))


def path_search_topk(spark: SparkSession, sf: str) -> DataFrame:
    return L.path_search(source(spark, sf)[0], "ledger").select("repo", "path", "score", "rank")


def path_search_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return L.path_search(source(spark, sf)[0], "src pinned").select("repo", "path", "score", "rank")


def symbol_declarations(spark: SparkSession, sf: str) -> DataFrame:
    return L.symbol_search(*source(spark, sf), f"Keel.{SYMBOL}").select("repo", "path", "line", "kind", "score")


def symbol_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return L.symbol_search(*source(spark, sf), "requireNonNull").select("repo", "path", "line", "kind", "score")


def implementation_lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.implementations(*source(spark, sf), "string").select("repo", "path", "line", "score")


def test_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return L.test_mentions(*source(spark, sf), "assert", BUDGET).select("repo", "path", "line", "score")


def caller_split(spark: SparkSession, sf: str) -> DataFrame:
    return L.trace(*source(spark, sf), SYMBOL).select("repo", "path", "line", "kind", "score")


def callee_names(spark: SparkSession, sf: str) -> DataFrame:
    return L.callees(*source(spark, sf), SYMBOL)


def framework_facts(spark: SparkSession, sf: str) -> DataFrame:
    return L.framework_facts(*source(spark, sf)).select("repo", "path", "line", F.trim("text").alias("text"))


CODE = r"\.(java|kt|ts|js|py|go)$"


def symbol_table(spark: SparkSession, sf: str) -> DataFrame:
    return L.symbols(texts(spark, sf, CODE))


def structural_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return L.structural_search(L.symbols(texts(spark, sf, CODE)), "Keel.compact").select("repo", "path", "line", "text", "score")


def structural_trace(spark: SparkSession, sf: str) -> DataFrame:
    code = cut(texts(spark, sf, CODE))
    declared = cut(L.symbols(code))
    return L.structural_trace(declared, cut(L.call_edges(code, declared)), TRACED)


def path_classes(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return source(spark, sf)[0].select("repo", "path", basename(p).alias("base"), stem(p).alias("stem"), suffix(p).alias("suffix"), language(p).alias("language"), is_test(p).alias("test"), is_config(p).alias("config"))


def knowledge_first_hit(spark: SparkSession, sf: str) -> DataFrame:
    return L.knowledge_hits(table(spark, sf, "documents"), "voucher", 30)


QUERIES = {f.__name__: f for f in (literal_search_lines, regex_search_lines, literal_then_regex_fallback, trigram_search, trigram_postings, path_search_topk, path_search_tokens, symbol_declarations, symbol_mentions, implementation_lines, test_mentions, caller_split, callee_names, framework_facts, symbol_table, structural_symbols, structural_trace, published_corpus, path_classes, knowledge_first_hit)}

_PER_REPO = "QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, line) <= 20"
_DECLARED = L.DECLARATION.replace("{name}", "NAME")
_DECL = _DECLARED.replace("NAME", SYMBOL)
_DEFINED = L.DEFINED.replace("{name}", SYMBOL)
_TEST = r"(?i)(^|/)(test|tests|src/test)/|(?:Test|Tests|IT|Spec)\."
_BASE = "string_split(path, '/')[-1]"


def _paths(query: str, tokens: list[str]) -> str:
    every = " AND ".join(f"contains(lower(path), '{t}')" for t in tokens)
    return f"""WITH {CORPUS},
s AS (SELECT DISTINCT repo, path, CASE WHEN lower(path) = '{query}' OR lower({_BASE}) = '{query}' OR regexp_replace(lower({_BASE}), '(.)\\.[^.]*$', '\\1') = '{query}' THEN 100.0
  WHEN contains(lower(path), '{query}') THEN 95.0 WHEN {every} THEN 85.0 END::DOUBLE AS score FROM corpus)
SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, length(path), path) AS rank FROM s WHERE score IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY repo ORDER BY score DESC, length(path), path) <= 12"""


_SYMBOLS = rf"""{CORPUS},
code AS (SELECT * FROM lines WHERE regexp_matches(path, '{CODE}')),
marks AS (SELECT repo, path, line, list_min(list_transform(range(1, len(regexp_extract_all(text, '{L.DECLARED}', 1)) + 1),
  lambda i: CASE WHEN regexp_extract_all(text, '{L.DECLARED}', 1)[i] <> '' THEN regexp_extract_all(text, '{L.DECLARED}', 1)[i] ELSE regexp_extract_all(text, '{L.DECLARED}', 2)[i] END)) AS name FROM code WHERE regexp_matches(text, '{L.DECLARED}')),
ends AS (SELECT repo, path, max(line) AS n FROM code GROUP BY ALL),
symbols AS (SELECT repo, path, line, coalesce(lead(line) OVER (PARTITION BY repo, path ORDER BY line) - 1, n)::INT AS end_line, name FROM marks JOIN ends USING (repo, path))"""

ORACLE = {
    "literal_search_lines": f"WITH {CORPUS} SELECT repo, path, line, text, 95.0::DOUBLE AS score FROM lines WHERE contains(text, '{LITERAL}') {_PER_REPO}",
    "regex_search_lines": f"WITH {CORPUS} SELECT repo, path, line, text, 80.0::DOUBLE AS score FROM lines WHERE regexp_matches(text, '{REGEX}') {_PER_REPO}",
    "literal_then_regex_fallback": rf"""WITH {CORPUS}, lit AS (SELECT * FROM lines WHERE contains(text, '{FALLBACK}')),
hit AS (SELECT repo, path, line, 95.0::DOUBLE AS score FROM lit UNION ALL SELECT repo, path, line, 80.0::DOUBLE FROM lines WHERE regexp_matches(text, '{FALLBACK}') AND NOT EXISTS (SELECT 1 FROM lit))
SELECT * FROM hit {_PER_REPO}""",
    "trigram_search": f"WITH {CORPUS} SELECT repo, path, line FROM lines WHERE contains(text, '{LITERAL}') {_PER_REPO}",
    "trigram_postings": f"""WITH {CORPUS}, g AS (SELECT DISTINCT blob, unnest(list_transform(range(1, length(content) - 1), lambda i: substr(lower(content), i, 3))) AS trigram FROM stored WHERE length(content) >= 3)
SELECT trigram, count(*) AS blobs FROM g GROUP BY 1""",
    "path_search_topk": _paths("ledger", ["ledger"]),
    "path_search_tokens": _paths("src pinned", ["src", "pinned"]),
    "symbol_declarations": f"WITH {CORPUS} SELECT repo, path, line, 'definition' AS kind, 100.0::DOUBLE AS score FROM lines WHERE contains(text, '{SYMBOL}') AND regexp_matches(text, '{_DECL}') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, line) <= 100",
    "symbol_mentions": rf"""WITH {CORPUS}, d AS (SELECT 1 FROM lines WHERE contains(text, 'requireNonNull') AND regexp_matches(text, '{_DECLARED.replace("NAME", "requireNonNull")}'))
SELECT repo, path, line, 'symbol reference' AS kind, 60.0::DOUBLE AS score FROM lines WHERE regexp_matches(text, '\brequireNonNull\b') AND NOT EXISTS (SELECT 1 FROM d) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, line) <= 100""",
    "implementation_lines": rf"WITH {CORPUS} SELECT repo, path, line, 98.0::DOUBLE AS score FROM lines WHERE contains(text, 'string') AND regexp_matches(text, '\b(?:implements|extends)\s+[^{{\n]*\bstring\b|:\s*[^{{=\n]*\bstring\b') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, line) <= 100",
    "test_mentions": f"WITH {CORPUS} SELECT repo, path, line, 97.0::DOUBLE AS score FROM lines WHERE contains(text, 'assert') AND regexp_matches(path, '{_TEST}') {_PER_REPO}",
    "caller_split": rf"""WITH {CORPUS} SELECT DISTINCT repo, path, line, CASE WHEN regexp_matches(text, '{_DEFINED}') THEN 'definition' ELSE 'caller' END AS kind,
  CASE WHEN regexp_matches(text, '{_DEFINED}') THEN 100.0 ELSE 96.0 END::DOUBLE AS score FROM lines WHERE regexp_matches(text, '\b{SYMBOL}\s*\(')""",
    "callee_names": rf"""WITH {CORPUS}, d AS (SELECT DISTINCT repo, path, line FROM lines WHERE regexp_matches(text, '\b{SYMBOL}\s*\(') AND regexp_matches(text, '{_DEFINED}') ORDER BY repo, path, line LIMIT 5),
n AS (SELECT repo, path, max(line) AS n FROM lines GROUP BY ALL),
s AS (SELECT d.repo, d.path, d.line, string_agg(l.text, chr(10) ORDER BY l.line) AS code FROM d JOIN n USING (repo, path) JOIN lines l ON l.repo = d.repo AND l.path = d.path AND (n.n <= 350 OR abs(l.line - d.line) <= 75) GROUP BY ALL)
SELECT DISTINCT callee FROM (SELECT unnest(regexp_extract_all(code, '{L.CALL}', 1)) AS callee FROM s)
WHERE string_split(callee, '.')[-1] NOT IN ({", ".join(repr(w) for w in [*L.NO_CALLS, SYMBOL])}) ORDER BY callee LIMIT 80""",
    "framework_facts": f"WITH {CORPUS} SELECT repo, path, line, trim(text) AS text FROM lines WHERE regexp_matches(text, '{L.FRAMEWORK}') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, line) <= 300",
    "symbol_table": f"WITH {_SYMBOLS} SELECT * FROM symbols",
    "structural_symbols": f"WITH {_SYMBOLS} SELECT repo, path, line, name AS text, 110.0::DOUBLE AS score FROM symbols WHERE contains(lower(name), 'compact') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY name = 'compact' DESC, path, line) <= 100",
    "structural_trace": rf"""WITH RECURSIVE {_SYMBOLS},
calls AS (SELECT DISTINCT repo, path, line, unnest(regexp_extract_all(text, '{L.CALLED}', 1)) AS callee FROM code),
edges AS (SELECT DISTINCT c.repo, s.name AS caller, c.callee FROM calls c ASOF JOIN symbols s ON c.repo = s.repo AND c.path = s.path AND c.line >= s.line
  WHERE c.callee NOT IN ({", ".join(repr(w) for w in L.NO_CALLS)}) AND s.name <> c.callee AND EXISTS (SELECT 1 FROM symbols t WHERE t.repo = c.repo AND t.name = c.callee)),
walk AS (SELECT DISTINCT repo, name, 0 AS depth, d AS direction FROM symbols, (VALUES ('out'), ('in')) v(d) WHERE name = '{TRACED}'
  UNION SELECT e.repo, CASE WHEN direction = 'out' THEN callee ELSE caller END, depth + 1, direction FROM walk w JOIN edges e ON e.repo = w.repo AND w.name = CASE WHEN direction = 'out' THEN caller ELSE callee END WHERE depth < 4),
r AS (SELECT repo, name, direction, min(depth) AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0)
SELECT s.repo, s.path, s.line, s.name, direction, depth FROM symbols s JOIN r ON s.repo = r.repo AND s.name = r.name""",
    "published_corpus": f"WITH {CORPUS} SELECT repo, count(*) AS files, sum(length(content))::BIGINT AS chars FROM corpus GROUP BY 1",
    "path_classes": rf"""WITH {CORPUS}, p AS (SELECT repo, path, {_BASE} AS base FROM corpus)
SELECT repo, path, base, regexp_replace(base, '(.)\.[^.]*$', '\1') AS stem, lower(regexp_extract(base, '.\.([^.]*)$', 1)) AS suffix,
  CASE lower(regexp_extract(base, '.\.([^.]*)$', 1)) WHEN 'java' THEN 'Java' WHEN 'kt' THEN 'Kotlin' WHEN 'py' THEN 'Python' WHEN 'js' THEN 'JavaScript' WHEN 'ts' THEN 'TypeScript' WHEN 'go' THEN 'Go' WHEN 'sql' THEN 'SQL'
    WHEN 'sh' THEN 'Shell' WHEN 'yaml' THEN 'YAML' WHEN 'yml' THEN 'YAML' WHEN 'json' THEN 'JSON' WHEN 'xml' THEN 'XML' WHEN 'md' THEN 'Markdown' WHEN 'properties' THEN 'Properties' WHEN 'tf' THEN 'Terraform' WHEN 'css' THEN 'CSS' ELSE 'Text' END AS language,
  regexp_matches(path, '{_TEST}') AS test, lower(regexp_extract(base, '.\.([^.]*)$', 1)) IN ('conf', 'gradle', 'json', 'properties', 'toml', 'xml', 'yaml', 'yml') AS config FROM p""",
    "knowledge_first_hit": r"""WITH p0 AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS p FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN list_slice(p, 1, len(p) - 1) ELSE p END AS p FROM p0),
l AS (SELECT doc_id, len(p) AS n, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS text FROM p),
h AS (SELECT doc_id, n, min(line) AS line FROM l WHERE regexp_matches(text, '(?i)voucher') GROUP BY ALL ORDER BY doc_id LIMIT 30)
SELECT doc_id, line::INT AS line, greatest(1, line - 20)::INT AS line_start, least(n, line + 20)::INT AS line_end, 70.0::DOUBLE AS score FROM h""",
}
