"""Search over lines, paths and declarations.

All patterns of a request are tried in one pass over the contents: a line is read once,
tagged with the patterns it matches and shuffled only if it matches any. Hits join the
files that hold their blob afterwards. Every result has a total order before it is cut
to a budget.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmark.functions.text import TEST_PATH, basename, places, split_lines, stem, trigrams
from siftmark.operators.corpus import GenerationStore, matching_lines
from siftmark.runtime import cut

# Scores of the kinds of hits.
SCORE = {"literal": 95.0, "regex": 80.0, "path_exact": 100.0, "path_part": 95.0, "path_tokens": 85.0, "definition": 100.0, "structural": 110.0, "reference": 60.0, "implementation": 98.0, "test": 97.0, "caller": 96.0, "knowledge": 70.0}
# Words that look like calls and are none.
NO_CALLS = "if for while switch catch return new throw super this".split()
# The forms of a line that declares a name, of one that implements it, of one that defines what is called, and of a call.
DECLARATION = (
    r"\b(?:class|interface|enum|record|trait|struct|type|object|def|fn|func|function|fun)\s+{name}\b"
    r"|\b{name}\s*[:=]\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>)"
    r"|\b(?:public|protected|private|static|final|abstract|synchronized|native\s+)*[A-Za-z_$][\w$<>, ?\[\].]*\s+{name}\s*\("
)
IMPLEMENTATION = r"\b(?:implements|extends)\s+[^{\n]*\b{name}\b|:\s*[^{=\n]*\b{name}\b"
DEFINED = r"\b(?:def|fn|func|function|fun|[A-Za-z_$][\w$<>, ?\[\]]+)\s+{name}\s*\("
CALL = r"\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?)\s*\("
# Annotations of frameworks, and how many facts of a repository are shown.
FRAMEWORK = r"@(RestController|Controller|Service|Repository|FeignClient|KafkaListener|Scheduled|Entity|Table|RequestMapping|GetMapping|PostMapping|PutMapping|PatchMapping|DeleteMapping)\b"
FACTS = 300


@dataclass(frozen=True)
class Pattern:
    """What is looked for under ``tag``: lines that hold ``literal`` and match ``regex``, in paths that match ``path``."""

    tag: str
    kind: str
    score: float
    by: str
    literal: str | None = None
    regex: str | None = None
    path: str | None = None
    repos: tuple[str, ...] = ()

    def line(self, text: Column) -> Column:
        parts = [text.contains(self.literal)] if self.literal is not None else []
        parts += [text.rlike(self.regex)] if self.regex is not None else []
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


def last_part(name: str) -> str:
    """The last part of a dotted name."""
    return name.rsplit(".", 1)[-1]


def with_name(form: str, name: str) -> str:
    return form.replace("{name}", re.escape(name))


def valid(spark: SparkSession, pattern: str) -> bool:
    """Whether a text is a Java regular expression."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001 - the JVM's syntax error
        return False
    return True


def scan(files: DataFrame, blobs: DataFrame, patterns: list[Pattern], limit: int | None = 100) -> DataFrame:
    """(tag, repo, path, line, text, kind, score, found_by): the hits of all patterns by one pass over the contents.

    The first ``limit`` hits of every tag and repository by (path, line). A content is
    split into lines only if it holds one of the literals or a pattern has none.
    """
    text = F.col("text")
    tags = F.filter(F.array(*[F.when(p.line(text), F.lit(i)) for i, p in enumerate(patterns)]), lambda t: t.isNotNull())
    match = patterns[0].line(text)
    for p in patterns[1:]:
        match = match | p.line(text)
    held = None
    if all(p.literal is not None for p in patterns):
        held = F.col("content").contains(patterns[0].literal)
        for p in patterns[1:]:
            held = held | F.col("content").contains(p.literal)
    lines = matching_lines(blobs, match, held).withColumn("__tags", tags)
    rows = lines.join(files.select("repo", "path", "blob"), "blob").select("repo", "path", "line", "text", F.explode("__tags").alias("__t"))
    allowed = F.lit(True)
    for i, p in enumerate(patterns):
        if p.repos:
            allowed = allowed & ((F.col("__t") != i) | F.col("repo").isin(list(p.repos)))
        if p.path:
            allowed = allowed & ((F.col("__t") != i) | F.col("path").rlike(p.path))
    pick = lambda f: F.element_at(F.array(*[f(p) for p in patterns]), F.col("__t") + 1)
    rows = rows.where(allowed)
    if limit is not None:
        order = Window.partitionBy("__t", "repo").orderBy("path", "line", "text")
        rows = rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit)
    return rows.select(
        pick(lambda p: F.lit(p.tag)).alias("tag"), "repo", "path", "line", "text",
        pick(lambda p: F.lit(p.kind)).alias("kind"), pick(lambda p: F.lit(float(p.score))).alias("score"), F.array(pick(lambda p: F.lit(p.by))).alias("found_by"),
    )


def literal(query: str, tag: str = "literal", repos: tuple[str, ...] = ()) -> Pattern:
    return Pattern(tag, "code", SCORE["literal"], "fts", literal=query, repos=repos)


def regex(query: str, tag: str = "regex", repos: tuple[str, ...] = ()) -> Pattern:
    return Pattern(tag, "code", SCORE["regex"], "regex", regex=query, repos=repos)


def definition(name: str, tag: str = "definition", repos: tuple[str, ...] = ()) -> Pattern:
    n = last_part(name)
    return Pattern(tag, "definition", SCORE["definition"], "symbol", literal=n, regex=with_name(DECLARATION, n), repos=repos)


def reference(name: str, tag: str = "reference", repos: tuple[str, ...] = ()) -> Pattern:
    n = last_part(name)
    return Pattern(tag, "symbol reference", SCORE["reference"], "symbol", literal=n, regex=rf"\b{re.escape(n)}\b", repos=repos)


def implementation(name: str, tag: str = "implementation", repos: tuple[str, ...] = ()) -> Pattern:
    n = last_part(name)
    return Pattern(tag, "implementation", SCORE["implementation"], "symbol", literal=n, regex=with_name(IMPLEMENTATION, n), repos=repos)


def test_mention(name: str, tag: str = "test", repos: tuple[str, ...] = ()) -> Pattern:
    return Pattern(tag, "test", SCORE["test"], "symbol", literal=last_part(name), path=TEST_PATH, repos=repos)


def call(name: str, tag: str = "call", repos: tuple[str, ...] = ()) -> Pattern:
    n = last_part(name)
    return Pattern(tag, "caller", SCORE["caller"], "trace", literal=n, regex=rf"\b{re.escape(n)}\s*\(", repos=repos)


def first_of(hits: DataFrame, tags: list[str]) -> DataFrame:
    """Of hits that were written down: those of the first of ``tags`` that has any.

    The choice is one for the whole scope. ``hits`` is read twice, so it has to be a result of ``cut``.
    """
    place = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))
    best = hits.where(place > 0).agg(F.min(place)).scalar()
    return hits.where((place > 0) & (place == best))


def _hits(files: DataFrame, blobs: DataFrame, pattern: Pattern, limit: int | None) -> DataFrame:
    return scan(files, blobs, [pattern], limit).drop("tag")


def literal_search(files: DataFrame, blobs: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Lines that contain a literal, case-sensitive; the first ``limit`` of every repository by (path, line)."""
    return _hits(files, blobs, literal(query), limit)


def regex_search(files: DataFrame, blobs: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """Lines that match a Java regular expression."""
    return _hits(files, blobs, regex(pattern), limit)


def literal_or_regex(files: DataFrame, blobs: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """The literal hits; where there is none in the whole scope, those of the query as a regular expression.

    Both are found by one pass. A query that is no valid expression has only literal hits.
    """
    if not valid(blobs.sparkSession, query):
        return literal_search(files, blobs, query, limit)
    return first_of(cut(scan(files, blobs, [literal(query), regex(query)], limit)), ["literal", "regex"]).drop("tag")


def trigram_index(blobs: DataFrame) -> DataFrame:
    """(trigram, blob) postings of all contents, each pair once. ``GenerationStore.publish(index=True)`` keeps them written."""
    rows = blobs.where(F.col("blob").isNotNull() & F.col("content").isNotNull()).select(F.lower("blob").alias("blob"), F.explode(trigrams(F.col("content"))).alias("trigram"))
    return rows.distinct()


#: Most blobs whose ids are put into the filter of a scan; more of them are joined.
NAMED_BLOBS = 2_000


def trigram_search(files: DataFrame, store: GenerationStore, query: str, limit: int = 100) -> DataFrame:
    """``literal_search`` of three characters or more through written postings: only blobs that hold all trigrams are read."""
    low = query.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not grams:
        raise ValueError("a literal of three characters or more is needed")
    # every blob's postings stand once, so the blobs of all trigrams are those counted as often
    held = store.postings().where(F.col("trigram").isin(grams)).groupBy("blob").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("blob")
    few = [r.blob for r in held.limit(NAMED_BLOBS + 1).collect()]
    blobs = store.blobs()
    blobs = blobs.where(F.col("blob").isin(few)) if len(few) <= NAMED_BLOBS else blobs.join(held, "blob", "left_semi")
    return _hits(files, blobs, literal(query), limit)


def path_search(files: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """Paths that match a query in lower case: as a whole, base name or stem; as a part; by all tokens of two characters or more.

    The best ``limit`` of each repository by score, length of the path and path. A blank query is an error.
    """
    q = query.strip().lower().replace("\\", "/")
    if not q:
        raise ValueError("a query for paths has to have characters")
    low = F.lower("path")
    tokens = [t for t in re.findall(r"[a-z0-9_.-]+", q) if len(t) > 1]
    every = F.lit(bool(tokens))
    for t in tokens:
        every = every & low.contains(t)
    score = F.when((low == q) | (basename(low) == q) | (stem(low) == q), SCORE["path_exact"]).when(low.contains(q), SCORE["path_part"]).when(every, SCORE["path_tokens"])
    rows = files.select("repo", "path", score.alias("score")).where(F.col("score").isNotNull()).distinct()
    order = Window.partitionBy("repo").orderBy(F.col("score").desc(), F.length("path"), "path")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def symbol_search(files: DataFrame, blobs: DataFrame, name: str, limit: int = 100) -> DataFrame:
    """Declarations of the last part of a dotted name; where there is none at all, lines that mention it as a word. One pass finds both."""
    return first_of(cut(scan(files, blobs, [definition(name), reference(name)], limit)), ["definition", "reference"]).drop("tag")


def implementations(files: DataFrame, blobs: DataFrame, name: str, limit: int = 100) -> DataFrame:
    """Lines that implement, extend or inherit from a type, by the last part of its name."""
    return _hits(files, blobs, implementation(name), limit)


def test_mentions(files: DataFrame, blobs: DataFrame, name: str, limit: int = 100) -> DataFrame:
    """Lines of test files that mention the last part of a name."""
    return _hits(files, blobs, test_mention(name), limit)


def split_calls(hits: DataFrame, name: str) -> DataFrame:
    """Hits of ``call`` as definitions and callers. Any identifier before the name makes a definition, so ``return foo(`` is one."""
    defines = F.col("text").rlike(with_name(DEFINED, last_part(name)))
    return hits.withColumn("kind", F.when(defines, "definition").otherwise("caller")).withColumn("score", F.when(defines, SCORE["definition"]).otherwise(SCORE["caller"]))


def trace(files: DataFrame, blobs: DataFrame, name: str) -> DataFrame:
    """Calls of a name, split into its definitions and its callers."""
    return split_calls(_hits(files, blobs, call(name), None), name)


def callees(files: DataFrame, blobs: DataFrame, name: str, definitions: int = 5, limit: int = 80, *, found: DataFrame | None = None, window: int = 150, full: int = 350) -> DataFrame:
    """(callee): names called in the source around the first ``definitions`` definitions of a name, sorted, the first ``limit``.

    The source is that which is shown: a file of up to ``full`` lines whole, of a longer
    one the lines around the definition. ``found`` are the hits of ``trace`` where they are known.
    """
    rows = found if found is not None else trace(files, blobs, name)
    first = rows.where(F.col("kind") == "definition").select("repo", "path", "line").orderBy("repo", "path", "line").limit(definitions)
    shown = first.join(files.select("repo", "path", "blob"), ["repo", "path"])
    contents = blobs.where(F.col("content").isNotNull()).select(F.lower("blob").alias("blob"), "content")
    texts = contents.join(F.broadcast(shown.select("blob", "line")), "blob")  # as many rows as there are definitions asked for
    reach = max(10, window // 2)
    lines = texts.select("line", split_lines(F.col("content")).alias("ls"))
    start = F.greatest(F.lit(1), F.col("line") - reach)
    part = F.when(F.size("ls") <= full, F.col("ls")).otherwise(F.slice("ls", start, F.col("line") + reach - start + 1))
    calls = lines.select(F.explode(F.regexp_extract_all(F.array_join(part, "\n"), F.lit(CALL), F.lit(1))).alias("callee")).distinct()
    none = [*NO_CALLS, last_part(name)]
    return calls.where(~F.element_at(F.split("callee", r"\."), -1).isin(none)).orderBy("callee").limit(limit)


def knowledge_hits(documents: DataFrame, query: str, limit: int = 30, around: int = 20, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, line_start, line_end, score): the first line of each document that matches, without regard to case.

    A query that is no valid expression is looked for as it stands. The first ``limit``
    documents by key, with ``around`` lines before and after.
    """
    pattern = query if valid(documents.sparkSession, f"(?i){query}") else re.escape(query)
    held = documents.where(F.col(text).isNotNull()).select(key, split_lines(F.col(text)).alias("lines"))
    first = F.array_position(F.transform("lines", lambda x: x.rlike(f"(?i){pattern}")), True).cast("int")
    rows = held.select(key, first.alias("line"), F.size("lines").alias("n")).where(F.col("line") > 0).orderBy(key).limit(limit)
    return rows.select(key, "line", F.greatest(F.lit(1), F.col("line") - around).alias("line_start"), F.least(F.col("n"), F.col("line") + around).alias("line_end"), F.lit(SCORE["knowledge"]).alias("score"))


def framework_facts(files: DataFrame, blobs: DataFrame, limit: int = FACTS) -> DataFrame:
    """Lines with an annotation of a framework; the first ``limit`` of every repository by (path, line)."""
    return _hits(files, blobs, Pattern("fact", "framework fact", SCORE["regex"], "regex", regex=FRAMEWORK), limit)


# The forms of a declaration whose name is not known beforehand.
DECLARED = r"\b(?:class|interface|enum|record|trait|struct|object|def|fn|func|function|fun)[ \t]+([A-Za-z_$][\w$]*)|\b(?:public|protected|private|static)[ \t][\w$<>, ?\[\].]*?\b([A-Za-z_$][\w$]*)[ \t]*\("
CALLED = r"\b([A-Za-z_$][\w$]*)[ \t]*\("


def symbols(texts: DataFrame) -> DataFrame:
    """(repo, path, line, end_line, name): every declaration with the lines up to the one before the next."""
    found = texts.select("repo", "path", F.size(split_lines(F.col("content"))).alias("n"), F.explode(places(F.col("content"), DECLARED)).alias("m"))
    name = lambda i: F.regexp_extract("m.match", DECLARED, i)
    rows = found.select("repo", "path", F.col("m.line").alias("line"), "n", F.when(name(1) != "", name(1)).otherwise(name(2)).alias("name"))
    one = rows.groupBy("repo", "path", "line").agg(F.min("n").alias("n"), F.min("name").alias("name"))
    after = F.lead("line").over(Window.partitionBy("repo", "path").orderBy("line"))
    return one.select("repo", "path", "line", F.coalesce(after - 1, F.col("n")).alias("end_line"), "name")


def call_edges(texts: DataFrame, declared: DataFrame) -> DataFrame:
    """(repo, caller, callee): a declaration's body calls a name that the repository declares, each edge once; calls of itself are left out."""
    calls = texts.select("repo", "path", F.explode(places(F.col("content"), CALLED)).alias("m")).select("repo", "path", F.col("m.line").alias("line"), F.regexp_extract("m.match", CALLED, 1).alias("callee"))
    calls = calls.where(~F.col("callee").isin(NO_CALLS)).distinct()
    # the declaration that a call stands in is the last one before it: an as-of step by a window over both
    starts = declared.select("repo", "path", "line", F.col("name").alias("__name"), F.lit(None).cast("string").alias("callee"))
    both = starts.unionByName(calls.select("repo", "path", "line", F.lit(None).cast("string").alias("__name"), "callee"))
    inside = Window.partitionBy("repo", "path").orderBy("line", F.col("callee").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("caller", F.last("__name", ignorenulls=True).over(inside)).where(F.col("callee").isNotNull() & F.col("caller").isNotNull() & (F.col("caller") != F.col("callee")))
    known = declared.select("repo", F.col("name").alias("callee")).distinct()
    return rows.select("repo", "caller", "callee").distinct().join(known, ["repo", "callee"], "left_semi").select("repo", "caller", "callee")


def structural_search(declared: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Declarations of a name, whole words of it or names that hold it, from the table of symbols: the first ``limit`` of every repository."""
    n = last_part(query)
    rows = declared.where(F.lower("name").contains(n.lower())).withColumn("exact", F.col("name") == n)
    order = Window.partitionBy("repo").orderBy(F.col("exact").desc(), "path", "line")
    rows = rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit)
    return rows.select("repo", "path", "line", F.col("name").alias("text"), F.lit("structural definition").alias("kind"), F.lit(SCORE["structural"]).alias("score"), F.array(F.lit("symbol table")).alias("found_by"))


def structural_trace(declared: DataFrame, edges: DataFrame, query: str, depth: int = 4) -> DataFrame:
    """(repo, path, line, name, direction, depth): declarations that call a name or are called from it, over up to ``depth`` calls.

    One join a step over the table of calls; a name is kept at its least depth in each direction.
    """
    n = last_part(query)
    parts = []
    for direction, here, there in (("out", "caller", "callee"), ("in", "callee", "caller")):
        reached = declared.where(F.col("name") == n).select("repo", "name").distinct().withColumn("depth", F.lit(0))
        front = reached
        for step in range(1, depth + 1):
            front = edges.select("repo", F.col(here).alias("name"), F.col(there).alias("next")).join(front.select("repo", "name"), ["repo", "name"], "left_semi")
            front = front.select("repo", F.col("next").alias("name")).distinct().join(reached.select("repo", "name"), ["repo", "name"], "left_anti").withColumn("depth", F.lit(step))
            reached = cut(reached.unionByName(front))
            front = reached.where(F.col("depth") == step)
        parts.append(reached.where(F.col("depth") > 0).withColumn("direction", F.lit(direction)))
    found = parts[0].unionByName(parts[1])
    return declared.select("repo", "path", "line", "name").join(found, ["repo", "name"]).select("repo", "path", "line", "name", "direction", "depth")
