"""Commit history, tickets and cases that look like a new one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.functions.text import is_config, is_test, overlap_score, split_lines, terms, ticket_ids
from siftmark.operators import overlap
from siftmark.operators.corpus import IGNORED_DIRS, MAX_BYTES, UNSAFE, admitted, stored_blobs

# Most changes of a commit, commits of a repository, characters read of a text about a ticket, and shown of it.
MAX_CHANGES, COMMITS, READ_CHARS, EXCERPT_CHARS = 250, 1000, 20_000, (6_000, 12_000)


def parse_log(logs: DataFrame, text: str = "text") -> DataFrame:
    """(repo, sha, date, subject, tickets, changes) from raw logs.

    Records are parted by 0x1E. The first line of one has commit id, date and subject,
    parted by 0x1F; the lines below are name-status lines, of which the first 250 count
    (status as written, last path). Subjects are redacted; commits whose subject names no
    ticket and records without the three fields are left out.
    """
    records = logs.select("repo", F.explode(F.split(text, "\x1e")).alias("r")).select("repo", split_lines(F.regexp_replace("r", r"^\n+|\n+$", "")).alias("ls"))
    head = F.split(F.get("ls", F.lit(0)), "\x1f", 3)
    rows = records.where(F.size("ls") > 0).select("repo", "ls", head.alias("h")).where(F.size("h") == 3)
    parts = F.filter(F.transform(F.slice("ls", F.lit(2), F.size("ls")), lambda x: F.split(x, "\t")), lambda x: (F.size(x) >= 2) & F.get(x, F.lit(0)).rlike("^[A-Z][0-9]*$"))
    changes = F.slice(F.transform(parts, lambda x: F.struct(F.get(x, F.lit(0)).alias("status"), F.element_at(x, -1).alias("path"))), 1, MAX_CHANGES)
    rows = rows.select("repo", F.get("h", F.lit(0)).alias("sha"), F.get("h", F.lit(1)).alias("date"), redacted(F.get("h", F.lit(2))).alias("subject"), changes.alias("changes"))
    return rows.withColumn("tickets", F.array_sort(ticket_ids(F.col("subject")))).where(F.size("tickets") > 0).select("repo", "sha", "date", "subject", "tickets", "changes")


def with_new_commits(known: DataFrame, new: DataFrame, limit: int = COMMITS) -> DataFrame:
    """The newest ``limit`` commits of each repository, of known and newly read ones; a commit read anew replaces the known row."""
    both = known.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    again = Window.partitionBy("repo", "sha").orderBy(F.col("__new").desc())
    order = Window.partitionBy("repo").orderBy(F.col("date").desc_nulls_last(), "sha")
    rows = both.withColumn("__n", F.row_number().over(again)).where(F.col("__n") == 1)
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n", "__new")


def cases(commits: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per ticket over all repositories: date of the latest commit, repositories, paths by class, subjects and terms.

    ``texts`` (ticket, ticket_text, knowledge_text) adds what is known of a ticket: its
    words count as terms of the case and redacted beginnings are shown as excerpts.
    """
    rows = commits.select("repo", "sha", "date", "subject", "changes", F.explode("tickets").alias("ticket")).dropDuplicates(["repo", "sha", "ticket"])
    unique = lambda c: F.array_sort(F.array_distinct(c))
    paths = F.flatten(F.collect_list(F.transform("changes", lambda x: F.concat_ws(":", F.col("repo"), x["path"]))))
    grouped = rows.groupBy("ticket").agg(
        F.max("date").alias("latest_date"), F.array_sort(F.collect_set("repo")).alias("repos"), unique(paths).alias("paths"), F.array_sort(F.collect_set("subject")).alias("subjects"), F.count("*").alias("commits")
    )
    told = [F.lit(""), F.lit("")]
    if texts is not None:
        grouped = grouped.join(texts.select("ticket", "ticket_text", "knowledge_text"), "ticket", "left")
        told = [F.coalesce(F.substring(c, 1, READ_CHARS), F.lit("")) for c in ("ticket_text", "knowledge_text")]
    words = F.concat_ws(" ", F.array_join("subjects", " "), F.array_join("paths", " "), *told)
    bare = lambda p: F.regexp_replace(p, "^[^:]*:", "")
    shown = [redacted(F.substring(t, 1, n)).alias(c) for t, n, c in zip(told, EXCERPT_CHARS, ("ticket_excerpt", "knowledge_excerpt"))]
    return grouped.select(
        "ticket", "latest_date", "repos", "paths", "subjects", "commits", F.filter("paths", lambda p: is_test(bare(p))).alias("test_paths"), F.filter("paths", lambda p: is_config(bare(p))).alias("config_paths"), terms(words).alias("terms"), *shown
    )


def similar_cases(cases: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """The cases nearest to a query: 1000 for its own ticket id, else by common terms; those without any are left out."""
    asked = F.lit(query)
    exact = F.when(F.array_contains(ticket_ids(asked), F.col("ticket")), 1000).otherwise(0)
    scored = cases.withColumn("score", exact + overlap_score(F.col("terms"), terms(asked))).where(F.col("score") > 0)
    return scored.orderBy(F.col("score").desc(), F.col("latest_date").desc_nulls_last(), F.col("ticket").desc()).limit(limit)


def term_index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key) postings, each once; to be kept as a table or written down, since searches read it several times."""
    return rows.where(F.col(text).isNotNull()).select(key, F.explode(terms(F.col(text))).alias("term")).distinct()


def term_lists(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms): all terms of a key, each once; rows of the same key are put together."""
    lists = rows.where(F.col(text).isNotNull()).select(key, terms(F.col(text)).alias("terms"))
    if rows.where(F.col(text).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
        return lists
    return lists.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def similar_by_terms(queries: DataFrame | None, index: DataFrame, query_key: str, key: str, text: str, limit: int = 5, *, first_postings: int = 20_000, direct_pairs: int = 20_000_000) -> DataFrame:
    """(query_key, key, score, rank): the nearest rows of each query by common terms, ties by the greater key; without ``queries`` of each row of the index.

    ``index`` has ``term_index`` postings or ``term_lists`` rows; all of it is searched, in shards of
    some 65,000 rows. In each of them the rarest terms of a query, ``first_postings`` postings
    at least, give a score that the ``limit``-th row has at least; rows that what is left cannot
    lift to it are not looked at again, so the result is the same. Where a block of queries and a shard have
    ``direct_pairs`` pairs at most, all terms are simply added up.
    """
    if "terms" not in index.columns:
        index = index.groupBy(key).agg(F.collect_list("term").alias("terms"))
    packs = overlap.packed(index, key)
    asked = packs if queries is None else overlap.packed(term_lists(queries, query_key, text), query_key)
    score = overlap.nearest(asked, packs, limit, first_postings, direct_pairs)
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("k").desc())
    return score.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(F.col("q").alias(query_key), F.col("k").alias(key), "score", "rank")


# What is replaced in a patch and by what, in this order.
REDACTION = [
    (r"(?s)-----BEGIN [^-]*PRIVATE KEY-----.*?-----END [^-]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
    (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "[REDACTED AWS ACCESS KEY]"),
    (r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{20,})\b", "[REDACTED TOKEN]"),
    (r"\b(?:xox[baprs]-[A-Za-z0-9-]{20,})\b", "[REDACTED TOKEN]"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "[REDACTED JWT]"),
    (r"(?i)(authorization\s*[:=]\s*(?:bearer|basic)\s+)\S+", "$1[REDACTED]"),
    (r"(?i)(https?://[^:/\s]+:)[^@\s]+@", "$1[REDACTED]@"),
    (r"(?i)([?&](?:api[-_]?key|password|secret|token)=)[^&\s]+", "$1[REDACTED]"),
    (r"(?imd)^([+\- ]?[^\n]*(?:api[-_.]?key|client[-_.]?secret|credential|password|secret|token)[^:=\n]*[ \t]*[:=][ \t]*)([^\n]+)$", "$1[REDACTED]"),
]


def redacted(text: Column) -> Column:
    """A patch with keys, tokens, credentials in URLs and values of sensitive assignments replaced by a mark."""
    for pattern, mark in REDACTION:
        text = F.regexp_replace(text, pattern, mark)
    return text


def patch_excerpts(patches: DataFrame, budget: int, order: list[str]) -> DataFrame:
    """Patches of safe paths in order, redacted and clipped to a running budget of characters; those beyond it are left out."""
    safe = patches.where(~F.coalesce(F.col("path").rlike(UNSAFE), F.lit(False))) if "path" in patches.columns else patches
    rows = safe.withColumn("text", redacted(F.col("text")))
    w = Window.partitionBy("ticket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    room = F.greatest(F.lit(budget) - used, F.lit(0)).cast("int")
    return rows.withColumn("excerpt", F.substring(F.col("text"), F.lit(1), room)).where(F.length("excerpt") > 0)


def occurrences(text: Column, literal: str) -> Column:
    """How often a literal stands in a text, without overlaps."""
    return F.round((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def pickaxe(diffs: DataFrame, query: str, limit: int = 20, group: str = "repo") -> DataFrame:
    """Changes after which a literal occurs more or less often; in a repository without any, those with a changed line that holds it.

    ``diffs`` has repo, sha, date, added and removed text. The newest ``limit`` of each repository by date and sha.
    """
    added, removed = (F.coalesce(F.col(c), F.lit("")) for c in ("added", "removed"))
    held = diffs.where(added.contains(query) | removed.contains(query)).withColumn("how", F.when(occurrences(added, query) != occurrences(removed, query), "count").otherwise("line"))
    best = F.min("how").over(Window.partitionBy(group))  # "count" comes before "line"
    order = Window.partitionBy(group).orderBy(F.col("date").desc(), "sha")
    rows = held.select(*[c for c in diffs.columns if c not in ("added", "removed")], "how").withColumn("__best", best).where(F.col("how") == F.col("__best"))
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__best", "__n")


def snapshot_diffs(files: DataFrame, blobs: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(repo, sha, date, path, added, removed) of every file that changed between two snapshots: its text after and before.

    ``sha`` names the later snapshot and the path, ``date`` is the day of its delivery. Contents are joined to changed files only.
    """
    from siftmark.operators.snapshots import latest_entries, snapshot_changes

    changes = snapshot_changes(latest_entries(files), pairs)
    days = files.groupBy("snapshot").agg(F.date_format(F.max("delivered_at"), "yyyy-MM-dd").alias("date"))
    wanted = changes.select(F.explode(F.array("old", "new")).alias("blob")).where(F.col("blob").isNotNull()).distinct()
    texts = stored_blobs(blobs.where(F.col("blob").isNotNull()).withColumn("blob", F.lower("blob")).join(wanted, "blob", "left_semi"))
    rows = changes.join(days, "snapshot").join(texts.select(F.col("blob").alias("new"), F.col("content").alias("added")), "new", "left").join(texts.select(F.col("blob").alias("old"), F.col("content").alias("removed")), "old", "left")
    return rows.select("repo", F.concat_ws(":", F.col("snapshot").cast("string"), "path").alias("sha"), "date", "path", "added", "removed")


def git_manifest(trees: DataFrame, text: str = "text") -> DataFrame:
    """(repo, path, blob) of regular files from raw ``ls-tree -r -z`` output: records end in a zero byte."""
    rows = trees.select("repo", F.explode(F.split(text, "\x00")).alias("r"))
    form = r"(?s)^(100\d{3}) blob ([0-9a-f]{7,64})\t(.+)$"
    return rows.where(F.col("r").rlike(form)).select("repo", F.regexp_extract("r", form, 3).alias("path"), F.regexp_extract("r", form, 2).alias("blob"))


def fetchable(manifest: DataFrame, sizes: DataFrame, known: DataFrame, limit: int = MAX_BYTES, text: str = "text") -> DataFrame:
    """(blob, size): the blobs of a manifest to be read: named by an admitted path, not stored yet, of at most ``limit`` bytes.

    ``sizes`` holds raw ``cat-file --batch-check`` output (``id type size`` a line), so the
    limit is applied before any content is read; other kinds of objects are left out.
    """
    form = r"^([0-9a-f]{7,64}) blob (\d+)$"
    found = sizes.select(F.explode(split_lines(F.col(text))).alias("r")).where(F.col("r").rlike(form)).select(F.regexp_extract("r", form, 1).alias("blob"), F.regexp_extract("r", form, 2).cast("bigint").alias("size")).distinct()
    named = manifest.where(admitted()).select("blob").distinct().join(known.select(F.lower("blob").alias("blob")), "blob", "left_anti")
    return found.where(F.col("size") <= limit).join(named, "blob", "left_semi")


def chosen_refs(refs: DataFrame, priority: list[str]) -> DataFrame:
    """(repo, ref, sha): of each repository's refs the first by the branch configured for it, then ``priority``, then its own default.

    ``refs`` has repo, ref (short name), sha, branch (configured, may be null) and is_default.
    A repository without any of these is left out.
    """
    place = F.when(F.col("ref") == F.col("branch"), 0)
    for i, name in enumerate(priority, 1):
        place = place.when(F.col("ref") == name, i)
    place = place.when(F.coalesce("is_default", F.lit(False)), len(priority) + 1)
    rows = refs.withColumn("__p", place).where(F.col("__p").isNotNull())
    return rows.groupBy("repo").agg(F.min(F.struct("__p", "ref", "sha")).alias("x")).select("repo", "x.ref", "x.sha")


def repository_roots(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path): folders that hold a ``.git`` entry, from a list of clean paths; none inside another one or in an ignored folder."""
    ignored = "|".join(re.escape(d) for d in IGNORED_DIRS if d != ".git")
    rows = paths.where(F.col(path).rlike(r"(^|/)\.git(/|$)")).select(F.regexp_replace(path, r"/?\.git(/.*)?$", "").alias("path")).distinct()
    rows = rows.where(~F.col("path").rlike(rf"(^|/)({ignored})(/|$)"))
    above = rows.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("up"))
    inner = above.where(F.col("up") != F.col("path")).join(rows.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
    return rows.join(inner, "path", "left_anti")
