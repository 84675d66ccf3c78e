"""Retrieval quality, latencies and the progress of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.functions.text import content_hash, is_config, is_test
from siftmark.runtime import cut


def case_metrics(rankings: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(case, expected, returned, found, recall, reciprocal_rank, ndcg, precision) at ``k`` for every case.

    ``rankings`` has case, rank and item; of an item ranked twice the first place counts
    and the places close up. Recall and reciprocal rank are null where nothing is
    expected, precision where nothing was returned; precision divides by the number returned.
    """
    first = rankings.groupBy("case", "item").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("case").orderBy("rank", "item")
    top = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    want = expected.select("case", "item").where(F.col("item").isNotNull()).distinct().withColumn("hit", F.lit(1))
    joined = top.join(want, ["case", "item"], "left")
    gain = F.when(F.col("hit") == 1, 1 / F.log2(F.col("place") + 1)).otherwise(0.0)
    got = joined.groupBy("case").agg(F.count("*").alias("returned"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"), F.min(F.when(F.col("hit") == 1, F.col("place"))).alias("best"), F.sum(gain).alias("dcg"))
    need = want.groupBy("case").agg(F.count("*").alias("expected"))
    cases = expected.select("case").distinct().join(need, "case", "left").join(got, "case", "left")
    n, r = F.coalesce("expected", F.lit(0)), F.coalesce("returned", F.lit(0))
    found = F.coalesce("found", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return cases.select(
        "case", n.alias("expected"), r.alias("returned"), found.alias("found"),
        F.when(n > 0, found / n).alias("recall"),
        F.when(n > 0, F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(n > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        F.when(r > 0, found / r).alias("precision"),
    )


def macro(metrics: DataFrame, columns: list[str], null_as_zero: bool = False) -> DataFrame:
    """Means over cases, rounded to six places; nulls are skipped, or count as 0."""
    value = lambda c: F.coalesce(c, F.lit(0.0)) if null_as_zero else F.col(c)
    return metrics.agg(*[F.round(F.avg(value(c)), 6).alias(c) for c in columns])


def micro_recall(metrics: DataFrame) -> DataFrame:
    """All found over all expected; null if nothing is expected."""
    return metrics.agg(F.round(F.sum("found") / F.nullif(F.sum("expected"), F.lit(0)), 6).alias("recall"))


def duplicate_ratio(rankings: DataFrame) -> DataFrame:
    """The part of ranked rows of each case that repeat an item."""
    return rankings.groupBy("case").agg(F.round(1 - F.count_distinct("item") / F.count("*"), 6).alias("ratio"))


def percentiles(events: DataFrame, group: str, value: str, points: tuple[float, ...] = (0.5, 0.95), ranges: int = 256) -> DataFrame:
    """Nearest-rank percentiles, maximum and count of every group; null values are left out.

    Equal values are counted before the shuffle. The values of a group are cut into
    ``ranges`` at approximate quantiles; sums over the ranges tell in which one a rank
    lies, and only there values are summed up one by one. So the result is exact and no
    group, however many values it has, is held by one task.
    """
    counts = cut(events.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("__n")))
    cuts = counts.groupBy(group).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("__cuts"))
    same = lambda a, b: F.col(f"{a}.{group}").eqNullSafe(F.col(f"{b}.{group}"))
    placed = counts.alias("c").join(cuts.alias("q"), same("c", "q")).select("c.*", F.size(F.filter("__cuts", lambda x: x < F.col(value))).alias("__range"))
    sums = placed.groupBy(group, "__range").agg(F.sum("__n").alias("__m"), F.max(value).alias("__max"))
    upto = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(group)
    sums = sums.withColumns({"__end": F.sum("__m").over(upto), "n": F.sum("__m").over(whole), "max": F.max("__max").over(whole)}).withColumn("__start", F.col("__end") - F.col("__m"))
    ranks = F.array(*[F.struct(F.lit(f"p{round(p * 100)}").alias("point"), F.greatest(F.lit(1), F.ceil(F.col("n") * p)).alias("rank")) for p in points])
    asked = sums.select(group, "__range", "__start", "__end", "n", "max", F.explode(ranks).alias("__p")).where((F.col("__p.rank") > F.col("__start")) & (F.col("__p.rank") <= F.col("__end")))
    inside = Window.partitionBy(group, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = placed.alias("v").join(asked.select(group, "__range").distinct().alias("w"), same("v", "w") & (F.col("v.__range") == F.col("w.__range")), "left_semi").withColumn("__at", F.sum("__n").over(inside))
    hit = near.alias("v").join(asked.alias("a"), same("v", "a") & (F.col("v.__range") == F.col("a.__range")) & (F.col("v.__at") >= F.col("a.__p.rank") - F.col("a.__start")))
    found = hit.groupBy(F.col(f"a.{group}").alias(group), "a.n", "a.max", F.col("a.__p.point").alias("__point")).agg(F.min(f"v.{value}").alias("__v"))
    return found.groupBy(group, "n", "max").pivot("__point", [f"p{round(p * 100)}" for p in points]).agg(F.first("__v")).select(group, "n", *[f"p{round(p * 100)}" for p in points], "max")


def latest(events: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The last row of every group by ``order``, without a sort of the group."""
    rest = [c for c in events.columns if c not in (group, *order)]
    return events.groupBy(group).agg(F.max(F.struct(*order, *rest)).alias("x")).select(group, "x.*")


def timings(events: DataFrame, payload: str, suffix: str = "_ms") -> DataFrame:
    """(event, metric, value) of all numbers in a JSON payload whose names end in ``suffix``; malformed payloads have none."""
    pairs = F.explode(F.map_entries(F.from_json(payload, "map<string,string>")))
    rows = events.select(F.col("event"), pairs.alias("kv"))
    return rows.where(F.col("kv.key").endswith(suffix)).select("event", F.col("kv.key").alias("metric"), F.col("kv.value").try_cast("double").alias("value")).where(F.col("value").isNotNull())


def first_seen(evidence: DataFrame, session: str, key: str, order: list[str]) -> DataFrame:
    """Rows with ``is_new``: the first time that a session sees a key."""
    w = Window.partitionBy(session, key).orderBy(*order)
    return evidence.withColumn("is_new", F.row_number().over(w) == 1)


def progress(rounds: DataFrame, session: str, number: str, new: str) -> DataFrame:
    """Rounds with ``no_progress``: how many rounds in a row, up to this one, brought nothing new."""
    w = Window.partitionBy(session).orderBy(number)
    some = F.sum(F.when(F.col(new) > 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rounds.withColumn("__run", some)
    inside = Window.partitionBy(session, "__run").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("no_progress", F.sum(F.when(F.col(new) > 0, 0).otherwise(1)).over(inside).cast("int")).drop("__run")


def cumulative_or(rounds: DataFrame, session: str, number: str, flags: list[str]) -> DataFrame:
    """Flags that stay set from the first round that sets them."""
    w = Window.partitionBy(session).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    return rounds.withColumns({f: F.bool_or(F.coalesce(f, F.lit(False))).over(w) for f in flags})


def coverage(evidence: DataFrame, group: list[str], path: Column, is_test: Column, is_config: Column) -> DataFrame:
    """Which classes of files each group's evidence covers."""
    test, config = F.coalesce(is_test, F.lit(False)), F.coalesce(is_config, F.lit(False))
    return evidence.where(path.isNotNull()).groupBy(*group).agg(F.bool_or(~test & ~config).alias("production_source"), F.bool_or(test).alias("tests"), F.bool_or(config).alias("configuration"))


def reply_kind(text: Column) -> Column:
    """``final``, ``request`` or ``conversation``, by which marker comes last in a reply."""
    last = lambda marker: F.when(F.locate(marker, text) > 0, F.length(text) - F.length(F.substring_index(text, marker, -1))).otherwise(0)
    final, request = last("FINAL_SOLUTION:"), last("CONTEXT_REQUEST:")
    return F.when(final > request, "final").when(request > 0, "request").otherwise("conversation")


def session_coverage(evidence: DataFrame, group: list[str], *, relationships: DataFrame | None = None, history: DataFrame | None = None, cases: DataFrame | None = None) -> DataFrame:
    """The six flags of what a round has shown: production source, tests, configuration, relationships, history and similar tickets.

    ``evidence`` has the group, repo, path and kind. Evidence of kind ``test`` is a test wherever it lies; outside
    knowledge and local changes are no source. The other tables need only the group.
    """
    kind, path = F.coalesce("kind", F.lit("")), F.col("path")
    test = (kind == "test") | F.coalesce(is_test(path), F.lit(False))
    config = F.coalesce(is_config(path), F.lit(False))
    source = ~test & ~config & ~F.coalesce(F.col("repo").isin("external", "knowledge"), F.lit(False)) & (kind != "local diff")
    flags = evidence.select(*group, source.alias("production_source"), test.alias("tests"), config.alias("configuration"), *[F.lit(False).alias(c) for c in ("relationships", "git_history", "similar_tickets")])
    for name, rows in (("relationships", relationships), ("git_history", history), ("similar_tickets", cases)):
        if rows is not None:
            flags = flags.unionByName(rows.select(*group, *[F.lit(c == name).alias(c) for c in flags.columns if c not in group]))
    return flags.groupBy(*group).agg(*[F.bool_or(c).alias(c) for c in flags.columns if c not in group])


def backend_counters(calls: DataFrame, group: list[str]) -> DataFrame:
    """Counters of each run: operations, files, raw hits, cache hits, and milliseconds by backend as a map, three digits."""
    each = calls.groupBy(*group, "backend").agg(
        F.round(F.sum("elapsed_ms"), 3).alias("ms"), F.count("*").alias("n"), F.sum(F.coalesce("files", F.lit(0))).alias("files"), F.sum(F.coalesce("raw_hits", F.lit(0))).alias("hits"), F.count_if("cache_hit").alias("cached")
    )
    total = each.groupBy(*group).agg(
        F.sum("n").alias("operations"), F.sum("files").alias("files_visited"), F.sum("hits").alias("raw_hits"), F.sum("cached").alias("cache_hits"), F.array_sort(F.collect_list(F.struct("backend", "ms"))).alias("ms")
    )
    return total.withColumn("backend_ms", F.map_from_entries("ms")).drop("ms")


def with_progress(rounds: DataFrame, evidence: DataFrame, session: str = "session", number: str = "number") -> DataFrame:
    """Each round with ``new_evidence`` and ``known_evidence`` (keys seen for the first time, and seen before) and ``no_progress``.

    ``rounds`` has session and number, ``evidence`` also ``key``. A key counts once in a round.
    """
    once = evidence.select(session, number, "key").distinct()
    marked = first_seen(once, session, "key", [number])
    counts = marked.groupBy(session, number).agg(F.count_if("is_new").alias("new_evidence"), F.count_if(~F.col("is_new")).alias("known_evidence"))
    rows = rounds.join(counts, [session, number], "left").fillna(0, ["new_evidence", "known_evidence"])
    return progress(rows, session, number, "new_evidence")


def evidence_key(columns: tuple[str, ...] = ("repo", "path", "line_start", "line_end", "content")) -> Column:
    """SHA-256 of an evidence's place and content."""
    return content_hash(*[F.col(c) for c in columns])


def repeated_plans(requests: DataFrame, session: str, number: str, signature: str, source: str) -> DataFrame:
    """Requests with ``repeats``: the number of the earlier request of the session that had the same plan over the same sources, or null."""
    w = Window.partitionBy(session, signature, source).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    return requests.withColumn("repeats", F.min(number).over(w))


def pinned(rows: DataFrame, sessions: DataFrame, session: str = "session") -> DataFrame:
    """Rows of the snapshots that their session started with: ``sessions`` has session, repo and sha. Rows of other commits are left out."""
    return rows.join(sessions.select(session, "repo", "sha"), [session, "repo", "sha"], "left_semi")


def missing_pins(sessions: DataFrame, stored: DataFrame) -> DataFrame:
    """(session, repo, sha): pinned snapshots that are not stored any more; their sessions cannot go on."""
    return sessions.join(stored.select("repo", "sha").distinct(), ["repo", "sha"], "left_anti").select("session", "repo", "sha")


def session_evaluation(sessions: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """What each session retrieved against the files that commits of its ticket changed later.

    ``sessions`` has ticket, place (order of the evidence shown) and item (``repo:path``), ``cases`` ticket, repos,
    paths and test_paths; only sessions with a case count. Recall of files, repositories and tests is null where
    nothing was changed; the reciprocal rank and the gain read the first ``k`` as shown, so an item shown twice gains
    twice. Nothing but a case's own lists is held together, however much a session has shown.
    """
    repo = lambda c: F.substring_index(c, ":", 1)
    sizes = cases.select("ticket", *[F.size(c).alias(n) for c, n in (("paths", "actual_files"), ("repos", "actual_repos"), ("test_paths", "actual_tests"))])
    wanted = cases.select("ticket", F.explode("paths").alias("item"), "test_paths").select("ticket", "item", F.array_contains("test_paths", F.col("item")).alias("test"))
    at = F.row_number().over(Window.partitionBy("ticket").orderBy("place", "item"))
    top = sessions.withColumn("at", at).where(F.col("at") <= k).join(wanted.select("ticket", "item"), ["ticket", "item"], "left_semi")
    gains = top.groupBy("ticket").agg(F.min("at").alias("first"), F.sum(1 / F.log2(F.col("at") + 1)).alias("gain"))
    each = sessions.groupBy("ticket", "item").agg(F.count("*").alias("times")).join(wanted.withColumn("hit", F.lit(True)), ["ticket", "item"], "left")
    files = each.groupBy("ticket").agg(F.count("*").alias("retrieved_files"), F.sum("times").alias("shown"), F.count_if("hit").alias("matched_files"), F.count_if(F.col("hit") & F.col("test")).alias("matched_tests"))
    repos = sessions.select("ticket", repo(F.col("item")).alias("repo")).distinct().join(cases.select("ticket", F.explode("repos").alias("repo")).distinct(), ["ticket", "repo"], "left_semi").groupBy("ticket").agg(F.count("*").alias("matched_repos"))
    missed = wanted.join(sessions.select("ticket", "item").distinct(), ["ticket", "item"], "left_anti").groupBy("ticket").agg(F.array_sort(F.collect_set("item")).alias("missed"))
    rows = files.join(sizes, "ticket").join(gains, "ticket", "left").join(repos, "ticket", "left").join(missed, "ticket", "left").withColumn("matched_repos", F.coalesce("matched_repos", F.lit(0)))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("actual_files")))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return rows.select(
        "ticket", "actual_files", "retrieved_files", "matched_files", "actual_repos", "matched_repos", "actual_tests", "matched_tests",
        ratio("matched_files", "actual_files").alias("file_recall"),
        ratio("matched_repos", "actual_repos").alias("repo_recall"),
        ratio("matched_tests", "actual_tests").alias("test_recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("actual_files") > 0, F.coalesce("gain", F.lit(0.0)) / best).alias("ndcg"),
        ratio("matched_files", "retrieved_files").alias("precision"),
        (1 - F.col("retrieved_files") / F.col("shown")).alias("duplicate_ratio"),
        F.coalesce("missed", F.array().cast("array<string>")).alias("missed"),
    )


def session_summary(evaluations: DataFrame) -> DataFrame:
    """One row over all evaluated sessions: recalls of all files, repositories and tests together, means of the rest in which null is 0."""
    part = lambda n: F.sum(f"matched_{n}") / F.nullif(F.sum(f"actual_{n}"), F.lit(0))
    mean = lambda c: F.avg(F.coalesce(c, F.lit(0.0))).alias(c)
    return evaluations.agg(F.count("*").alias("sessions"), part("repos").alias("repo_recall"), part("files").alias("file_recall"), part("tests").alias("test_recall"), *[mean(c) for c in ("mrr", "ndcg", "precision", "duplicate_ratio")])


SPLITS = ("calibration", "validation", "holdout")


def golden_evaluation(rankings: DataFrame, suite: DataFrame, limit: int = 20, split: str | None = None) -> DataFrame:
    """Every case of a suite against what was found for it: recall at several cuts, reciprocal rank, gain, precision, false positives.

    ``rankings`` has case, rank, item (``repo:path``); ``suite`` has case, split (null is holdout), item and role
    (``production``, ``tests`` or ``required``, which are all required, and ``excluded``); a case that expects nothing
    has one row with a null item. Places close up where an item is ranked twice. Another split than the three is an error.
    """
    if split is not None and split not in SPLITS:
        raise ValueError("split has to be one of " + ", ".join(SPLITS))
    wanted = suite.withColumn("split", F.coalesce("split", F.lit("holdout")))
    wanted = wanted.where(F.col("split") == split) if split else wanted
    lists = lambda *roles: F.array_sort(F.collect_set(F.when(F.col("role").isin(*roles), F.col("item"))))
    expect = wanted.groupBy("case", "split").agg(lists("production", "tests", "required").alias("required"), lists("tests").alias("tests"), lists("excluded").alias("excluded"))
    first = rankings.groupBy("case", "item").agg(F.min("rank").alias("rank"))
    raw = rankings.groupBy("case").agg(F.count("*").alias("shown"))
    place = F.row_number().over(Window.partitionBy("case").orderBy("rank", "item"))
    deep = max(limit, 20)
    top = first.withColumn("place", place)
    size = first.groupBy("case").agg(F.count("*").alias("distinct"))
    listed = top.where(F.col("place") <= deep).groupBy("case").agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("top"))
    rows = expect.join(listed, "case", "left").join(raw, "case", "left").join(size, "case", "left")
    rows = rows.withColumn("top", F.coalesce(F.transform("top", lambda x: x["item"]), F.array().cast("array<string>")))
    cut_at = lambda n: F.slice("top", 1, n)
    repos = lambda items: F.array_distinct(F.transform(items, lambda x: F.substring_index(x, ":", 1)))
    recall = lambda found, want: F.when(F.size(want) > 0, F.size(F.array_intersect(found, want)) / F.size(want))
    hits = F.filter(F.transform(cut_at(10), lambda x, i: F.when(F.array_contains("required", x), i + 1)), lambda i: i.isNotNull())
    gain = lambda places: F.aggregate(places, F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    ideal = gain(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(10), F.size("required")))))
    precision = lambda n: F.when(F.size(cut_at(n)) > 0, F.size(F.array_intersect(cut_at(n), "required")) / F.size(cut_at(n)))
    some = F.size("required") > 0
    return rows.select(
        "case", "split",
        *[recall(repos(cut_at(n)), repos("required")).alias(f"repo_recall_at_{n}") for n in (5, 10)],
        *[recall(cut_at(n), F.col("required")).alias(f"file_recall_at_{n}") for n in (5, 10, 20)],
        recall(cut_at(limit), F.col("required")).alias("file_recall_at_limit"),
        recall(cut_at(limit), F.col("tests")).alias("test_recall_at_limit"),
        recall(cut_at(10), F.col("tests")).alias("test_recall_at_10"),
        F.when(some, F.coalesce(1 / F.get(hits, F.lit(0)), F.lit(0.0))).alias("mrr_at_10"),
        F.when(some, gain(hits) / ideal).alias("ndcg_at_10"),
        precision(5).alias("precision_at_5"), precision(10).alias("precision_at_10"),
        F.size(F.array_intersect(cut_at(10), "excluded")).alias("false_positives_at_10"),
        F.when(F.col("shown") > 0, 1 - F.col("distinct") / F.col("shown")).otherwise(0.0).alias("duplicate_ratio"),
    )
