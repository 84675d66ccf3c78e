"""Hits to bounded evidence: fusion, region merge, quotas, windows and interval merge.

A hit has repo, path, line, text, kind, score and found_by; evidence has line_start and
line_end in place of line. Each stage has a total order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.functions.text import suffix

# Constants of fusion and selection.
RRF_K = 60
FEATURES = {"definition": 14, "requested": 30, "test": 8, "relationship": 6}
OUTSIDE = ("/generated/", "/vendor/")
OUTSIDE_COST = 25
CANDIDATES, HYDRATED, PER_FILE, PER_REPO = 500, 18, 2, 8
WINDOW_LINES, FULL_FILE_LINES = 150, 350
RERANK_POOL, RERANK_BONUS = 40, 20


def fuse(hits: DataFrame) -> DataFrame:
    """One row per (repo, path, line): that of the greatest (score, kind, found_by), all channels, and a fused score.

    Score: the best one, features of its kind and path, and 100 times the sum of
    1 / (60 + i) over the channels in alphabetical order, rounded to three places. Null
    scores rank below all others and count as 0; a null line is a location of its own.
    """
    best = F.max(F.struct("score", "kind", "found_by", "text")).alias("best")
    channels = F.array_sort(F.array_distinct(F.flatten(F.collect_list("found_by")))).alias("channels")
    rows = hits.groupBy("repo", "path", "line").agg(best, channels)
    low = F.concat(F.lit("/"), F.lower("path"), F.lit("/"))
    feature = sum((F.when(F.col("best.kind").contains(k), v).otherwise(0) for k, v in FEATURES.items()), F.lit(0))
    feature = feature - F.when(low.contains(OUTSIDE[0]) | low.contains(OUTSIDE[1]), OUTSIDE_COST).otherwise(0)
    fused = F.when(F.size("channels") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("channels"), F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / (RRF_K + i))).otherwise(0.0)
    score = F.round(F.coalesce("best.score", F.lit(0.0)) + feature + 100 * fused, 3)
    return rows.select("repo", "path", "line", F.col("best.text").alias("text"), F.col("best.kind").alias("kind"), score.alias("score"), F.col("channels").alias("found_by"))


def merged_channels(*channels: DataFrame) -> DataFrame:
    """The hits of several channels as one row for each location: greatest score, all channels; text and kind of the first channel that has it."""
    every = None
    for i, c in enumerate(channels):
        rows = c.select("repo", "path", "line", "text", "kind", "score", "found_by", F.lit(i).alias("__i"))
        every = rows if every is None else every.unionByName(rows)
    first = F.min(F.struct("__i", (-F.coalesce("score", F.lit(0.0))).alias("s"), "kind", "text")).alias("x")
    rows = every.groupBy("repo", "path", "line").agg(first, F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("found_by")))).alias("found_by"))
    return rows.select("repo", "path", "line", F.col("x.text").alias("text"), F.col("x.kind").alias("kind"), "score", "found_by")


def anchor_regions(hits: DataFrame, distance: int = max(10, WINDOW_LINES)) -> DataFrame:
    """Hits of a file that lie near an anchor become one region: line, text and score of its best hit, all channels and kinds.

    In line order, a hit within ``distance`` of the current anchor joins its region and
    becomes the anchor if it scores higher; one farther away opens a new region. The
    distance counts from the moving anchor, so this is a fold and no gap window. Two
    neighbours farther apart than ``distance`` always part regions, so a file is cut there
    first and each piece is folded on its own. Kinds are joined in order of appearance.
    Hits without a line are left out.
    """
    near = Window.partitionBy("repo", "path").orderBy("line")
    rows = hits.where(F.col("line").isNotNull()).withColumn("__gap", F.coalesce(F.col("line") - F.lag("line").over(near) > distance, F.lit(True)).cast("int"))
    rows = rows.withColumn("__piece", F.sum("__gap").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = rows.groupBy("repo", "path", "__piece").agg(F.array_sort(F.collect_list(F.struct("line", "score", "text", "kind", "found_by"))).alias("hits"))
    text, score = hits.schema["text"].dataType.simpleString(), hits.schema["score"].dataType.simpleString()
    region = f"struct<line:int,score:{score},text:{text},kinds:array<string>,found_by:array<string>>"
    opened = lambda x: F.struct(x["line"].cast("int").alias("line"), x["score"].alias("score"), x["text"].alias("text"), kind_parts(x["kind"]).alias("kinds"), x["found_by"].alias("found_by"))

    def joined(r: Column, x: Column) -> Column:
        better = x["score"] > r["score"]
        pick = lambda c: F.when(better, x[c]).otherwise(r[c]).alias(c)
        return F.struct(F.when(better, x["line"]).otherwise(r["line"]).cast("int").alias("line"), pick("score"), pick("text"), F.array_distinct(F.concat(r["kinds"], kind_parts(x["kind"]))).alias("kinds"), F.array_union(r["found_by"], x["found_by"]).alias("found_by"))

    def step(a: Column, x: Column) -> Column:
        apart = a["now"].isNull() | (x["line"] - a["now"]["line"] > distance)
        closed = F.when(apart & a["now"].isNotNull(), F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
        return F.struct(closed.alias("done"), F.when(apart, opened(x)).otherwise(joined(a["now"], x)).alias("now"))

    start = F.struct(F.array().cast(f"array<{region}>").alias("done"), F.lit(None).cast(region).alias("now"))
    regions = F.aggregate("hits", start, step, lambda a: F.concat(a["done"], F.array(a["now"])))
    out = pieces.select("repo", "path", F.explode(regions).alias("r"))
    return out.select("repo", "path", F.col("r.line").alias("line"), F.col("r.score").alias("score"), F.col("r.text").alias("text"), F.array_join("r.kinds", ", ").alias("kind"), F.array_sort("r.found_by").alias("found_by"))


def kind_parts(kind: Column) -> Column:
    """The kinds that a text names, parted by commas."""
    return F.transform(F.split(F.coalesce(kind, F.lit("")), ","), lambda k: F.trim(k))


def by_rank() -> list[Column]:
    """Score descending, then repo, path and line."""
    return [F.col("score").desc_nulls_last(), F.col("repo").asc_nulls_last(), F.col("path").asc_nulls_last(), F.col("line").asc_nulls_last()]


def diversity(regions: DataFrame, per_file: int = PER_FILE, per_repo: int = PER_REPO, total: int = HYDRATED, candidates: int = CANDIDATES) -> DataFrame:
    """The first ``candidates`` regions by rank with ``selected``: within the quotas of files, repositories and all.

    The same as walking the ranked list and taking what no quota forbids: three nested
    ranks, each over the survivors of the one before. Both limits bound the rows, so the
    last, global rank is over few rows.
    """
    top = regions.orderBy(*by_rank()).limit(candidates)
    order = by_rank()
    rows = top.withColumn("__f", F.row_number().over(Window.partitionBy("repo", "path").orderBy(*order)))
    rows = rows.withColumn("__r", F.sum(F.when(F.col("__f") <= per_file, 1).otherwise(0)).over(Window.partitionBy("repo").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("__f") <= per_file) & (F.col("__r") <= per_repo)
    rows = rows.withColumn("__t", F.sum(F.when(fits, 1).otherwise(0)).over(Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("selected", fits & (F.col("__t") <= total)).drop("__f", "__r", "__t")


def numbered(rows: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` rows by rank with ids C1, C2 and so on."""
    top = rows.orderBy(*by_rank()).limit(limit)
    return top.withColumn("candidate", F.concat(F.lit("C"), F.row_number().over(Window.partitionBy().orderBy(*by_rank()))))


def min_max_bonus(scores: DataFrame, value: str = "rerank", bonus: float = RERANK_BONUS, group: tuple[str, ...] = ()) -> DataFrame:
    """``bonus`` times the min-max normalised value, rounded to three places; 1 where all values are equal; 0 for a null value.

    Least and greatest values are aggregates that combine before the shuffle, so no group is one task.
    """
    if group:
        ends = scores.groupBy(*group).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
        same = [F.col(f"s.{g}").eqNullSafe(F.col(f"e.{g}")) for g in group]
        rows = scores.alias("s").join(ends.alias("e"), same).select("s.*", "e.__low", "e.__high")
    else:
        rows = scores.withColumns({"__low": scores.agg(F.min(value)).scalar(), "__high": scores.agg(F.max(value)).scalar()})
    norm = F.when(F.col("__high") == F.col("__low"), 1.0).otherwise((F.col(value) - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0)))
    norm = F.when(F.col(value).isNotNull(), norm)
    return rows.withColumn("bonus", F.round(F.coalesce(norm, F.lit(0.0)) * bonus, 3)).drop("__low", "__high")


def token_overlap(query: Column, text: Column) -> Column:
    """The number of common words of a query and a text, by white space, in lower case."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(query), words(text)))


# What a kind holds that no rerank may move, and the characters of a snippet.
PROTECTED, SNIPPET_CHARS = ("definition", "requested"), 1200


def is_protected(kind: Column) -> Column:
    """Whether a kind holds a protected word, in any case; a null kind does not."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    out = F.lit(False)
    for word in PROTECTED:
        out = out | low.contains(word)
    return out


def snippet() -> Column:
    """What a reranker reads of a hit: repository, path, suffix, kind and the beginning of its text."""
    language = F.when(suffix(F.col("path")) != "", suffix(F.col("path"))).otherwise("text")
    text = F.substring(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), "\x00", " "), 1, SNIPPET_CHARS)
    parts = [("Repository: ", F.col("repo")), ("Path: ", F.col("path")), ("Language: ", language), ("Kind: ", F.coalesce("kind", F.lit(""))), ("Snippet: ", text)]
    return F.concat_ws("\n", *[F.concat(F.lit(n), v) for n, v in parts])


def rerank(hits: DataFrame, query: str, pool: int = RERANK_POOL, score: Callable[[Column, Column], Column] = token_overlap) -> DataFrame:
    """Hits with a bonus for the first ``pool`` unprotected locations by rank, by what ``score`` gives their snippet for a query.

    A location counts once, with its best hit; only that hit gets the bonus and the
    reranker among its channels. Protected hits and those beyond the pool stay as they are.
    """
    first = Window.partitionBy("repo", "path", "line").orderBy(F.col("score").desc_nulls_last(), "kind", "text")
    free = hits.where(~is_protected(F.col("kind"))).withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1)
    chosen = free.orderBy(*by_rank()).limit(pool).withColumn("rerank", score(F.lit(query), snippet()).cast("double"))
    key = ["repo", "path", "line", "kind", "text"]
    rated = min_max_bonus(chosen).select(*[F.col(c).alias(f"__{c}") for c in key], "bonus")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    rows = hits.join(F.broadcast(rated), same, "left")  # at most ``pool`` rows
    moved = F.col("bonus").isNotNull()
    rows = rows.withColumn("score", F.when(moved, F.round(F.col("score") + F.col("bonus"), 3)).otherwise(F.col("score")))
    return rows.withColumn("found_by", F.when(moved, F.array_sort(F.array_union("found_by", F.array(F.lit("reranker"))))).otherwise(F.col("found_by"))).select(*hits.columns)


def source_window(hits: DataFrame, sizes: DataFrame, window: int = WINDOW_LINES, full: int = FULL_FILE_LINES) -> DataFrame:
    """Hits with the lines to show: the whole file if it is short, else some lines around the hit."""
    reach = max(10, window // 2)
    rows = hits.join(sizes.select("repo", "path", "lines"), ["repo", "path"])
    whole = F.col("lines") <= full
    start = F.when(whole, 1).otherwise(F.greatest(F.lit(1), F.col("line") - reach))
    end = F.when(whole, F.col("lines")).otherwise(F.least(F.col("lines"), F.col("line") + reach))
    return rows.withColumn("line_start", start.cast("int")).withColumn("line_end", end.cast("int")).drop("lines")


def merge_intervals(evidence: DataFrame) -> DataFrame:
    """Overlapping or adjoining intervals of a file as one: greatest score, all channels, kinds in order of appearance.

    An interval opens a new one if it starts more than a line beyond all before it;
    intervals that are equal belong to the same one. A kind that names several counts as these.
    """
    order = Window.partitionBy("repo", "path").orderBy("line_start", "line_end")
    reach = F.max("line_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = evidence.withColumn("__opens", F.when(reach.isNull() | (F.col("line_start") > reach + 1), 1).otherwise(0))
    rows = rows.withColumn("__island", F.sum("__opens").over(order))
    first = F.array_sort(F.collect_set(F.struct("line_start", "line_end", "kind")))
    kinds = F.array_distinct(F.flatten(F.transform(first, lambda x: kind_parts(x["kind"]))))
    return rows.groupBy("repo", "path", "__island").agg(
        F.min("line_start").alias("line_start"),
        F.max("line_end").alias("line_end"),
        F.max("score").alias("score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("found_by")))).alias("found_by"),
        F.array_join(kinds, ", ").alias("kind"),
    ).drop("__island")


def stitch(merged: DataFrame, lines: DataFrame) -> DataFrame:
    """Merged intervals with their ``content``: the file's lines, an empty one where a line is missing."""
    wanted = merged.select("repo", "path", "line_start", "line_end", F.explode(F.sequence("line_start", "line_end")).alias("line"))
    rows = wanted.join(lines.select("repo", "path", "line", "text"), ["repo", "path", "line"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n")
    content = rows.groupBy("repo", "path", "line_start", "line_end").agg(text.alias("content"))
    return merged.join(content, ["repo", "path", "line_start", "line_end"])


def within_budget(rows: DataFrame, size: str, budget: int, limit: int = HYDRATED, used: int = 0) -> DataFrame:
    """Of the first ``limit`` rows by rank those taken one after the other while the sum of ``size`` fits ``budget``.

    A row that does not fit is skipped and the next is tried. Where nothing is ``used`` yet a row is always taken.
    """
    top = rows.orderBy(*by_rank()).limit(limit)
    order = F.struct((-F.col("score")).alias("s"), "repo", "path", "line", F.col(size).cast("bigint").alias("n"))
    listed = top.agg(F.array_sort(F.collect_list(order)).alias("all"))
    start = F.struct(F.lit(used).cast("bigint").alias("used"), F.array().cast("array<boolean>").alias("take"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["used"] == 0) | (a["used"] + x["n"] <= budget)
        return F.struct((a["used"] + F.when(fits, x["n"]).otherwise(0)).alias("used"), F.concat(a["take"], F.array(fits)).alias("take"))

    taken = listed.select(F.explode(F.arrays_zip("all", F.aggregate("all", start, step, lambda a: a["take"]).alias("take"))).alias("x"))
    return taken.select("x.all.repo", "x.all.path", "x.all.line", F.col("x.all.n").alias("size"), F.col("x.take").alias("taken"))
