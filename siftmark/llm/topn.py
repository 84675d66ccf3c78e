"""The N best rows of every group, also of groups with very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, *, spread: Column, salts: int = SALTS) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, with their ``rank`` (1 is best).

    Two stages. Each group is hashed into ``salts`` subgroups by ``spread`` (a column
    that differs within a group, such as an id); every subgroup keeps its best ``n``;
    the survivors, at most ``salts * n`` of a group, are ranked again. ``order`` has to
    be total, then the result is the same in every run; rows equal in all of it are
    interchangeable. Null is a group of its own. An empty table gives an empty result;
    extra columns pass through, and a column already called ``rank`` is replaced.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts))
    inner = Window.partitionBy(*group, "__salt").orderBy(*order)
    outer = Window.partitionBy(*group).orderBy(*order)
    kept = df.drop("rank").withColumn("__salt", salt).withColumn("__rank", F.row_number().over(inner)).where(F.col("__rank") <= n)
    ranked = kept.drop("__salt", "__rank").withColumn("rank", F.row_number().over(outer))
    return ranked.where(F.col("rank") <= n)


def current_candidates(candidates: DataFrame) -> DataFrame:
    """One row per candidate_id: that of the latest ``found_at``; null times come first.

    Among rows of the same time the one with the higher score (NaN highest, null
    lowest), then the lower line, repo and path counts. The filter on rank 1 runs
    before the shuffle too, so an id that was scored anew very often is no hot spot.
    """
    order = [F.col("found_at").desc_nulls_last(), F.col("score").desc_nulls_last(), F.col("line").asc_nulls_last(), F.col("repo").asc_nulls_last(), F.col("path").asc_nulls_last()]
    rank = F.row_number().over(Window.partitionBy("candidate_id").orderBy(*order))
    rows = candidates.select("candidate_id", "repo", "path", "line", "score", "found_at")
    return rows.withColumn("__latest", rank).where(F.col("__latest") == 1).drop("__latest")


def best_per_file(candidates: DataFrame, n: int = 3) -> DataFrame:
    """For each (repo, path) the first ``n`` candidates by score descending, line ascending (null last) and id.

    A candidate counts once, with its latest row; one whose latest row has a null repo
    or path or a null or NaN score is left out, even if an older row had a score.
    """
    usable = current_candidates(candidates).where(
        F.col("repo").isNotNull() & F.col("path").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score")
    )
    order = [F.col("score").desc(), F.col("line").asc_nulls_last(), F.col("candidate_id").asc()]
    return top_n(usable, ["repo", "path"], order, n, spread=F.col("candidate_id"))
