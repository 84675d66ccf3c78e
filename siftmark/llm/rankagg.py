"""One ranking from channels whose scores have unlike scales: robust rank aggregation.

Every channel's scores become normalised ranks, so only their order counts. For an
item found at normalised ranks r_1 <= ... <= r_m (1 where a channel did not find it)
the k-th one is compared with what m random rankings would give: P(r_(k) <= x) is a
beta order statistic, equal to P(Binomial(m, x) >= k). The least of the m
probabilities, corrected for their number, is the item's significance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.runtime import cut

#: Rows of one list that are ranked in one task; longer lists are cut into score ranges.
RANGE_ROWS = 200_000
#: Most requests whose sizes (three numbers each) are broadcast; those of more are joined.
SMALL = 200_000


def _tidy(name: Column) -> Column:
    return F.lower(F.trim(name))


def channel_scores(raw: DataFrame, channels: DataFrame) -> DataFrame:
    """(request_id, repo, path, line, channel, score): usable scores, turned so that higher is better.

    A row counts for each channel in ``found_by``; where that is null, empty or holds
    only nulls and blanks, ``kind`` names the channel. Names compare trimmed and in
    lower case. Rows of channels or kinds that ``channels`` does not list have no
    direction and are left out, as are null and NaN scores. Null ``higher_is_better``
    means high is good.
    """
    listed = channels.select(_tidy(F.col("channel")).alias("channel"), _tidy(F.col("kind")).alias("of_kind"), F.coalesce("higher_is_better", F.lit(True)).alias("up"))
    known = [(r.channel, r.of_kind, r.up) for r in listed.collect() if r.channel]
    if not known:
        return raw.select("request_id", "repo", "path", "line", F.lit("").alias("channel"), F.col("score").cast("double").alias("score")).limit(0)
    pairs = lambda items: F.create_map(*[F.lit(x) for kv in items.items() for x in kv])
    by_kind = pairs({k: c for c, k, _ in known if k} or {"": ""})
    up = pairs({c: u for c, _, u in known})
    names = F.filter(F.transform(F.coalesce("found_by", F.array().cast("array<string>")), _tidy), lambda x: x.isNotNull() & (x != ""))
    by = F.when(F.size(names) > 0, F.array_distinct(names)).otherwise(F.array(F.try_element_at(by_kind, _tidy(F.col("kind")))))
    rows = raw.where(F.col("score").isNotNull() & ~F.isnan("score")).select("request_id", "repo", "path", "line", F.explode(by).alias("channel"), "score")
    direction = F.try_element_at(up, F.col("channel"))
    score = F.when(direction, F.col("score")).otherwise(-F.col("score")).cast("double") + F.lit(0.0)
    return rows.where(direction.isNotNull()).withColumn("score", score)


def normalised_ranks(scores: DataFrame, list_keys: list[str], item_keys: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``place``: the mean rank (1 is best, ties share it) of every item in its list, by ``score`` descending.

    Exact however long a list is: equal scores are counted first; lists with more than
    ``range_rows`` distinct scores are cut into score ranges at approximate quantiles,
    each range is ranked on its own and shifted by what lies above it.
    """
    values = scores.groupBy(*list_keys, "score").agg(F.count("*").alias("__n"))
    shape = values.groupBy(*list_keys).agg(F.count("*").alias("__d"), F.percentile_approx("score", [i / 64 for i in range(1, 64)], 1000).alias("__cuts"))
    shape = shape.select(*list_keys, F.when(F.col("__d") > range_rows, F.array_distinct("__cuts")).otherwise(F.array().cast("array<double>")).alias("__cuts"))
    values = values.join(shape, list_keys)
    values = cut(values.withColumn("__range", F.size(F.filter("__cuts", lambda c: c <= F.col("score")))).drop("__cuts"))
    above = Window.partitionBy(*list_keys).orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = values.groupBy(*list_keys, "__range").agg(F.sum("__n").alias("__m")).withColumn("__above", F.coalesce(F.sum("__m").over(above), F.lit(0))).drop("__m")
    inside = Window.partitionBy(*list_keys, "__range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(ranges, [*list_keys, "__range"])
    place = F.col("__above") + F.col("__before") + (F.col("__n") + 1) / 2
    placed = values.select(*list_keys, "score", place.alias("place"))
    return scores.join(placed, [*list_keys, "score"]).select(*list_keys, *item_keys, "place")


def _short_places(scores: DataFrame, list_keys: list[str], item_keys: list[str]) -> DataFrame:
    """``place`` as of ``normalised_ranks`` where every list fits one task: the best score of each item, ranked after one shuffle by list."""
    spread = scores.repartition(*list_keys)
    best = spread.groupBy(*list_keys, *item_keys).agg(F.max("score").alias("score"))
    order = Window.partitionBy(*list_keys).orderBy(F.col("score").desc())
    ties = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return best.select(*list_keys, *item_keys, (F.rank().over(order) + (ties - 1) / 2).alias("place"))


def places(scores: DataFrame, sizes: DataFrame, list_keys: list[str], item_keys: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``place`` of every item in its list: exact in lists of any length, equal items of a list count with their best score.

    ``sizes`` (list keys, ``rows``) tells the lists with more than ``range_rows`` rows, which
    are ranked in score ranges; all others are ranked after one shuffle.
    """
    long = sizes.where(F.col("rows") > range_rows).select(*list_keys)
    if long.isEmpty():
        return _short_places(scores, list_keys, item_keys)
    here = scores.join(long, list_keys, "left_semi").groupBy(*list_keys, *item_keys).agg(F.max("score").alias("score"))
    rest = scores.join(long, list_keys, "left_anti")
    return _short_places(rest, list_keys, item_keys).unionByName(normalised_ranks(cut(here), list_keys, item_keys, range_rows))


def significance(ranks: Column, channels: Column) -> Column:
    """The corrected minimum of the beta order-statistic probabilities of sorted ``ranks`` out of ``channels`` lists, as its logarithm.

    Ranks not present are 1 and have probability 1. Only sums of positive terms, so very
    small probabilities keep their digits; the logarithm is rounded to nine places, so
    they do so in the order too. A significance of 1 is 0.
    """

    def at_least(k: Column, x: Column) -> Column:
        choose = lambda j: F.aggregate(F.sequence(F.lit(1), F.greatest(j, F.lit(1))), F.lit(1.0), lambda a, i: F.when(j > 0, a * (channels - j + i) / i).otherwise(a))
        term = lambda j: choose(j) * F.pow(x, j) * F.pow(1 - x, channels - j)
        return F.aggregate(F.sequence(k, channels.cast("int")), F.lit(0.0), lambda a, j: a + term(j))

    p = F.transform(F.array_sort(ranks), lambda x, i: at_least((i + 1).cast("int"), x))
    return F.round(F.ln(F.greatest(F.least(F.lit(1.0), F.array_min(p) * channels), F.lit(1e-300))), 9)


def aggregate_ranks(scores: DataFrame, request: str = "request_id", item: tuple[str, ...] = ("repo", "path", "line"), top: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Items of each request in one ranking: ``significance`` (logarithm, least first), ``mean_rank``, ``found`` (lists that have it), ``rank``.

    ``scores`` as of ``channel_scores``. Several scores of an item in one channel count
    as the best of them. A normalised rank is the place divided by the number of
    different items of the request, whatever the length of the channel's list, so all
    channels weigh the same. Order: significance, mean normalised rank (missing as 1),
    then the item's columns ascending with null last; it is total. ``top`` keeps the
    first rows of each request. Null items are items like others.

    Every score is shuffled twice, by list to be ranked and by item to meet its other
    ranks; sizes are counted beside it in small tables.
    """
    items = list(item)
    lists = cut(scores.groupBy(request, "channel").agg(F.count("*").alias("rows")))
    placed = places(scores, lists, [request, "channel"], items, range_rows)
    found = cut(placed.groupBy(request, *items).agg(F.collect_list("place").alias("places")))
    channels = lists.groupBy(request).agg(F.count("*").cast("int").alias("channels"))
    count = cut(found.groupBy(request).agg(F.count("*").alias("items")).join(channels, request))
    rows = found.join(F.broadcast(count) if count.count() <= SMALL else count, request)
    ranks = F.transform("places", lambda p: p / F.col("items"))
    mean = (F.aggregate(F.array_sort("ranks"), F.lit(0.0), lambda a, r: a + r) + F.col("channels") - F.size("ranks")) / F.col("channels")
    rows = rows.withColumn("ranks", ranks).select(request, *items, F.size("ranks").alias("found"), significance(F.col("ranks"), F.col("channels")).alias("significance"), F.round(mean, 12).alias("mean_rank"))
    order = Window.partitionBy(request).orderBy("significance", "mean_rank", *[F.col(c).asc_nulls_last() for c in items])
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top) if top else ranked
