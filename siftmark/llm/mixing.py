"""Sources mixed to target shares of all tokens, small ones repeated up to a cap.

Every document gets an exponential key divided by its quality weight (weighted sampling
without replacement after Efraimidis and Spirakis): the order of the keys within a
source is a weighted random order. A source first goes through as many complete epochs
as its budget holds; the documents of the rest are the first in that order whose
running total of tokens fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.llm.bpe import VOCABULARY, count_tokens
from siftmark.runtime import cut

#: Ranges of the keys that running totals are taken in, so that no source is one task.
RANGES = 1024
#: Most wanted sources that are compared as a list; more of them are joined.
NAMES = 10_000


def letter_share(text: Column) -> Column:
    """A plain quality weight between 0.1 and 1: the part of the characters that are letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.greatest(F.lit(0.1), F.coalesce(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.1)))


def _name(c: Column) -> Column:
    return F.lower(F.trim(c))


def sized_documents(documents: DataFrame, *, weight: Column | None = None, seed: int = 17, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, key): every document with a source and at least one token; names in lower case and trimmed.

    The key comes from a hash of ``doc_id`` and ``seed``: another run draws the same.
    Null, non-positive and NaN weights count as the least, 0.1.
    """
    w = weight if weight is not None else letter_share(F.col("text"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    good = F.when((w > 0) & ~F.isnan(w), w).otherwise(0.1)
    rows = documents.where(F.col("source").isNotNull()).select("doc_id", _name(F.col("source")).alias("source"), (-F.log(u) / good).alias("key"), "text")
    return count_tokens(rows, "text", vocabulary=vocabulary).where(F.col("tokens") > 0)


def targets(mix: DataFrame) -> DataFrame:
    """(source, weight, max_repeats) of the wanted sources: names trimmed and in lower case, weights positive.

    A null, NaN or non-positive weight means not wanted; a null or non-positive
    ``max_repeats`` means 1. Of several rows of a source the one with the highest weight
    (then the highest cap) counts.
    """
    rows = mix.where((F.col("weight") > 0) & ~F.isnan("weight") & F.col("source").isNotNull())
    cap = F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))
    rows = rows.select(_name(F.col("source")).alias("source"), F.struct(F.col("weight").cast("double").alias("weight"), cap.alias("max_repeats")).alias("x"))
    return rows.groupBy("source").agg(F.max("x").alias("x")).select("source", "x.*")


def budgets(sized: DataFrame, wanted: DataFrame, total: int | None = None, *, exact: bool = False) -> DataFrame:
    """One row for each wanted source: available tokens, target share, budget, complete epochs and the rest to draw.

    Shares are those of the weights among the sources that have documents; a source
    without any has share 0 and stays in the report. ``total`` is the size of the
    collection in tokens, by default all tokens of the wanted sources. A source that
    cannot give its share even at its cap of repeats gives all its repeats; what is
    missing is shared among the other sources by their weights, so the total is missed
    only where every source is at its cap. ``exact`` asks for unshifted targets instead:
    the greatest size, up to ``total``, at which no source is over its cap, however
    little a scarce source leaves of the others.
    """
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    rows = wanted.join(have, "source", "left").withColumns({"available": F.coalesce("available", F.lit(0)), "documents": F.coalesce("documents", F.lit(0))})
    everything = Window.partitionBy()  # as many rows as there are sources in the target table
    usable = F.when(F.col("available") > 0, F.col("weight"))
    cap = (F.col("available") * F.col("max_repeats")).cast("double")
    rows = rows.withColumns({"target_share": F.coalesce(usable / F.sum(usable).over(everything), F.lit(0.0)), "__cap": cap})
    size = F.lit(float(total)) if total is not None else F.sum("available").over(everything).cast("double")
    # tokens for each unit of share at which a source reaches its cap; sources reach it in this order
    rows = rows.withColumns({"__full": F.when(F.col("target_share") > 0, F.col("__cap") / F.col("target_share")), "__size": size})
    if exact:
        level = F.least(F.min("__full").over(everything), F.col("__size"))
    else:
        order = Window.partitionBy().orderBy(F.col("__full").asc_nulls_last(), "source")
        capped = F.coalesce(F.sum(F.when(F.col("target_share") > 0, F.col("__cap"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        left = F.sum("target_share").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        rows = rows.withColumn("__level", F.when(F.col("target_share") > 0, (F.col("__size") - capped) / left))
        level = F.min(F.when(F.col("__full") > F.col("__level"), F.struct("__full", "source", "__level"))).over(everything)["__level"]
    quota = F.least(F.col("target_share") * F.coalesce(level, F.lit(float("inf"))), F.col("__cap"))
    quota = F.when(F.col("target_share") > 0, quota).otherwise(0.0)
    rows = rows.withColumn("budget", F.floor(quota + 1e-6).cast("bigint")).drop("__cap", "__full", "__size", "__level")
    epochs = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int")
    return rows.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))


def mix_sources(sized: DataFrame, plan: DataFrame, *, ranges: int = RANGES) -> DataFrame:
    """(doc_id, source, tokens, repeats): the documents of the collection and how often each is used.

    The draw within a source goes by key, then ``doc_id``. Running totals are taken within
    ranges of keys and shifted by the totals of the ranges before, so a source with a
    third of all documents is not one task. The last document is taken if half of it
    fits: a budget is missed by half a document at most.
    """
    rows = sized.join(plan.where(F.col("budget") > 0).select("source", "epochs", "rest"), "source")
    span = F.least(F.floor((1 - F.exp(-F.col("key") * 0.7)) * ranges), F.lit(ranges - 1)).cast("int")
    rows = rows.withColumn("span", span)
    before = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("source", "span").agg(F.sum("tokens").alias("n")).withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("source", "span").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(spans, ["source", "span"]).withColumn("start", F.col("below") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    more = (F.col("start") + F.col("tokens") / 2 <= F.col("rest")).cast("int")
    return rows.withColumn("repeats", F.col("epochs") + more).where(F.col("repeats") > 0).select("doc_id", "source", "tokens", "repeats")


def mixed(documents: DataFrame, mix: DataFrame, *, total: int | None = None, exact: bool = False, weight: Column | None = None, seed: int = 17, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(collection, report): ``mix_sources`` and, for every wanted source, what was asked for and what was reached.

    Documents of sources that are not wanted are left out before they are tokenized.
    """
    wanted = cut(targets(mix))
    names = [r.source for r in wanted.select("source").limit(NAMES + 1).collect()]
    source = _name(F.col("source"))
    if len(names) <= NAMES:
        rows = documents.where(source.isin(names))
    else:
        rows = documents.join(wanted.select(F.col("source").alias("__wanted")), source == F.col("__wanted"), "left_semi")
    sized = cut(sized_documents(rows, weight=weight, seed=seed, vocabulary=vocabulary))
    plan = cut(budgets(sized, wanted, total, exact=exact))
    taken = mix_sources(sized, plan)
    got = taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("reached"), F.count("*").alias("used"), F.max("repeats").alias("most_repeats"))
    rows = plan.join(got, "source", "left")
    reached = F.coalesce("reached", F.lit(0))
    share = F.coalesce(reached / F.nullif(F.sum(reached).over(Window.partitionBy()), F.lit(0)), F.lit(0.0))
    report = rows.select(
        "source", "weight", "max_repeats", "documents", "available", "target_share", "budget", reached.alias("reached"), share.alias("reached_share"), F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats")
    )
    return taken, report
