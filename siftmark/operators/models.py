"""What tells whether a model runtime may be used, and how: conformance of its vectors and scores, and sizes tuned by measured runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.functions.text import cosine

# What a batch may differ from single calls, and a vector from length 1.
PARITY, LENGTH_SLACK = 1e-4, 1e-3
# Sizes that are tried, and the 95th percentile of milliseconds that a pool may take.
BATCHES, POOLS, BUDGET_MS = (1, 8, 16), (10, 20, 40, 80), 3000.0
#: Query vectors that a cache keeps.
QUERIES_KEPT = 256


def query_key(pack: Column, dimension: Column, text: Column) -> Column:
    """The key of a query's vector: SHA-256 over pack, dimension and text with zero bytes between."""
    return F.sha2(F.concat_ws("\x00", pack, dimension.cast("string"), text), 256)


def _far(a: Column, b: Column) -> Column:
    """The greatest difference between the numbers of two vectors; null if either is null or they differ in length."""
    same = F.size(a) == F.size(b)
    return F.when(same, F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda m, x: F.greatest(m, x)))


def vector_conformance(rows: DataFrame, *, parity: float = PARITY) -> DataFrame:
    """(case, texts, parity, length, reference, order_ok, passed) of vectors made in a batch against what is expected of them.

    ``rows`` has case, position, batch, single, reference (may be null), minimum (cosine to the reference) and
    expected (place by similarity to position 0, null if none is stated). Parity: no number of a batch differs from the
    single call by more; length: every vector has length 1; order: by cosine to position 0, then position.
    """
    first = rows.where(F.col("position") == 0).select("case", F.col("batch").alias("__first"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    with_first = rows.join(first, "case", "left")
    near = F.when(F.col("position") > 0, F.round(cosine(F.col("batch"), F.col("__first")), 12))
    place = F.row_number().over(Window.partitionBy("case", F.col("position") > 0).orderBy(near.desc(), "position"))
    each = with_first.select(
        "case",
        (F.coalesce(_far(F.col("batch"), F.col("single")) <= parity, F.lit(False))).alias("parity"),
        (F.abs(norm(F.col("batch")) - 1) <= LENGTH_SLACK).alias("length"),
        (F.col("reference").isNull() | (cosine(F.col("batch"), F.col("reference")) >= F.coalesce("minimum", F.lit(0.0)))).alias("reference"),
        (F.col("expected").isNull() | (F.col("position") == 0) | (place == F.col("expected"))).alias("order_ok"),
    )
    checks = ["parity", "length", "reference", "order_ok"]
    cases = each.groupBy("case").agg(F.count("*").alias("texts"), *[F.bool_and(F.coalesce(c, F.lit(False))).alias(c) for c in checks])
    return cases.withColumn("passed", F.col("parity") & F.col("length") & F.col("reference") & F.col("order_ok"))


def score_conformance(rows: DataFrame, *, parity: float = PARITY) -> DataFrame:
    """(case, documents, parity, delta, top_ok, passed) of scores given in a batch: against single calls, a reference and the document that has to be first.

    ``rows`` has case, position, batch, single, reference and maximum (both may be null) and top (the expected first position).
    """
    order = Window.partitionBy("case").orderBy(F.col("batch").desc(), "position")
    finite = F.col("batch").isNotNull() & ~F.isnan("batch") & (F.abs("batch") < float("inf"))
    each = rows.withColumn("__n", F.row_number().over(order)).select(
        "case",
        (finite & (F.abs(F.col("batch") - F.col("single")) <= parity)).alias("parity"),
        (F.col("reference").isNull() | (F.abs(F.col("batch") - F.col("reference")) <= F.coalesce("maximum", F.lit(0.0)))).alias("delta"),
        ((F.col("__n") > 1) | (F.col("position") == F.col("top"))).alias("top_ok"),
    )
    checks = ["parity", "delta", "top_ok"]
    cases = each.groupBy("case").agg(F.count("*").alias("documents"), *[F.bool_and(F.coalesce(c, F.lit(False))).alias(c) for c in checks])
    return cases.withColumn("passed", F.col("parity") & F.col("delta") & F.col("top_ok"))


def tuned_batch(samples: DataFrame) -> DataFrame:
    """(pack, size, per_second): of each pack the batch size with the most texts a second, of equal ones the larger. ``samples`` has pack, size, ms."""
    rate = samples.groupBy("pack", "size").agg((F.sum("size") * 1000 / F.sum("ms")).alias("per_second"))
    best = rate.groupBy("pack").agg(F.max(F.struct(F.round("per_second", 3).alias("per_second"), "size")).alias("x"))
    return best.select("pack", "x.size", "x.per_second")


def tuned_pool(samples: DataFrame, budget_ms: float = BUDGET_MS) -> DataFrame:
    """(pack, size): of each pack the largest pool whose 95th percentile is within the budget, else the smallest tried. ``samples`` has pack, size, ms."""
    late = samples.groupBy("pack", "size").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95"))  # a handful of samples each
    return late.groupBy("pack").agg(F.coalesce(F.max(F.when(F.col("p95") <= budget_ms, F.col("size"))), F.min("size")).alias("size"))
