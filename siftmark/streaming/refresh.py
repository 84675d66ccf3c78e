"""Refresh and sessions as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmark.functions.keys import clean_path
from siftmark.runtime import ship


KEY = ["repo", "path"]


def _resolved(rows: DataFrame) -> DataFrame:
    """(snapshot, repo, path, row): of each snapshot and path the row of the latest delivery, with its time and blob."""
    return rows.groupBy("snapshot", *KEY).agg(F.max("row").alias("row")).withColumn("blob", F.col("row.blob"))


def _changes(resolved: DataFrame) -> DataFrame:
    """(snapshot, repo, path, blob): entries whose blob is not that of the snapshot before; unread files change nothing."""
    before = F.lag("blob").over(Window.partitionBy(*KEY).orderBy("snapshot"))
    rows = resolved.where(F.col("blob").isNotNull()).withColumn("__last", before)
    return rows.where(~F.col("blob").eqNullSafe(F.col("__last"))).select("snapshot", *KEY, "blob")


def refresh(stream: DataFrame, target: str, checkpoint: str, *, once: bool = True, seconds: int = 180):
    """Keep a parquet folder of changes up to date; each batch writes only what the folder lacks.

    Deliveries are resolved per snapshot first, also against those of earlier batches, which
    are kept in ``entries`` under ``checkpoint``. A (repo, clean path) gets a row whenever its
    blob differs from the one before it by snapshot, so a return to an old blob is a row. A late
    delivery that replaces a row already written is written under the same snapshot in its own
    ``batch`` (a null blob, if it says that the file was not read): of equal snapshots the greatest batch counts.

    ``once`` handles what is there and stops. A repeated batch writes the same rows into the same folder.
    """
    kept = f"{checkpoint}/entries"

    def write(batch: DataFrame, number: int) -> None:
        rows = _resolved(
            batch.where(F.col("snapshot").isNotNull()).select(
                F.col("snapshot").cast("int").alias("snapshot"),
                F.col("repo").cast("string").alias("repo"),
                clean_path(F.col("path")).alias("path"),
                F.struct(F.col("delivered_at").alias("at"), F.lower("blob").alias("blob")).alias("row"),
            )
        ).select("snapshot", *KEY, "row")
        rows.write.mode("overwrite").parquet(f"{kept}/batch={number}")
        read = batch.sparkSession.read.schema(rows.schema.add("batch", "long")).parquet(kept).where(F.col("batch") <= number)
        keys = read.where(F.col("batch") == number).select(*[F.col(c).alias(f"__{c}") for c in KEY]).distinct()
        known = read.join(keys, F.col("repo").eqNullSafe(F.col("__repo")) & F.col("path").eqNullSafe(F.col("__path")), "left_semi")
        then, now = _resolved(known.where(F.col("batch") < number)), _resolved(known)
        old, new = _changes(then), _changes(now)
        same = lambda a, b, columns: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]
        replaced = now.alias("n").join(old.alias("o"), same("n", "o", ["snapshot", *KEY]), "left_semi").select("snapshot", *KEY, "blob")
        out = new.union(replaced).distinct()
        out = out.alias("n").join(old.alias("o"), same("n", "o", ["snapshot", *KEY, "blob"]), "left_anti")
        out.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=f"{seconds} seconds").start()


def windowed_counts(stream: DataFrame, time: str, group: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per tumbling window and group; rows later than ``late`` are left out."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), group, "n")


def session_rounds(stream: DataFrame) -> DataFrame:
    """(ticket, number, new_evidence, no_progress, duplicate): the state of each ticket's session after every round.

    ``stream`` has ticket, number, signature and evidence (keys). The state of a ticket is
    the evidence and signatures seen so far, as 64-bit digests; a plan seen before is
    flagged and changes nothing. The state grows with the evidence of a session, not with its rounds.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        columns = ["ticket", "number", "new_evidence", "no_progress", "duplicate"]
        seen, plans, idle = state.get if state.exists else ([], [], 0)
        seen, plans = set(seen), set(plans)
        out = []
        rows = pd.concat(list(frames)).sort_values("number")
        for number, signature, evidence in zip(rows["number"], rows["plan"], rows["keys"]):
            if signature in plans:
                out.append((key[0], number, 0, idle, True))
                continue
            new = set(evidence.tolist() if evidence is not None else ()) - seen
            idle = 0 if new else idle + 1
            seen |= new
            plans.add(signature)
            out.append((key[0], number, len(new), idle, False))
        state.update((sorted(seen), sorted(plans), idle))
        yield pd.DataFrame(out, columns=columns)

    ship(stream.sparkSession)
    rows = stream.select("ticket", "number", F.xxhash64("signature").alias("plan"), F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: F.xxhash64(e)).alias("keys"))
    return rows.groupBy("ticket").applyInPandasWithState(
        step, "ticket string, number int, new_evidence int, no_progress int, duplicate boolean", "seen array<bigint>, plans array<bigint>, idle int", "append", "NoTimeout"
    )
