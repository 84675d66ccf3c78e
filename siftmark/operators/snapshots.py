"""What changed between consecutive full snapshots of a keyed table.

Snapshots are mostly equal, so the comparison works on chunks of the key-sorted
rows. Chunk borders are chosen by the keys themselves (a key whose hash falls in a
fixed residue class opens a chunk), so an inserted or removed row moves no border
but its own. Chunks whose digests agree in both snapshots are discarded where they
are read; only the rows of the other chunks are shuffled again and joined by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmark.functions.keys import clean_path, fingerprint
from siftmark.runtime import ship

CHUNK_ROWS = 64


def latest_entries(files: DataFrame) -> DataFrame:
    """(snapshot, repo, path, blob): the row of the latest delivery for each key.

    ``path`` is the clean path and ``blob`` is in lower case. Of rows with the same
    ``delivered_at`` the one with the greatest blob counts (null is the least), so
    repeated rows change nothing. Rows without a snapshot number belong to no
    snapshot and are left out; a null repo or path is a key value equal only to null.
    The aggregate combines before the shuffle: a key delivered very often is no hot spot.
    """
    rows = files.where(F.col("snapshot").isNotNull()).select(
        F.col("snapshot").cast("int").alias("snapshot"),
        F.col("repo").cast("string").alias("repo"),
        clean_path(F.col("path")).alias("path"),
        F.struct(F.col("delivered_at").alias("at"), F.lower(F.col("blob")).alias("blob")).alias("row"),
    )
    best = rows.groupBy("snapshot", "repo", "path").agg(F.max("row").alias("row"))
    return best.select("snapshot", "repo", "path", F.col("row.blob").alias("blob"))


def entries_by_key(files: DataFrame, snapshots: list[int]) -> DataFrame:
    """``latest_entries`` of the given snapshots with all entries of a (repo, path) side by side, after one shuffle.

    The deliveries of a key are combined before the shuffle, one row for each snapshot; so
    the rows come out in place for ``snapshot_changes(placed=True)``.
    """
    row = F.struct(F.col("delivered_at").alias("at"), F.lower(F.col("blob")).alias("blob"))
    rows = files.where(F.col("snapshot").isin(snapshots)).select(F.col("repo").cast("string").alias("repo"), clean_path(F.col("path")).alias("path"), *[F.when(F.col("snapshot") == s, row).alias(f"s{s}") for s in snapshots])
    best = rows.groupBy("repo", "path").agg(*[F.max(f"s{s}").alias(f"s{s}") for s in snapshots])
    each = F.array(*[F.when(F.col(f"s{s}").isNotNull(), F.struct(F.lit(s).alias("snapshot"), F.col(f"s{s}.blob").alias("blob"))) for s in snapshots])
    return best.select("repo", "path", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select(F.col("x.snapshot").cast("int").alias("snapshot"), "repo", "path", F.col("x.blob").alias("blob"))


def _unmatched(pairs: list[tuple[int, int]], chunk_rows: int, columns: list[str]):
    """A function over the Arrow batches of one key range: the rows of chunks that differ, once for each pair and side."""
    known = sorted({s for p in pairs for s in p})
    slot = {s: i for i, s in enumerate(known)}

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        snap = rows["snapshot"].to_numpy()
        at = np.searchsorted(known, snap)
        key = rows["__key"].to_numpy()
        fresh = np.empty(len(key), bool)
        fresh[0] = True
        fresh[1:] = (key[1:] != key[:-1]) & (key[1:] % chunk_rows == 0)
        cell = (np.cumsum(fresh) - 1) * len(known) + at
        size = int(cell.max()) // len(known) + 1
        shape = (size, len(known))
        digest = []
        for name in ("__left", "__right"):
            total = np.zeros(size * len(known), np.uint64)
            np.add.at(total, cell, rows[name].to_numpy().view(np.uint64))
            digest.append(total.reshape(shape))
        digest.append(np.bincount(cell, minlength=size * len(known)).reshape(shape))
        chunk = cell // len(known)
        for before, after in pairs:
            a, b = slot[before], slot[after]
            differs = np.zeros(size, bool)
            for d in digest:
                differs |= d[:, a] != d[:, b]
            picked = np.flatnonzero(differs[chunk] & ((snap == before) | (snap == after)))
            if len(picked):
                part = rows.take(pa.array(picked))
                arrays = [pa.array(np.full(len(picked), after, np.int32)), pa.array(snap[picked] == after)]
                arrays += [part[c].combine_chunks() for c in columns]
                yield from pa.table(arrays, names=["pair", "is_new", *columns]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(batch.schema.get_field_index("__key")).to_numpy()
            last = held[-1] if held else None
            before = last.column(last.schema.get_field_index("__key"))[-1].as_py() if last is not None else None
            opens = (key % chunk_rows == 0) & np.concatenate([[before is not None and key[0] != before], key[1:] != key[:-1]])
            at = np.flatnonzero(opens)
            if not len(at):
                held.append(batch)
                continue
            if held or at[-1]:
                yield from settle(pa.Table.from_batches([*held, batch.slice(0, at[-1])]))
            held = [batch.slice(at[-1])]
        if held:
            yield from settle(pa.Table.from_batches(held))

    return run


def snapshot_changes(entries: DataFrame, pairs: list[tuple[int, int]], *, keys: tuple[str, ...] = ("repo", "path"), value: str = "blob", chunk_rows: int = CHUNK_ROWS, placed: bool = False) -> DataFrame:
    """Rows added, removed or changed from the first to the second snapshot of each pair.

    ``entries`` holds each key at most once in a snapshot. Result: ``snapshot`` (the
    second of the pair), the keys, ``change`` (``added``, ``removed``, ``changed``),
    ``old`` and ``new`` value. Null is a key and a value equal only to null. A snapshot
    that has no rows is an empty one. Extra columns are ignored; an empty table gives
    an empty result.

    All snapshots of a key have to lie in one task, where they are sorted by key, so chunks
    are compared where they are made; no window or group ever holds more than a chunk. One
    shuffle by key does that, unless the entries are ``placed`` so already.
    """
    ship(entries.sparkSession)
    wanted = sorted({s for p in pairs for s in p})
    left, right = fingerprint(*[F.col(k) for k in keys], F.col(value))
    rows = entries.where(F.col("snapshot").isin(wanted)).select(
        F.col("snapshot").cast("int").alias("snapshot"), *keys, value, F.xxhash64(*keys).alias("__key"), left.alias("__left"), right.alias("__right")
    )
    rows = (rows if placed else rows.repartition(*keys)).sortWithinPartitions(*keys)
    columns = [*keys, value]
    schema = T.StructType([T.StructField("pair", T.IntegerType()), T.StructField("is_new", T.BooleanType()), *[entries.schema[c] for c in columns]])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    loose = rows.mapInArrow(_unmatched(pairs, chunk_rows, columns), schema)
    merged = loose.groupBy("pair", *keys).agg(
        F.bool_or(~F.col("is_new")).alias("was"),
        F.bool_or("is_new").alias("is"),
        F.max(F.when(~F.col("is_new"), F.col(value))).alias("old"),
        F.max(F.when(F.col("is_new"), F.col(value))).alias("new"),
    )
    change = F.when(~F.col("was"), "added").when(~F.col("is"), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return merged.select(F.col("pair").alias("snapshot"), *keys, change.alias("change"), "old", "new").where(F.col("change").isNotNull())


def consecutive(snapshots: list[int]) -> list[tuple[int, int]]:
    """(s - 1, s) for every s but the lowest number."""
    return [(s - 1, s) for s in sorted(set(snapshots))[1:]]
