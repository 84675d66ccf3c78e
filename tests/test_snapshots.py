"""Snapshot comparison against a plain comparison of dictionaries."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siftmark.operators.snapshots import consecutive, entries_by_key, latest_entries, snapshot_changes

SCHEMA = "snapshot int, delivered_at timestamp, repo string, path string, blob string"
T0 = datetime(2025, 1, 1)


def plain(rows, snapshots):
    """The wanted changes, by dictionaries."""
    clean = lambda p: None if p is None else p.replace("\\", "/").removeprefix("./")
    kept = {}
    for s, at, repo, path, blob in rows:
        if s is None:
            continue
        k = (s, repo, clean(path))
        v = (at is not None, at or T0, blob is not None, (blob or "").lower())
        kept[k] = max(kept.get(k, v), v)
    of = lambda s: {k[1:]: (v[3] if v[2] else None) for k, v in kept.items() if k[0] == s}
    out = set()
    for s in sorted(snapshots)[1:]:
        a, b = of(s - 1), of(s)
        for k in a.keys() | b.keys():
            if k not in a:
                out.add((s, *k, "added"))
            elif k not in b:
                out.add((s, *k, "removed"))
            elif a[k] != b[k]:
                out.add((s, *k, "changed"))
    return out


def found(spark, rows, snapshots, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    got = snapshot_changes(latest_entries(df), consecutive(snapshots), **options).select("snapshot", "repo", "path", "change").collect()
    assert len(got) == len(set(got))
    side_by_side = snapshot_changes(entries_by_key(df, snapshots), consecutive(snapshots), placed=True, **options).select("snapshot", "repo", "path", "change").collect()
    assert sorted(map(repr, side_by_side)) == sorted(map(repr, got))
    return {tuple(r) for r in got}


def test_random_snapshots(spark):
    rnd = random.Random(3)
    rows = []
    for s in (1, 2, 3, 4):
        for i in range(900):
            if rnd.random() < 0.05:
                continue
            repo = rnd.choice(["hot"] * 6 + ["a", "b", None])
            path = rnd.choice([f"d/{i}.txt", f".\\d\\{i}.txt", f"./d/{i}.txt"])
            blob = rnd.choice([None, "AB", "ab", f"x{i}"]) if rnd.random() < 0.1 else f"b{i}"
            row = (s, T0 + timedelta(minutes=rnd.randint(0, 5)), repo, path, blob)
            rows += [row] * rnd.choice([1, 1, 2])
    for size in (1, 8, 64):
        assert found(spark, rows, [1, 2, 3, 4], chunk_rows=size) == plain(rows, [1, 2, 3, 4])


def test_nulls_ties_and_late_rows(spark):
    rows = [
        (1, T0, "r", "a", "x"),
        (2, T0, "r", "a", "x"),
        (2, T0 + timedelta(hours=1), "r", "./a", "Y"),
        (1, T0, "r", "b", None),
        (2, T0, "r", "b", None),
        (1, T0, "r", "c", None),
        (2, T0, "r", "c", "z"),
        (1, T0, None, None, "k"),
        (2, T0, None, None, "K"),
        (1, None, "r", "tie", "p"),
        (1, None, "r", "tie", "q"),
        (2, T0, "r", "tie", "q"),
        (None, T0, "r", "nowhere", "q"),
    ]
    assert found(spark, rows, [1, 2]) == {(2, "r", "a", "changed"), (2, "r", "c", "changed")} == plain(rows, [1, 2])


def test_empty_tables_and_missing_snapshots(spark):
    assert found(spark, [], [1, 2]) == set()
    rows = [(2, T0, "r", f"p{i}", "x") for i in range(5)]
    assert found(spark, rows, [1, 2]) == plain(rows, [1, 2]) and len(found(spark, rows, [1, 2])) == 5
    assert {r[3] for r in found(spark, rows, [2, 3])} == {"removed"}


def test_extra_columns_and_repeated_hot_key(spark):
    rows = [(s, T0 + timedelta(seconds=i % 7), "hot", "same", f"b{i % 7}") for s in (1, 2) for i in range(3000)] + [(2, T0, "r", "x", "n")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("change", F.lit("mine")).withColumn("pair", F.lit(1)).withColumn("is_new", F.lit(True))
    got = snapshot_changes(latest_entries(df), [(1, 2)])
    assert [tuple(r) for r in got.collect()] == [(2, "r", "x", "added", None, "n")]


def test_unchanged_chunks_are_not_joined(spark):
    rows = [(s, T0, "r", f"p{i:05}", f"b{i}") for s in (1, 2) for i in range(4000)] + [(2, T0, "r", "p01000x", "n")]
    entries = latest_entries(spark.createDataFrame(rows, SCHEMA))
    assert found(spark, rows, [1, 2]) == {(2, "r", "p01000x", "added")}
    from siftmark.functions.keys import fingerprint
    from siftmark.operators.snapshots import _unmatched

    left, right = fingerprint(F.col("repo"), F.col("path"), F.col("blob"))
    keyed = entries.select("*", F.xxhash64("repo", "path").alias("__key"), left.alias("__left"), right.alias("__right")).orderBy("repo", "path").coalesce(1)
    loose = keyed.mapInArrow(_unmatched([(1, 2)], 64, ["repo", "path", "blob"]), "pair int, is_new boolean, repo string, path string, blob string")
    assert 0 < loose.count() < 2000
