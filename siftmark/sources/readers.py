"""Sources: file trees, Git logs and metric files as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.functions.text import basename, safe_name, split_lines, suffix
from siftmark.operators.corpus import MAX_BYTES, admitted
from siftmark.runtime import ship


def file_tree(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """(repo, path, blob, content, size) of a folder's text files; the size limit is applied before contents are read.

    Files with a zero byte in the first 8,192 are binary and left out, as are ignored
    folders and sensitive names.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MAX_BYTES)
    base = root.rstrip("/").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), rf"^\Q{base}/\E", "")
    rows = rows.select(F.lit(repo).alias("repo"), path.alias("path"), "content", F.col("length").alias("size"))
    rows = rows.where(admitted()).where(~F.hex(F.substring("content", 1, 8192)).rlike("^(..)*00"))
    header = F.concat(F.lit("blob "), F.octet_length("content").cast("string")).cast("binary")
    return rows.select("repo", "path", F.sha1(F.concat(header, F.unhex(F.lit("00")), F.col("content"))).alias("blob"), F.decode("content", "UTF-8").alias("content"), "size")


def metric_events(spark: SparkSession, path: str, tail: int | None = None) -> DataFrame:
    """(event, metric, value) of all ``*_ms`` numbers in JSON lines, of the last ``tail`` lines if told; malformed lines are skipped.

    Lines follow each other by the time their file was written, its name and their place in it.
    """
    lines = spark.read.text(path)
    if tail is not None:
        at = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
        lines = lines.select("value", at.alias("__at")).orderBy(F.col("__at").desc()).limit(tail).select("value")
    row = F.from_json("value", "map<string,string>")
    pairs = lines.select(row["event"].alias("event"), F.explode(F.map_entries(row)).alias("kv"))
    return pairs.where(F.col("kv.key").endswith("_ms")).select("event", F.col("kv.key").alias("metric"), F.col("kv.value").try_cast("double").alias("value")).where(F.col("value").isNotNull())


def append_metrics(rows: DataFrame, path: str) -> None:
    """Metric events appended as JSON lines."""
    rows.write.mode("append").json(path)


def snapshot_export(rows: DataFrame, root: str, repo: str, sha: str) -> str:
    """A snapshot's files written once under its commit id; one that is there already stays as it is."""
    target = f"{root}/repo={repo}/sha={sha}"
    rows.write.mode("ignore").parquet(target)
    return target


# Kinds of evidence from outside, what is read as text, and the largest file.
OUTSIDE_KINDS = ("document", "log", "note", "runtime")
TEXT_SUFFIXES = "conf csv html htm json log md properties txt xml yaml yml".split()
OUTSIDE_BYTES = 20 * 1024 * 1024


def outside_evidence(spark: SparkSession, folder: str, ticket: str, kind: str = "document") -> DataFrame:
    """(ticket, kind, path, line_start, line_end, digest, is_text, content, score) of files that somebody handed in for a ticket.

    Names are safe names; larger files are left out before they are read. A file that is no
    text by its suffix is known by name and digest, without content.
    """
    if kind not in OUTSIDE_KINDS:
        raise ValueError("kind has to be one of " + ", ".join(OUTSIDE_KINDS))
    rows = spark.read.format("binaryFile").load(folder).where(F.col("length") <= OUTSIDE_BYTES)
    is_text = suffix(F.col("path")).isin(*TEXT_SUFFIXES)
    content = F.when(is_text, F.try_validate_utf8(F.decode("content", "UTF-8")))
    rows = rows.select(F.lit(ticket).alias("ticket"), F.lit(kind).alias("kind"), safe_name(basename(F.col("path"))).alias("path"), F.sha2("content", 256).alias("digest"), is_text.alias("is_text"), content.alias("content"))
    lines = F.greatest(F.lit(1), F.size(split_lines(F.coalesce("content", F.lit("")))))
    return rows.select("ticket", "kind", "path", F.lit(1).alias("line_start"), lines.alias("line_end"), "digest", "is_text", "content", F.lit(100.0).alias("score"))


def flattened(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, fields): every object within a JSON payload at any depth, as a map of its plain fields to texts.

    Texts that hold JSON are read too. A list as long as the nearest ``columns`` or ``cols``
    above it, of plain values, is a row with these names. Malformed payloads give nothing.
    The depth is not known beforehand, so this walks in Python over Arrow batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        def plain(v) -> str:
            return v if isinstance(v, str) else json.dumps(v)

        def load(text: str):
            try:
                return json.loads(text)
            except ValueError:
                return None

        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch[payload]):
                todo = [(load(text), None)] if isinstance(text, str) else []
                while todo:
                    value, columns = todo.pop()
                    if isinstance(value, dict):
                        out.append((k, {n: plain(v) for n, v in value.items() if v is not None and not isinstance(v, (dict, list))}))
                        named = value.get("columns") or value.get("cols")
                        columns = [str(c) for c in named] if isinstance(named, list) else columns
                        todo += [(v, columns) for v in value.values()]
                    elif isinstance(value, list):
                        if columns and value and len(value) == len(columns) and columns != value and not any(isinstance(v, (dict, list)) for v in value):
                            out.append((k, {n: plain(v) for n, v in zip(columns, value) if v is not None}))
                        todo += [(v, columns) for v in value]
                    elif isinstance(value, str) and value[:1] in ("{", "["):
                        todo.append((load(value), columns))
            yield pd.DataFrame(out, columns=[key, "fields"])

    ship(rows.sparkSession)
    return rows.select(key, payload).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, fields map<string,string>")


def mirror(rows: DataFrame, root: str, keys: tuple[str, ...] = ("repo", "sha")) -> None:
    """Rows into a table partitioned by ``keys``: what the rows name is replaced whole, the rest of the table stays."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(root)


def local_diffs(diffs: DataFrame) -> DataFrame:
    """Evidence of what is changed in working trees and not committed: ``diffs`` has repo, unstaged and staged text; blank ones give none."""
    parts = F.filter(F.array(*[F.trim(F.coalesce(c, F.lit("")), F.lit(" \t\r\n")) for c in ("unstaged", "staged")]), lambda t: t != "")
    rows = diffs.select("repo", F.array_join(parts, "\n").alias("content")).where(F.col("content") != "")
    lines = F.length("content") - F.length(F.translate("content", "\n", "")) + 1
    return rows.select("repo", F.lit("(working tree diff)").alias("path"), F.lit(1).alias("line_start"), lines.alias("line_end"), F.lit("local diff").alias("kind"), F.lit(100.0).alias("score"), F.array(F.lit("working tree")).alias("found_by"), "content")
