"""Files that nobody wrote by hand in this project: generated, minified, copied or data stored as code.

A random forest judges every file by measures of its content (compression ratio, token
entropy, identifier lengths, comment density, the variety of its lines), by its path and
by the number of repositories that hold the same body. It learns from the files that say
themselves what they are, in a header notice; notices and whole header comments are
hidden from the measures, so the forest has to judge the rest of the file.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.operators.snapshots import latest_entries
from siftmark.runtime import cut, ship

#: Most labelled files of either class that the forest is fitted on.
SAMPLE_PER_CLASS = 10_000
TREES, DEPTH, SEED = 40, 9, 7
#: A text of that size with at most that share of letters outside of quotes is data.
DATA_CHARS, DATA_LETTERS = 300, 0.05
#: Lines in which a notice counts as a header.
HEADER_LINES = 25

# Notices of tools, minifiers and other projects, as they stand in a comment or annotation.
MADE = re.compile(
    r"(?i)code generated by|<auto-?generated|auto-?generated (?:file|by|from|code)|@generated\b|automatically (?:produced|generated|created) (?:by|from)|"
    r"automatisch (?:erzeugt|generiert)|g[ée]n[ée]r[ée]e? (?:par|automatiquement)|generad[oa] (?:por|autom)|generato (?:da|autom)|overwritten on each|"
    r"this file (?:is|was) (?:auto\w*|generated)|do not (?:edit|modify)[^a-z]*(?:$|manually|by hand|this file)"
)
COPIED = re.compile(r"(?i)\bupstream\b|released by the .* authors|maintainers\b.*\ball\b|redistribut|keep this notice|all rights reserved|permission is hereby granted")
COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|--|<!--|;|\"\"\"|''')")
ANNOTATED = re.compile(r"^\s*@(?:javax\.annotation\.)?Generated\b")
LOCKED = re.compile(r"(?i)^\W*lockfile_?version\b|^# yarn lockfile")
BANNER = re.compile(r"^\s*/\*!")
# A ticket id in the header, and what only looks like one.
TICKET = re.compile(r"\b(?!(?:UTF|SHA|ISO|RFC|AES|MD|CVE|CP|BASE)-)[A-Z]{2,8}-\d{2,}\b")
OWN = re.compile(r"(?i)internal use only|\bOWNERS\b|not generated, edit|hand-kept|hand-written|written by hand")

CONTENT_FEATURES = [
    "log_size", "compression", "entropy", "distinct_names", "name_length", "short_names", "long_names", "comment_density",
    "line_length", "longest_line", "line_variety", "digits", "spaces", "marks", "letters_unquoted", "has_content",
]
_WORDS = bytes(c for c in range(256) if chr(c).isalnum() or c == 95 or c > 127)
_DIGITS = b"0123456789"
_SPACES = b" \t\r\n"


def header_notice(text: str) -> int | None:
    """1 for a notice of a tool or another project, 0 for a sign of a person's work here, None for neither.

    Only comments and annotations in the first lines count: code that merely speaks of
    notices has none.
    """
    sign = None
    for line in text.lstrip("﻿").split("\n", HEADER_LINES)[:HEADER_LINES]:
        if BANNER.match(line) or ANNOTATED.match(line) or LOCKED.match(line):
            return 1
        if COMMENT.match(line):
            if OWN.search(line):
                sign = 0
            elif MADE.search(line) or COPIED.search(line):
                return 1
        if TICKET.search(line):
            sign = 0
    if sign is None and re.match(r"\s*-----BEGIN ", text):
        return 0
    return sign


def header_label(text: str) -> int | None:
    """The class that a file is learned as: by its header notice, else 1 for data stored as code, which carries none and is told by its form."""
    sign = header_notice(text)
    return 1 if sign is None and is_data(text) else sign


QUOTED_KEY = re.compile(r"""["']\s*:""")
_STRINGS = re.compile(r"""\"(?:[^"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'""")


def is_data(text: str) -> bool:
    """Hardly a letter outside of quotes: tables and encoded data, which no tool marks with a notice.

    A whole document of quoted keys and values is none: configuration has that form too.
    """
    if len(text) < DATA_CHARS or text.lstrip("\ufeff \t\r\n")[:1] in ("{", "[") and QUOTED_KEY.search(text):
        return False
    return unquoted_letters(text) <= DATA_LETTERS * len(text)


def unquoted_letters(text: str) -> int:
    """Bytes outside of quotes that are no digits, blanks or common signs."""
    rest = _STRINGS.sub("", text).encode("utf-8", "surrogatepass")
    return len(rest.translate(None, _DIGITS + _SPACES + b"[](){}<>,;:+-*/=.|&_"))


def body(text: str) -> str:
    """The text without its header: leading comments, and annotations and comments with a notice in the first lines."""
    lines = text.lstrip("﻿").replace("\r\n", "\n").split("\n")
    at = 0
    while at < len(lines) and (not lines[at].strip() or COMMENT.match(lines[at])):
        if BANNER.match(lines[at]) and "*/" in lines[at] and lines[at].split("*/", 1)[1].strip():
            lines[at] = lines[at].split("*/", 1)[1]
            break
        at += 1
    kept = lines[at:]
    head = [x for x in kept[:HEADER_LINES] if not ANNOTATED.match(x) and not LOCKED.match(x) and not (COMMENT.match(x) and (MADE.search(x) or COPIED.search(x) or OWN.search(x)))]
    return "\n".join([*head, *kept[HEADER_LINES:]])


def measures(text: str) -> list[float]:
    """The content features of a whole text without its header."""
    return _measured(body(text))


def _measured(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    if not size:
        return [0.0] * (len(CONTENT_FEATURES) - 1) + [1.0]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = max(1, len(lines))
    names = re.findall(rb"[A-Za-z_$][A-Za-z0-9_$]*", raw)
    count = Counter(names)
    total = max(1, len(names))
    lengths = np.fromiter(map(len, names), np.int64, len(names)) if names else np.zeros(1, np.int64)
    skeletons = raw.translate(None, _WORDS + b" \t\r").split(b"\n")
    digits = size - len(raw.translate(None, _DIGITS))
    spaces = size - len(raw.translate(None, _SPACES))
    words = size - len(raw.translate(None, _WORDS))
    letters = unquoted_letters(text)
    return [
        log2(1 + size),
        len(zlib.compress(raw, 1)) / size,
        -sum(c / total * log2(c / total) for c in count.values()),
        len(count) / total,
        float(lengths.mean()),
        float((lengths <= 2).mean()),
        float((lengths >= 20).mean()),
        sum(1 for x in lines if x.lstrip()[:2] in (b"//", b"/*", b"--", b"<!") or x.lstrip()[:1] in (b"#", b"*", b";")) / n,
        log2(1 + size / n),
        log2(1 + max(map(len, lines), default=0)),
        len({s for s in skeletons if s}) / n,
        digits / size,
        spaces / size,
        (size - words - spaces) / size,
        letters / size,
        1.0,
    ]


def blob_measures(blobs: DataFrame) -> DataFrame:
    """(blob, notice, label, body_id, features) of each stored blob, once: ids compare in lower case, repeated rows count once.

    Rows with a null id or content are left out; of different contents under one id
    that with the least body id counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["content"])
            bodies = [body(t) for t in texts]
            yield pd.DataFrame({
                "blob": batch["blob"],
                "notice": [header_notice(t) == 1 for t in texts],
                "label": pd.array([header_label(t) for t in texts], dtype="Int32"),
                "body_id": [_body_id(b) for b in bodies],
                "features": [_measured(b) for b in bodies],
            })

    ship(blobs.sparkSession)
    rows = blobs.where(F.col("blob").isNotNull() & F.col("content").isNotNull()).select(F.lower("blob").alias("blob"), "content")
    rows = rows.mapInPandas(run, "blob string, notice boolean, label int, body_id string, features array<double>")
    return rows.groupBy("blob").agg(F.min(F.struct("body_id", "label", "features", "notice")).alias("x")).select("blob", "x.*")


def _body_id(text: str) -> str | None:
    """A digest of a body whatever its white space; None for a blank one."""
    words = " ".join(text.split())
    return hashlib.md5(words.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest() if words else None


# How paths name other people's code, outputs, data and locks.
PATH_FEATURES = {
    "path_vendor": r"(?i)(^|/)(vendor(ed)?|third[-_]?party|external|extern|node_modules|bower_components|deps|lib|libs|pods)/",
    "path_output": r"(?i)(^|/)(dist|build|out|target|static|assets|public)/",
    "path_generated": r"(?i)(^|/)(__)?gen(erated)?[^/]*/|_pb2|\.pb\.|\.g\.\w+$|generated",
    "path_minified": r"(?i)[.-](min|bundle)\.",
    "path_lock": r"(?i)((^|[/.-])lock(file)?[.\w]*|\.lock|[-.]lock\.\w+|\.sum)$",
    "path_data": r"(?i)(^|/)(fixtures?|data|testdata|res|db|proto|wire)/|_data\.",
    "path_script": r"(?i)\.(js|css|ts|mjs|cjs)$",
    "path_config": r"(?i)\.(ya?ml|xml|properties|tf|md|json|toml|ini|sh)$|(^|/)(Dockerfile|Makefile)$",
    "path_hidden": r"(^|/)\.[^/]+$|(?i)\.(pem|key|crt)$|(^|/)id_[a-z0-9]+$",
}


def path_features(path: Column) -> list[Column]:
    return [F.coalesce(path.rlike(p), F.lit(False)).cast("double").alias(name) for name, p in PATH_FEATURES.items()]


def judged_files(files: DataFrame, blobs: DataFrame, *, sample_per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(repo, path, likelihood, notice, by_hand): every (repo, clean path) of ``files``, in any snapshot, judged once.

    The rows of the latest deliveries count. A file whose content changed has the mean
    likelihood of its contents. A file never read, or whose blobs are not stored, is
    judged by its path alone. The forest rates every file, those it learned from too, and
    ``by_hand`` is a likelihood under one half; a check of the header follows, since the
    measures don't see it: a file whose ``notice`` names a tool or another project keeps
    that label where the forest takes the rest of it for hand-written code. It learns from
    about ``sample_per_class`` files of either class. Where no file
    of either class has a notice there is nothing to learn from: without any notice all
    are taken as written by hand. Empty tables give an empty result.
    """
    facts = cut(blob_measures(blobs))
    entries = latest_entries(files).where(F.col("path").isNotNull()).select("repo", "path", "blob").distinct()
    rows = entries.join(facts, "blob", "left")
    copies = rows.where(F.col("body_id").isNotNull()).select("body_id", "repo").distinct().groupBy("body_id").agg(F.log2(F.count("*").cast("double")).alias("repos"))
    rows = rows.join(copies, "body_id", "left")
    sensitive = F.col("path").rlike(PATH_FEATURES["path_hidden"])
    label = F.when(F.col("label").isNull() & sensitive, F.lit(0)).otherwise(F.col("label"))
    rows = rows.select("repo", "path", "blob", label.alias("label"), F.coalesce("notice", F.lit(False)).alias("notice"), F.coalesce("repos", F.lit(0.0)).alias("repos"), F.coalesce("features", F.array(*[F.lit(-1.0)] * len(CONTENT_FEATURES))).alias("content"), *path_features(F.col("path")))
    rows = cut(rows)
    known = _sampled(rows.where(F.col("label").isNotNull()), sample_per_class)
    blind = known.withColumn("content", F.array(*[F.lit(-1.0)] * len(CONTENT_FEATURES))).withColumn("repos", F.lit(0.0))
    known = cut(_in_order(known.unionByName(blind)))
    classes = {r["label"] for r in known.select("label").distinct().collect()}
    if classes == {0, 1}:
        forest = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=2)
        model = forest.fit(_assembled(known))
        rated = model.transform(_assembled(rows)).withColumn("likelihood", F.get(vector_to_array("probability"), F.lit(1)))
    else:
        rated = rows.withColumn("likelihood", F.lit(1.0 if classes == {1} else 0.0))
    each = rated.groupBy("repo", "path").agg(F.avg("likelihood").alias("likelihood"), (F.avg(F.col("notice").cast("double")) > 0.5).alias("notice"))
    return each.withColumn("by_hand", ~F.col("notice") & (F.col("likelihood") < 0.5))


def _spread() -> Column:
    return F.xxhash64("repo", "path", "blob")


def _sampled(labelled: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows of each class at most, those of the least hashes; a threshold on the hash, so nothing is sorted or moved."""
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    span = 1 << 40
    part = {c: min(span, math.ceil(span * most / n)) for c, n in sizes.items()}
    limit = F.coalesce(*[F.when(F.col("label") == c, F.lit(p)) for c, p in part.items()]) if part else F.lit(0)
    return labelled.where(F.pmod(_spread(), F.lit(span)) < limit)


def _in_order(sample: DataFrame, tasks: int = 8) -> DataFrame:
    """The bounded sample in tasks and an order that depend on its rows alone, so that a seed gives the same forest anywhere."""
    return sample.repartition(tasks, _spread()).sortWithinPartitions(_spread(), "repo", "path", "blob", "label", "repos", "content")


def _assembled(rows: DataFrame) -> DataFrame:
    names = ["repos", *PATH_FEATURES]
    wide = rows.select("*", *[F.get("content", F.lit(i)).alias(f"c_{c}") for i, c in enumerate(CONTENT_FEATURES)])
    return VectorAssembler(inputCols=[*names, *[f"c_{c}" for c in CONTENT_FEATURES]], outputCol="x").transform(wide)
