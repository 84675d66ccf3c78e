"""Key expressions used in several operators; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    r"""``\`` read as ``/`` and one leading ``./`` dropped; letter case stays. Null stays null."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def fingerprint(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a row in which null differs from every value."""
    marked = [x for c in columns for x in (c, c.isNull())]
    return F.xxhash64(F.lit("left"), *marked), F.xxhash64(F.lit("right"), *marked)
