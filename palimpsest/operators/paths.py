"""Paths of files: which of two tables speak of the same one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_path(a: Column, b: Column) -> Column:
    """Equal, or one ends in the other from a slash on."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def by_suffix(rows: DataFrame, path: str, wanted: DataFrame, other: str) -> DataFrame:
    """rows joined with wanted where their paths are the same_path(); an equality join on the last part, then the whole is checked."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    met = rows.withColumn("_last", last(path)).join(wanted.withColumn("_last", last(other)), "_last").drop("_last")
    return met.where(same_path(F.col(path), F.col(other)))


def under(column: Column, root: Column) -> Column:
    """A directory itself and all below it."""
    return (column == root) | column.startswith(F.concat(root, F.lit("/")))


def either_contains(a: Column, b: Column) -> Column:
    """One is part of the other, whatever the case of letters."""
    return F.lower(a).contains(F.lower(b)) | F.lower(b).contains(F.lower(a))
