"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, ship  # noqa: F401

#: Rows of one Arrow batch: keeps a batch of very long texts small in the Python workers.
ARROW_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The parquet table, read by Spark only, so any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and the package on the Python workers' path, wherever they run.

    Two settings of the session change, for later queries too: rows of an Arrow batch (texts may be long) and
    the size from which generated methods are split.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    # a generated method beyond 8000 bytes is never compiled to machine code: split such stages instead
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    ship(spark)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet (whatever the case of its letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bounded_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """About n rows at most, those of the smallest hashes of `keys`; all rows of a table that has no more.

    A threshold on the hash leaves some n rows over all tasks before any order is asked for, so
    what one task gathers does not grow with the table.
    """
    total = df.count()
    k = F.xxhash64(*keys)
    if total > 2 * n:
        df = df.where(F.shiftrightunsigned(k, 1) < int((1 << 63) * (1.5 * n / total)))
    return df.orderBy(k, *keys).limit(n)
