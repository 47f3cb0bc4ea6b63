"""Connected components of an edge table, without collecting links or nodes anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"),
            F.bit_xor(F.xxhash64("a", "b")),
            F.bit_xor(F.hash("a", "b").cast("long")),
        ).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node of its component.

    Alternating large-star and small-star rounds: each replaces links by links to the
    smallest neighbour, in O(log^2 n) rounds whatever the diameter. Every step is an
    aggregate and a join on a node, so no neighbourhood is held in memory. Lineage is cut
    by a reliable checkpoint every round. Self-links and repeated links are ignored; an
    empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    now = checkpointed(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _mark(now)
    if not before[0]:
        return spark.createDataFrame([], f"node {dict(now.dtypes)['a']}, root {dict(now.dtypes)['a']}")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = checkpointed(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        after = _mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
