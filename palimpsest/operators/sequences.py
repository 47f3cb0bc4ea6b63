"""Ordered-sequence operators: windows, anchors, dedup with expiry, version chains."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship


def fold_in_order(rows: DataFrame, by: list[str], order: list[str], values: list[str], step: Callable, schema: str, end: Callable | None = None) -> DataFrame:
    """by and what step() lets pass, for folds whose every decision hangs on the ones before it.

    step(state, row) gives the next state and either None or the row that passes, as in schema; the state of a group
    begins as None. end(state), if given, makes the last row of a group. Rows are dealt out by group, sorted on disk where they don't fit, and streamed: a
    group of any size takes the memory of a batch. Ties of `order` should be told apart by it.
    """
    ship(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), schema])
    names = [*by, *(x.split()[0] for x in schema.split(", "))]
    asked = rows.select(*by, *[F.col(c) for c in dict.fromkeys([*order, *values]) if c not in by])
    dealt = asked.repartition(*by).sortWithinPartitions(*by, *order).select(*by, *values)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = None, None
        for b in batches:
            passed = []
            keys = list(zip(*(b[c].astype(object).where(b[c].notna(), None) for c in by)))
            for key, row in zip(keys, zip(*(b[c] for c in values))):
                if key != group:
                    if end and group is not None:
                        passed.append((*group, *end(state)))
                    group, state = key, None
                state, let = step(state, row)
                if let is not None:
                    passed.append((*key, *let))
            if passed:
                yield pd.DataFrame(passed, columns=names)
        if end and group is not None:
            yield pd.DataFrame([(*group, *end(state))], columns=names)

    return dealt.mapInPandas(run, out)


def around_anchor(rows: DataFrame, by: str, time: str, id_col: str, anchor: Column, before: int = 5, after: int = 5) -> DataFrame:
    """Rows around the one nearest to `anchor` in each group (the earlier of two as near), with their distance in rows."""
    w = Window.partitionBy(by).orderBy(time, id_col)
    gap = F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(anchor.cast("timestamp")))
    numbered = rows.withColumn("n", F.row_number().over(w)).withColumn("gap", gap)
    at = F.min_by("n", F.struct("gap", "n")).over(Window.partitionBy(by))
    return numbered.withColumn("position", F.col("n") - at).where(F.col("position").between(-before, after)).drop("n", "gap")


def context_window(rows: DataFrame, by: str, order: str, value: str, back: int = 3, ahead: int = 2) -> DataFrame:
    """Each row with the values of the rows before and after it in its group."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumns({"previous": F.collect_list(value).over(w.rowsBetween(-back, -1)), "following": F.collect_list(value).over(w.rowsBetween(1, ahead))})


def followups(searches: DataFrame, session: str, at: str, text: str, ids: str, id_col: str, seconds: int = 30) -> DataFrame:
    """Searches that follow another of their session within the time, worded otherwise and with no result in common.

    Searches without results are not recorded and so neither follow nor are followed.
    """
    w = Window.partitionBy(session).orderBy(at, id_col)
    seen = searches.where(F.size(ids) > 0).withColumns({"_at": F.lag(at).over(w), "_text": F.lag(text).over(w), "_ids": F.lag(ids).over(w)})
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("_at").cast("timestamp"))
    follows = (gap <= seconds * 1_000_000) & (F.col(text) != F.col("_text")) & ~F.arrays_overlap(ids, "_ids")
    return seen.withColumn("followup", F.coalesce(follows, F.lit(False))).drop("_at", "_text", "_ids")


def dedup_with_expiry(events: DataFrame, key: list[str], at: str, id_col: str, seconds: int = 300) -> DataFrame:
    """Ids of accepted events: a key is passed over for `seconds` after its last accepted event, which repeats don't extend.

    Exactly at the end it is still a repeat.
    """

    def step(last, row):
        return (row[0], (row[1],)) if last is None or row[0] - last > seconds * 1_000_000 else (last, None)

    timed = events.select(*key, F.unix_micros(F.col(at).cast("timestamp")).alias("_t"), F.col(id_col).cast("long").alias("_i"))
    return fold_in_order(timed, key, ["_t", "_i"], ["_t", "_i"], step, f"{id_col} long")


def replay_timeline(rows: DataFrame, by: str, at: str, id_col: str, duration: str) -> DataFrame:
    """offset_ms of each row: its time since the first of its group, or, if all have one time, what the rows before it last."""
    whole, order = Window.partitionBy(by), Window.partitionBy(by).orderBy(at, id_col)
    us = F.unix_micros(F.col(at).cast("timestamp"))
    running = F.coalesce(F.sum(duration).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("offset_ms", F.when(F.min(at).over(whole) == F.max(at).over(whole), running).otherwise(F.floor((us - F.min(us).over(whole)) / 1000)))


def replay_offsets(rows: DataFrame, by: str, order: str, duration: str) -> DataFrame:
    """Offset of each row in a replay: what the rows before it last."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset_ms", F.coalesce(F.sum(duration).over(w), F.lit(0)))


def version_chain(rows: DataFrame, lineage: str, order: list[str], id_col: str) -> DataFrame:
    """version, the row that a row supersedes directly, and whether it is the latest of its lineage.

    All that a row supersedes is the chain of such parents; see superseded_by() for those of given rows.
    """
    w = Window.partitionBy(lineage).orderBy(*order)
    return rows.withColumns({"version": F.row_number().over(w), "parent": F.lag(id_col).over(w), "is_latest": F.lead(id_col).over(w).isNull()})


def superseded_by(chain: DataFrame, lineage: str, id_col: str, wanted: DataFrame) -> DataFrame:
    """(id, supersedes): everything that each of wanted(id) supersedes, newest first, of a version_chain()."""
    asked = chain.join(wanted.select(F.col("id").alias(id_col)), id_col, "left_semi").select(F.col(id_col).alias("id"), lineage, F.col("version").alias("_v"))
    older = chain.select(lineage, F.col(id_col).alias("_o"), F.col("version").alias("_w"))
    met = asked.join(older, lineage).where("_w < _v").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_w", "_o")), False).alias("l"))
    return met.select("id", F.transform("l", lambda x: x["_o"]).alias("supersedes"))


def capped(rows: DataFrame, by: list[str], order: list[Column], cap: int) -> DataFrame:
    """What is over the cap of its group: the first rows in the given order, as many as there are too many."""
    n = F.count("*").over(Window.partitionBy(*by))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("_all", n).where(F.col("_n") <= F.col("_all") - cap).drop("_n", "_all")


def nearest_rank(values: DataFrame, by: list[str], value: str, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """Percentiles by nearest rank.

    Equal values are counted before anything is ordered, so what meets in one task are the distinct values of a group.
    """
    w = Window.partitionBy(*by)
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    run = counted.withColumns({"_up": F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_c").over(w)})
    at = lambda p: F.greatest(F.lit(1), F.ceil(F.col("_all") * (p / 100.0)))
    return run.groupBy(*by).agg(*(F.min(F.when(F.col("_up") >= at(p), F.col(value))).alias(f"p{p}") for p in percents))
