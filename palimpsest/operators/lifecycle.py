"""Deletion, decay, eviction, merging and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expired(rows: DataFrame, at: str, now: Column, inclusive: bool = True) -> DataFrame:
    """Rows whose time is over; a null time never is."""
    return rows.where(F.col(at) <= now if inclusive else F.col(at) < now)


def last_write_wins(current: DataFrame, incoming: DataFrame, key: str, at: str) -> DataFrame:
    """An incoming row takes the place of one only if it is strictly newer; new keys are added."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(at), F.asc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def majority(votes: DataFrame, item: str, value: str) -> DataFrame:
    """The value of more than half of an item's votes, or its only one; else null and ambiguous. Null votes don't count."""
    n = votes.where(F.col(value).isNotNull()).groupBy(item, value).agg(F.count("*").alias("n"))
    best = F.max_by(value, F.struct("n", value))
    out = n.groupBy(item).agg(best.alias("winner"), F.max("n").alias("top"), F.sum("n").alias("all"), F.count("*").alias("kinds"))
    sure = (F.col("top") * 2 > F.col("all")) | (F.col("kinds") == 1)
    return out.select(item, F.when(sure, F.col("winner")).alias("winner"), (~sure).alias("ambiguous"))


def contradictions(memories: DataFrame, id_col: str, concepts: str, words: str, at: str, least: float = 0.9, newest: int = 1000) -> DataFrame:
    """(older, newer, similarity): pairs of the newest memories that share a concept and nearly all words of their contents.

    Concepts are lower-cased and say which pairs are looked at; the similarity is that of the whole sets `words`, of which
    empty ones are left out. Of equally new ones the greater id is the older. A memory is no pair with itself.
    """
    base = memories.orderBy(F.desc(at), id_col).limit(newest)
    sets = base.select(F.col(id_col).alias("id"), F.col(at).alias("at"), F.array_distinct(F.transform(concepts, F.lower)).alias("c"), F.array_distinct(words).alias("s")).where(F.size("s") > 0)
    one = sets.select("id", F.size("s").alias("n"), F.explode("c").alias("c"))
    side = lambda x: one.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), "c")
    # sizes alone rule out most pairs before any set is fetched
    may = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") > F.greatest("n_a", "n_b") * least)
    met = side("a").join(side("b"), "c").where(may).select("a", "b").distinct()
    side = lambda x: sets.select(F.col("id").alias(x), F.col("at").alias(f"at_{x}"), F.col("s").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    pairs = met.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", both / (F.size("s_a") + F.size("s_b") - both)).where(F.col("similarity") > least)
    b_older = F.col("at_b") <= F.col("at_a")
    return pairs.select(F.when(b_older, F.col("b")).otherwise(F.col("a")).alias("older"), F.when(b_older, F.col("a")).otherwise(F.col("b")).alias("newer"), F.round("similarity", 6).alias("similarity"))


def stale_by_provenance(sources: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """Ids in sources(id, source), one row per source, any of whose sources is among gone(source)."""
    return sources.join(gone, "source", "left_semi").select(id_col).distinct()


def shared_concepts(memories: DataFrame, superseded: DataFrame, id_col: str, concepts: str, least: int = 2) -> DataFrame:
    """(id, siblings): how many latest memories share at least `least` lower-cased concepts with each superseded one that has so many."""
    one = memories.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.transform(concepts, F.lower))).alias("c"), "is_latest")
    old = one.join(superseded.select("id"), "id", "left_semi").select("id", "c")
    some = old.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("id")
    met = old.join(some, "id").join(one.where("is_latest").select(F.col("id").alias("other"), "c"), "c").where("id <> other")
    shared = met.groupBy("id", "other").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return some.join(shared.groupBy("id").agg(F.count("*").alias("siblings")), "id", "left").select("id", F.coalesce("siblings", F.lit(0).cast("long")).alias("siblings"))


def orphans(rows: DataFrame, ref: str, targets: DataFrame, target_id: str) -> DataFrame:
    """Rows whose reference has no target."""
    return rows.where(F.col(ref).isNotNull()).join(targets.select(F.col(target_id).alias(ref)), ref, "left_anti")


def check(rows: DataFrame, name: Column, category: str, status: str, fixable: bool) -> DataFrame:
    """Findings of an integrity check in the common form."""
    return rows.select(name.cast("string").alias("name"), F.lit(category).alias("category"), F.lit(status).alias("status"), F.lit(fixable).alias("fixable"))


def over_quota(files: DataFrame, by: list[str], touched: str, id_col: str, size: str, quota: int, before: Column, references: str) -> DataFrame:
    """Files to delete, longest untouched first, until the rest fits the quota; those referred to, or touched since `before`, stay and count."""
    total = files.groupBy(*by).agg(F.sum(size).alias("_total"))
    free = files.where((F.col(references) == 0) & (F.col(touched) < before)).join(total, by)
    earlier = F.coalesce(F.sum(size).over(Window.partitionBy(*by).orderBy(touched, id_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return free.withColumn("_left", F.col("_total") - earlier).where(F.col("_left") > quota).drop("_left", "_total")


def page_out(entries: DataFrame, by: list[str], score: str, id_col: str, tokens: str, budget: int) -> DataFrame:
    """Entries to move out, lowest scores first, until what stays fits the budget."""
    order = Window.partitionBy(*by).orderBy(score, id_col)
    total = F.sum(tokens).over(Window.partitionBy(*by))
    before = F.coalesce(F.sum(tokens).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return entries.withColumn("_left", total - before).where(F.col("_left") > budget).drop("_left")
