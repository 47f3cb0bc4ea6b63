"""Integrity checks over all tables of a memory, and repairs of what can be repaired."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import all_requirements_done

#: Categories, in order.
CATEGORIES = ["actions", "leases", "sentinels", "sketches", "signals", "sessions", "memories", "lessons", "summaries", "semantic", "procedural", "crystals", "insights", "mesh"]
FINDING = "name string, category string, status string, fixable boolean"


def _bad_share(c: str) -> Column:
    """No number within 0 and 1."""
    x = F.col(c).cast("double")
    return x.isNull() | F.isnan(x) | (x < 0) | (x > 1)


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _rule(kind: str, status: str, fixable: bool, rows: Callable[[dict[str, DataFrame], Column], DataFrame], *more: str):
    return kind, status, fixable, rows, more


def _requirements(t: dict[str, DataFrame]) -> DataFrame:
    return all_requirements_done(t["actions"], t["edges"])


def _superseded(t: dict[str, DataFrame]) -> DataFrame:
    return t["memories"].select(F.explode("supersedes").alias("id")).distinct()


def _missing(rows: DataFrame, ids: str, targets: DataFrame) -> DataFrame:
    """(id, ref) of references to rows that aren't there."""
    return rows.select("id", F.explode(ids).alias("ref")).join(targets.select(F.col("id").alias("ref")), "ref", "left_anti")


def _late(table: str, status: str | None = None) -> Callable[[dict[str, DataFrame], Column], DataFrame]:
    return lambda t, now: t[table].where((F.col("expires_at") <= now) & (F.lit(True) if status is None else F.col("status") == status))


#: Per category: kind of finding, its status, whether it can be repaired, and the rows it holds for, with `id` and perhaps `ref`.
RULES: dict[str, list] = {
    "actions": [
        _rule("active-no-lease", "warn", False, lambda t, now: t["actions"].where("status = 'active'").join(t["leases"].where((F.col("status") == "active") & (F.col("expires_at") > now)).select(F.col("action").alias("id")), "id", "left_anti")),
        _rule("blocked-deps-done", "fail", True, lambda t, now: t["actions"].where("status = 'blocked'").join(_requirements(t).where("ready"), "id", "left_semi")),
        _rule("pending-unsatisfied-deps", "fail", True, lambda t, now: t["actions"].where("status = 'pending'").join(_requirements(t).where("not ready"), "id", "left_semi")),
    ],
    "leases": [
        _rule("expired-lease", "fail", True, _late("leases", "active")),
        _rule("orphaned-lease", "fail", True, lambda t, now: t["leases"].join(t["actions"].select(F.col("id").alias("action")), "action", "left_anti")),
    ],
    "sentinels": [
        _rule("expired-sentinel", "fail", True, _late("sentinels", "watching")),
        _rule("sentinel-missing-action", "warn", False, lambda t, now: _missing(t["sentinels"], "actions", t["actions"]), "ref"),
    ],
    "sketches": [_rule("expired-sketch", "fail", True, _late("sketches", "active"))],
    "signals": [_rule("expired-signal", "fail", True, _late("signals"))],
    "sessions": [_rule("abandoned-session", "warn", False, lambda t, now: t["sessions"].where((F.col("status") == "active") & (F.col("started_at") < now - F.expr("interval 24 hours"))))],
    "memories": [
        _rule("memory-missing-supersedes", "warn", False, lambda t, now: _missing(t["memories"], "supersedes", t["memories"]), "ref"),
        _rule("memory-stale-latest", "fail", True, lambda t, now: t["memories"].where("is_latest").join(_superseded(t), "id", "left_semi")),
    ],
    "lessons": [_rule("lesson-bad-confidence", "warn", False, lambda t, now: t["lessons"].where(~F.coalesce("deleted", F.lit(False)) & _bad_share("confidence")))],
    "summaries": [_rule("summary-missing-title", "warn", False, lambda t, now: t["summaries"].where(_blank("title")))],
    "semantic": [_rule("semantic-bad-confidence", "warn", False, lambda t, now: t["semantic"].where(_bad_share("confidence")))],
    "procedural": [_rule("procedural-empty-steps", "warn", False, lambda t, now: t["procedural"].where(F.coalesce(F.size("steps"), F.lit(0)) <= 0))],
    "crystals": [_rule("crystal-empty-narrative", "warn", False, lambda t, now: t["crystals"].where(_blank("narrative")))],
    "insights": [_rule("insight-bad-confidence", "warn", False, lambda t, now: t["insights"].where(~F.coalesce("deleted", F.lit(False)) & _bad_share("confidence")))],
    "mesh": [
        _rule("stale-peer", "warn", False, lambda t, now: t["mesh"].where(F.col("last_sync_at") < now - F.expr("interval 1 hour"))),
        _rule("error-peer", "warn", False, lambda t, now: t["mesh"].where("status = 'error'")),
    ],
}


def _coverage(memories: DataFrame) -> DataFrame:
    """Whether the latest memories know their project: pass if all do, fail if none does, else warn."""
    n = memories.where("is_latest").agg(F.count("*").alias("n"), F.count_if(F.col("project").isNull()).alias("bare"))
    status = F.when(F.col("bare") == 0, "pass").when(F.col("bare") < F.col("n"), "warn").otherwise("fail")
    return n.select(F.lit("memory-project-coverage").alias("name"), F.lit("memories").alias("category"), status.alias("status"), (F.col("bare") > 0).alias("fixable"))


def diagnose(tables: dict[str, DataFrame], now: Column, categories: list[str] | None = None) -> DataFrame:
    """Findings (name, category, status, fixable) of the categories whose table is given; one without a finding has `<category>-ok`.

    A name is the kind of the finding and the row's id. actions also needs edges and leases. Unknown categories are passed over;
    none at all means all.
    """
    wanted = [c for c in CATEGORIES if c in tables and (not categories or c in categories)]
    found = []
    for c in wanted:
        for kind, status, fixable, rows, more in RULES[c]:
            name = F.concat_ws(":", F.lit(kind), *[F.col(x).cast("string") for x in ("id", *more)])
            found.append(rows(tables, now).select(name.alias("name"), F.lit(c).alias("category"), F.lit(status).alias("status"), F.lit(fixable).alias("fixable")))
    if not found:
        raise ValueError("no table of a known category")
    out = reduce(DataFrame.unionByName, found)
    spark = out.sparkSession
    fine = spark.createDataFrame([(c,) for c in wanted], "category string").join(F.broadcast(out.select("category").distinct()), "category", "left_anti")  # as many rows as categories
    out = out.unionByName(fine.select(F.concat("category", F.lit("-ok")).alias("name"), "category", F.lit("pass").alias("status"), F.lit(False).alias("fixable")))
    return out.unionByName(_coverage(tables["memories"])) if "memories" in wanted else out


def rollup(findings: DataFrame) -> DataFrame:
    """(total, passed, warned, failed, fixable) of findings."""
    n = lambda s: F.count_if(F.col("status") == s)
    return findings.agg(F.count("*").alias("total"), n("pass").alias("passed"), n("warn").alias("warned"), n("fail").alias("failed"), F.count_if("fixable").alias("fixable"))


def heal(tables: dict[str, DataFrame], now: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after repair, of those given, and what was done: (category, id, reason).

    Actions whose requirements are all done are pending again, pending ones with open requirements blocked. Expired leases are marked
    so and those of no action go; an expired lease frees its action if the holder is still assigned and no other lease is
    active. Expired sentinels and sketches are marked, expired signals go, superseded memories are no longer the latest. For a
    dry run only the second result is of interest.
    """
    out, done = dict(tables), []

    def note(rows: DataFrame, category: str, reason: str) -> None:
        done.append(rows.select(F.lit(category).alias("category"), F.col("id").cast("string").alias("id"), F.lit(reason).alias("reason")))

    def marked(table: str, rows: DataFrame, column: str, value: Column, reason: str) -> None:
        hit = rows.select("id").distinct().withColumn("_hit", F.lit(True))
        note(hit, table, reason)
        out[table] = out[table].join(hit, "id", "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).select(*tables[table].columns)

    def dropped(table: str, rows: DataFrame, reason: str) -> None:
        hit = rows.select("id").distinct()
        note(hit, table, reason)
        out[table] = out[table].join(hit, "id", "left_anti")

    rows = {kind: f(tables, now) for c, rules in RULES.items() if c in tables for kind, _, fixable, f, _ in rules if fixable}
    if "actions" in tables:
        marked("actions", rows["blocked-deps-done"], "status", F.lit("pending"), "blocked-deps-done")
        marked("actions", rows["pending-unsatisfied-deps"], "status", F.lit("blocked"), "pending-unsatisfied-deps")
    if "leases" in tables:
        over = rows["expired-lease"]
        if "actions" in tables:
            marked("actions", freed(tables["actions"], tables["leases"], now), "status", F.lit("pending"), "lease-expired")
        marked("leases", over, "status", F.lit("expired"), "expired-lease")
        dropped("leases", rows["orphaned-lease"], "orphaned-lease")
    for table in ("sentinels", "sketches"):
        if table in tables:
            marked(table, rows[f"expired-{table[:-2] if table == 'sketches' else table[:-1]}"], "status", F.lit("expired"), "expired")
    if "signals" in tables:
        dropped("signals", rows["expired-signal"], "expired")
    if "memories" in tables:
        marked("memories", rows["memory-stale-latest"], "is_latest", F.lit(False), "memory-stale-latest")
    return out, reduce(DataFrame.unionByName, done)


def freed(actions: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    """Active actions whose holder's lease is over, who is still assigned, and on which no other lease is active."""
    held = F.col("status") == "active"
    over = leases.where(held & (F.col("expires_at") <= now)).select(F.col("action").alias("id"), F.col("agent").alias("assigned_to")).distinct()
    live = leases.where(held & (F.col("expires_at") > now)).select(F.col("action").alias("id"))
    return actions.where("status = 'active'").join(over, ["id", "assigned_to"], "left_semi").join(live, "id", "left_anti")


def forget(observations: DataFrame, sessions: DataFrame, summaries: DataFrame, memories: DataFrame, asked: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left after requests asked(request, memory, session, observation), and how much each deletes: (request, deleted).

    A request names a memory, or an observation of a session, or a whole session, which takes its observations, itself and its
    summary and counts two beyond the observations, whether or not there is a summary. A named memory or observation
    counts one, there or not.
    """
    whole = asked.where("session is not null and observation is null and memory is null").select("request", "session")
    one = asked.where("session is not null and observation is not null").select("request", "session", F.col("observation").alias("id"))
    named = asked.where("memory is not null").select("request", F.col("memory").alias("id"))
    gone = observations.join(whole.select("session").distinct(), "session", "left_anti").join(one.select("session", "id").distinct(), ["session", "id"], "left_anti")
    left = {"observations": gone, "sessions": sessions.join(whole, "session", "left_anti"), "summaries": summaries.join(whole, "session", "left_anti"), "memories": memories.join(named.select("id"), "id", "left_anti")}
    in_whole = whole.join(observations.groupBy("session").agg(F.count("*").alias("n")), "session", "left").select("request", (F.coalesce("n", F.lit(0)) + 2).alias("n"))
    counts = in_whole.unionByName(one.select("request", F.lit(1).cast("long").alias("n"))).unionByName(named.select("request", F.lit(1).cast("long").alias("n")))
    return left, counts.groupBy("request").agg(F.sum("n").alias("deleted"))


def govern(memories: DataFrame, condition: Column | None, dry_run: bool = False, reason: str = "") -> tuple[DataFrame, DataFrame]:
    """Memories without those of a condition, and the audit rows (id, operation, reason) of each that goes.

    A bulk deletion without any condition is refused unless it's a dry run, which deletes nothing.
    """
    if condition is None and not dry_run:
        raise ValueError("a bulk deletion needs a condition")
    hit = memories if condition is None else memories.where(condition)
    audit = hit.select("id", F.lit("would delete" if dry_run else "delete").alias("operation"), F.lit(reason).alias("reason"))
    return (memories if dry_run else memories.join(hit.select("id"), "id", "left_anti")), audit
