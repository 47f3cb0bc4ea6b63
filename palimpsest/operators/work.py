"""Work graph: actions(id, status, priority, created, assignee) and edges(src, dst, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as sc
from .sequences import fold_in_order


def blocked(actions: DataFrame, edges: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Ids that can't start: an open requirement, a gate not passed, or an active conflict either way.

    A missing target blocks nothing.
    """
    of = lambda kind: edges.where(F.col("type") == kind)
    state = actions.select(F.col("id").alias("other"), F.col("status").alias("other_status"))
    needs = of("requires").join(state, F.col("dst") == F.col("other")).where("other_status <> 'done'").select(F.col("src").alias("id"))
    gates = of("gated_by").join(checkpoints.select(F.col("id").alias("gate"), F.col("status").alias("gate_status")), F.col("dst") == F.col("gate")).where("gate_status <> 'passed'").select(F.col("src").alias("id"))
    c = of("conflicts_with")
    both = c.select(F.col("src").alias("id"), F.col("dst").alias("with")).unionByName(c.select(F.col("dst").alias("id"), F.col("src").alias("with")))
    fights = both.join(state, F.col("with") == F.col("other")).where("other_status = 'active'").select("id")
    return needs.unionByName(gates).unionByName(fights).distinct()


def frontier(actions: DataFrame, edges: DataFrame, checkpoints: DataFrame, now: Column) -> DataFrame:
    """Actions that can be worked on, with their score: id, priority, status, score."""
    free = actions.where(F.col("status").isin("pending", "active")).join(blocked(actions, edges, checkpoints), "id", "left_anti")
    unlocks = edges.where("type = 'unlocks'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("unlocks"))
    spawned = edges.where("type = 'spawned_by'").select(F.col("src").alias("id"), F.lit(True).alias("spawned")).distinct()
    rows = free.join(unlocks, "id", "left").join(spawned, "id", "left")
    hours = sc.days_between(now, F.col("created")) * 24
    score = sc.frontier_score(F.col("priority"), hours, F.coalesce("unlocks", F.lit(0)), F.coalesce("spawned", F.lit(False)), F.col("status") == "active")
    return rows.select("id", "priority", "status", score.alias("score"))


def all_requirements_done(actions: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, ready): whether all requirements of an action are done; here a missing one is not."""
    state = actions.select(F.col("id").alias("dst"), F.col("status").alias("needed"))
    need = edges.where("type = 'requires'").join(state, "dst", "left")
    return need.groupBy(F.col("src").alias("id")).agg(F.bool_and(F.coalesce(F.col("needed") == "done", F.lit(False))).alias("ready"))


def unblocked(actions: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocked actions whose requirements are all done."""
    ready = all_requirements_done(actions, edges).where("ready").select("id")
    return actions.where("status = 'blocked'").join(ready, "id", "left_semi").select("id")


def leases(requests: DataFrame, action: str, at: str, agent: str, id_col: str, minutes: int = 10) -> DataFrame:
    """Granted requests: one active lease per action; a holder who asks again keeps the lease as it is."""

    def step(lease, row):
        t, request, who = row
        if lease is None or t >= lease[0]:
            return (t + minutes * 60_000_000, who), (request,)
        return lease, (request,) if lease[1] == who else None

    rows = requests.select(action, F.unix_micros(F.col(at).cast("timestamp")).alias("_t"), F.col(id_col).cast("long").alias("_i"), F.col(agent).cast("long").alias("_w"))
    return fold_in_order(rows, [action], ["_t", "_i"], ["_t", "_i", "_w"], step, f"{id_col} long")


def routine_status(steps: DataFrame, actions: DataFrame) -> DataFrame:
    """Progress of a run from its steps' actions; a missing action counts as cancelled."""
    s = F.coalesce(F.col("status"), F.lit("cancelled"))
    rows = steps.join(actions.select(F.col("id").alias("action"), "status"), "action", "left")
    return rows.groupBy("run").agg(
        F.count("*").alias("steps"), F.count_if(s == "done").alias("done"), F.count_if(s == "active").alias("active"),
        F.when(F.bool_and(s == "done"), "completed").when(F.bool_or(s == "cancelled"), "failed").otherwise("running").alias("state"),
    )


def instantiate(steps: DataFrame, run: Column) -> tuple[DataFrame, DataFrame]:
    """Actions and requirement edges of a run of routine(step, depends_on[]): steps with requirements begin blocked."""
    made = steps.select(F.concat_ws(":", run, "step").alias("id"), F.when(F.size("depends_on") > 0, "blocked").otherwise("pending").alias("status"), "depends_on")
    edges = made.select(F.col("id").alias("src"), F.explode("depends_on").alias("d")).select("src", F.concat_ws(":", run, "d").alias("dst"), F.lit("requires").alias("type"))
    return made.drop("depends_on"), edges


#: Kinds of edges between actions.
EDGE_KINDS = ("requires", "unlocks", "spawned_by", "gated_by", "conflicts_with")


def priority(said: Column) -> Column:
    """Within 1 and 10; 5 if nothing is said."""
    return F.least(F.lit(10), F.greatest(F.lit(1), F.coalesce(said, F.lit(5))))


def valid_edges(edges: DataFrame, actions: DataFrame) -> DataFrame:
    """Edges of a known kind between two different actions that are there; a gate needn't be an action."""
    ids = actions.select("id")
    sound = edges.where(F.col("type").isin(*EDGE_KINDS) & (F.col("src") != F.col("dst"))).join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return sound.where("type = 'gated_by'").unionByName(sound.where("type <> 'gated_by'").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*sound.columns))


def ranked(rows: DataFrame, k: int = 1) -> DataFrame:
    return rows.orderBy(F.desc("score"), "id").limit(k)
