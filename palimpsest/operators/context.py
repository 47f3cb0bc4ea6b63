"""Blocks of context, what sessions leave in slots, and how a replay names its events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .paths import either_contains
from .search import skip_budget, top

#: Characters of an enriched context, and of the frame round a block.
MOST_CONTEXT, FRAME = 4000, 40
BLOCK = ["project", "kind", "id", "content", "recency"]
# What a hook is in a replay.
KINDS = {"session_start": "session_start", "session_end": "session_end", "prompt_submit": "prompt", "pre_tool_use": "tool_call", "post_tool_use": "tool_result", "post_tool_failure": "tool_error"}
LABELS = {"prompt": "User prompt", "session_start": "Session start", "session_end": "Session end"}
TOOL_LABELS = {"tool_call": " ▸ call", "tool_result": " ▸ result", "tool_error": " ▸ error"}


def strength_step(strength: Column, step: float = 0.2) -> Column:
    """Strengths in steps, within which they count as equal."""
    return F.floor(F.round(strength / step, 6))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _lines(order: str, line: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda x: x["t"]), "\n")


def profile_block(concepts: DataFrame, most: int, recency: int) -> DataFrame:
    """A block of the commonest of concepts(project, concept, n), ties by name."""
    best = top(concepts, ["project"], [F.desc("n"), F.asc("concept")], most, "r")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "concept"))), lambda x: x["concept"]), ", ")
    return best.groupBy("project").agg(names.alias("c")).select("project", F.lit("profile").alias("kind"), F.lit(0).cast("long").alias("id"), F.concat(F.lit("Concepts: "), "c").alias("content"), F.lit(recency).cast("long").alias("recency"))


def lesson_block(projects: DataFrame, lessons: DataFrame, most: int, recency: int) -> DataFrame:
    """A block of the best lessons(id, project, content, confidence): a project's own count half as much again, those of none are open to all.

    Of the open ones no more than `most` can be among the best, so only those meet every project.
    """
    own = lessons.where("project is not null").select("project", "id", "content", F.round(F.col("confidence") * 1.5, 6).alias("score")).join(projects, "project", "left_semi")
    open_ = lessons.where("project is null").select("id", "content", F.round("confidence", 6).alias("score")).orderBy(F.desc("score"), "id").limit(most)
    shared = projects.crossJoin(F.broadcast(open_)).select("project", "id", "content", "score")  # `most` rows at most on one side
    best = top(own.unionByName(shared), ["project"], [F.desc("score"), F.asc("id")], most, "r")
    return best.groupBy("project").agg(_lines("r", F.concat(F.lit("- "), "content")).alias("content")).select("project", F.lit("lessons").alias("kind"), F.lit(0).cast("long").alias("id"), "content", F.lit(recency).cast("long").alias("recency"))


def packed(blocks: list[DataFrame], budget: int) -> DataFrame:
    """(project, kind, id, used): of all blocks, newest first, those that fit what is left of the budget, frames counted."""
    rows = reduce(DataFrame.unionByName, [b.select(*BLOCK) for b in blocks])
    w = Window.partitionBy("project").orderBy(F.desc("recency"), "id", "kind")
    numbered = rows.select("project", "kind", "id", F.row_number().over(w).cast("long").alias("n"), tx.token_estimate(F.concat(F.col("content"), F.lit(" " * FRAME))).alias("t"))
    taken = skip_budget(numbered, ["project"], "n", "n", "t", budget)
    return taken.withColumnRenamed("id", "n").join(numbered, ["project", "n"]).select("project", "kind", "id", "used")


def bugs_in(files: DataFrame, bugs: DataFrame, most: int = 3) -> DataFrame:
    """(request, r, title, content): the newest of bugs(id, title, content, file, updated_at) whose file contains one of files(request, file) or is part of it.

    Distinct files meet first, so many bugs in one file are compared once.
    """
    asked, known = files.select("file").distinct(), bugs.select(F.col("file").alias("other")).distinct()
    met = asked.join(known, either_contains(F.col("file"), F.col("other")))
    rows = files.join(met, "file").join(bugs.withColumnRenamed("file", "other"), "other").dropDuplicates(["request", "id"])
    return top(rows, ["request"], [F.desc("updated_at"), F.asc("id")], most, "r").select("request", "r", "title", "content")


def enriched(requests: DataFrame, hits: DataFrame, bugs: DataFrame, most: int = MOST_CONTEXT) -> DataFrame:
    """(request, context, truncated): narratives of hits(request, rank, narrative) and bugs(request, r, title, content), escaped, each under its tag."""
    tagged = lambda tag, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{tag}>\n"), F.col(c), F.lit(f"\n</{tag}>")))
    near = hits.groupBy("request").agg(_lines("rank", escaped(F.col("narrative"))).alias("near"))
    past = bugs.groupBy("request").agg(_lines("r", F.concat(F.lit("- "), escaped(F.col("title")), F.lit(": "), escaped(F.col("content")))).alias("past"))
    whole = requests.join(near, "request", "left").join(past, "request", "left").select("request", F.concat_ws("\n\n", tagged("relevant-context", "near"), tagged("past-errors", "past")).alias("c"))
    return whole.select("request", F.substring("c", 1, most).alias("context"), (F.length("c") > most).alias("truncated"))


def reflected(observations: DataFrame, by: str, order: list[str], newest: int = 50, todo: str = "todo") -> DataFrame:
    """Of the newest observations of each group: how many, how many errors and commands, and lines for those that speak of a to-do."""
    best = top(observations, [by], [F.desc(c) for c in order], min(newest, 200), "_n")
    says = F.lower("narrative").contains(todo) | F.lower("title").contains(todo)
    lines = F.filter(F.array_sort(F.collect_list(F.struct("_n", F.when(says, F.concat(F.lit("- "), "title")).alias("t")))), lambda x: x["t"].isNotNull())
    kind = lambda t: F.count_if(F.col("type") == t)
    return best.groupBy(by).agg(F.count("*").alias("reviewed"), kind("error").alias("errors"), kind("command_run").alias("commands"), F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("pending"))


def replay_kind(hook: Column, body: Column) -> Column:
    """What an event is in a replay, by its hook; a stop is a response if it says something."""
    out = F.when((hook == "stop") & (F.coalesce(body, F.lit("")) != ""), "response")
    for h, k in KINDS.items():
        out = out.when(hook == h, k)
    return out.otherwise("hook")


def replay_label(hook: Column, tool: Column, body: Column) -> Column:
    kind, said = replay_kind(hook, body), F.when(body != "", tx.truncated(body, 80))
    out = F.when(kind == "prompt", F.coalesce(said, F.lit(LABELS["prompt"]))).when(kind == "response", said)
    for k, end in TOOL_LABELS.items():
        out = out.when(kind == k, F.concat(F.coalesce(tool, F.lit("tool")), F.lit(end)))
    for k in ("session_start", "session_end"):
        out = out.when(kind == k, LABELS[k])
    return out.otherwise(hook)
