"""Search requests: who may see what, filters, formats, and what a page of results holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import ship
from . import search as s

#: Rows of a page: the least, the usual and the most, by kind of request.
LIMITS = {"search": (1, 20, 100), "smart": (1, 20, 100), "lessons": (1, 10, 10), "vision": (1, 10, 50), "graph": (1, 500, 5000), "evict": (1, 50, 1000), "expand": (1, 20, 20)}
#: Characters of a lesson in a page of results.
PREVIEW = 240
FORMATS = {"compact": ["title", "type", "timestamp"], "narrative": ["title", "narrative", "timestamp"], "full": None}


def clamp(kind: str, limit: int | None = None) -> int:
    """A limit within the bounds of its kind; basic search refuses what is below them, others raise it."""
    low, usual, high = LIMITS[kind]
    if limit is None:
        return usual
    if kind == "search" and limit < low:
        raise ValueError("a limit is a positive integer")
    return max(low, min(limit, high))


def agent_scope(explicit: str | None, isolated: bool, own: str | None) -> str | None:
    """The agent whose rows may be seen, None for all. Isolated and unknown is an error: nothing leaks by default."""
    said = (explicit or "").strip() or None
    if said == "*":
        return None
    if said is None and isolated and not (own or "").strip():
        raise ValueError("agents are isolated and this one is unknown; ask for '*' to see all")
    return said or (own if isolated else None)


def of_agent(rows: DataFrame, agent: str | None, column: str = "agent", orphans: bool = False) -> DataFrame:
    """Rows of an agent, exactly; with orphans also those of none."""
    if agent is None:
        return rows
    mine = F.col(column) == agent
    return rows.where(mine | F.col(column).isNull() if orphans else mine)


def in_project(hits: DataFrame, sessions: DataFrame, memories: DataFrame, project: str | None, cwd: str | None = None) -> DataFrame:
    """hits(id, session, ...) of a project: by their session, else as memories by their own project, where none is known all may see them.

    sessions(session, project, cwd), memories(id, project). A directory is asked of known sessions only.
    """
    if project is None and cwd is None:
        return hits
    of = sessions.select("session", F.col("project").alias("_sp"), F.col("cwd").alias("_cwd"), F.lit(True).alias("_known"))
    own = memories.select("id", F.col("project").alias("_mp"))
    met = hits.join(of, "session", "left").join(own, "id", "left")
    known = F.col("_known").isNotNull()
    fits = F.lit(True)
    if project is not None:
        fits = F.when(known, F.coalesce(F.col("_sp") == project, F.lit(False))).otherwise(F.col("_mp").isNull() | (F.col("_mp") == project))
    if cwd is not None:
        fits = fits & (~known | F.coalesce(F.col("_cwd") == cwd, F.lit(False)))
    return met.where(fits).drop("_sp", "_cwd", "_known", "_mp")


def looked_up(hits: DataFrame, observations: DataFrame, memories: DataFrame) -> DataFrame:
    """hits(id, ...) with title, type, narrative, importance, timestamp and agent: of the observation, else of the memory of that id.

    A memory reads as a decision whose narrative is its content and whose importance is its strength. Hits of neither go.
    """
    names = ["title", "type", "narrative", "importance", "timestamp", "agent"]
    o = observations.select("id", F.struct(*names).alias("_o"))
    as_memory = memories.select("id", F.struct("title", F.lit("decision").alias("type"), F.col("content").alias("narrative"), F.col("strength").cast(dict(observations.dtypes)["importance"]).alias("importance"), F.col("updated_at").alias("timestamp"), "agent").alias("_m"))
    met = hits.join(o, "id", "left").join(as_memory, "id", "left").withColumn("_r", F.coalesce("_o", "_m")).where(F.col("_r").isNotNull())
    return met.select(*hits.columns, "_r.*")


def page(hits: DataFrame, limit: int, form: str = "full", budget: int | None = None) -> DataFrame:
    """The first `limit` of hits(query_id, id, score, ...) a query, in a format, until the first that exceeds the tokens left.

    A row's tokens are a third of the characters of its texts, one at least.
    """
    if form not in FORMATS:
        raise ValueError(f"a format is one of {', '.join(FORMATS)}")
    best = s.top(hits, ["query_id"], [F.desc("score"), F.asc("id")], limit)
    texts = [c for c in (FORMATS[form] or ["title", "type", "narrative", "timestamp"]) if c != "timestamp"]
    if budget is not None:
        if budget < 1:
            raise ValueError("a token budget is a positive integer")
        sized = best.withColumn("tokens", F.greatest(F.lit(1), tx.token_estimate(F.concat_ws(" ", *texts))).cast("long"))
        best = s.prefix_budget(sized, ["query_id"], [F.asc("rank")], "tokens", budget)
    return best if FORMATS[form] is None else best.select("query_id", "id", "session", "score", "rank", *FORMATS[form], *(["tokens", "used"] if budget is not None else []))


def over_fetch(kind: str, limit: int, filtered: bool) -> int:
    """How many hits are asked of the index when some will be filtered away."""
    if not filtered:
        return limit
    return max(10 * limit, 100) if kind == "search" else min(3 * limit, 300)


def basic_search(ranked: Callable[[int], DataFrame], observations: DataFrame, memories: DataFrame, sessions: DataFrame, limit: int | None = None, project: str | None = None, cwd: str | None = None, agent: str | None = None, form: str = "full", budget: int | None = None) -> DataFrame:
    """Keyword search with filters: ranked(k) gives the k best (query_id, id, score, rank); observations carry their session.

    The index is asked for more than a page if a filter is on; without an agent filter no more than a page of
    what the project lets through is looked up.
    """
    n = clamp("search", limit)
    filtered = any(x is not None for x in (project, cwd, agent))
    session_of = observations.select("id", "session").unionByName(memories.select("id", "session"))
    hits = in_project(ranked(over_fetch("search", n, filtered)).join(session_of, "id", "left"), sessions, memories, project, cwd)
    if agent is None:
        hits = s.top(hits.drop("rank"), ["query_id"], [F.desc("score"), F.asc("id")], n)
    return page(of_agent(looked_up(hits.drop("rank"), observations, memories), agent), n, form, budget)


def smart_search(fused: Callable[[int], DataFrame], observations: DataFrame, memories: DataFrame, limit: int | None = None, agent: str | None = None) -> DataFrame:
    """Hybrid search as compact rows: fused(k) gives the k best; with an agent filter more are asked for and then filtered."""
    n = clamp("smart", limit)
    hits = s.top(fused(over_fetch("smart", n, agent is not None)), ["query_id"], [F.desc("score"), F.asc("id")], over_fetch("smart", n, agent is not None)).drop("rank")
    session_of = observations.select("id", "session").unionByName(memories.select("id", "session"))
    return page(of_agent(looked_up(hits.join(session_of, "id", "left"), observations, memories), agent), n, "compact")


def expand(wanted: DataFrame, observations: DataFrame, agent: str | None = None) -> DataFrame:
    """Observations in full of wanted(query_id, at, id): the first 20 asked for in each request, in order, of the agent's rows only."""
    first = s.top(wanted, ["query_id"], [F.asc("at")], LIMITS["expand"][2], "_n").drop("_n")
    return of_agent(first.join(observations, "id"), agent)


def preview(text: Column, n: int = PREVIEW) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def indexable(memories: DataFrame, observations: DataFrame) -> DataFrame:
    """(id, session, text) of what a rebuilt index holds: memories that aren't superseded and have a title and content, observations with title and narrative.

    A memory whose state isn't known counts as the latest; one without a session is of the session `memory`.
    """
    m = memories.where(~F.coalesce(F.col("is_latest") == F.lit(False), F.lit(False)) & (F.coalesce("title", F.lit("")) != "") & (F.coalesce("content", F.lit("")) != ""))
    o = observations.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("narrative", F.lit("")) != ""))
    return m.select("id", F.coalesce(F.col("session").cast("string"), F.lit("memory")).alias("session"), tx.document_text("title", "content").alias("text")).unionByName(
        o.select("id", F.col("session").cast("string").alias("session"), tx.document_text("title", "narrative", "type").alias("text"))
    )


def migrate_vectors(vectors: DataFrame, texts: DataFrame, dims: int, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """vectors(id, v) of the wanted length; those of another are made again from texts(id, text), and those without a text go."""
    wrong = vectors.where(F.size("v") != dims).select("id").join(texts, "id")
    return vectors.where(F.size("v") == dims).select("id", "v").unionByName(wrong.select("id", embedded(F.col("text"), dims, embed).alias("v")))


# ---- what a model would do: callables, each with a form that needs none


def hash_embedding(text: str, dims: int) -> list[float]:
    """Counts of the words' hashes, of length 1; zero without a word."""
    import math
    import zlib

    v = [0.0] * dims
    for w in text.lower().split():
        h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        v[h % dims] += 1.0 if h >> 31 else -1.0
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


def embedded(text: Column, dims: int, embed: Callable[[list[str]], list[list[float]]] | None = None) -> Column:
    """Vectors of texts by a callable on batches, else by hash; null texts count as empty."""
    make = embed or (lambda texts: [hash_embedding(t, dims) for t in texts])

    @F.pandas_udf("array<double>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series([list(map(float, v)) for v in make([t if isinstance(t, str) else "" for t in x])])

    return of(text)


#: Results that are ranked again, and characters of a text that the model sees.
RERANKED, SEEN = 20, 512


def rerank(hits: DataFrame, queries: DataFrame, model: Callable[[list[tuple[str, str]]], list[float]] | None = None, first: int = RERANKED) -> DataFrame:
    """hits(query_id, id, score, rank, title, narrative) with the first of each query in the order of a model's scores of (query, text).

    Without a model the order stays. What comes after the first keeps its place; ties go by the old rank.
    """
    if model is None:
        return hits
    ship(hits.sparkSession)

    @F.pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in parts:
            yield pd.Series(list(map(float, model(list(zip(q, t))))))

    text = F.substring(F.concat_ws(" ", "title", "narrative"), 1, SEEN)
    asked = hits.where(F.col("rank") <= first).join(queries.select("query_id", F.col("text").alias("_q")), "query_id").withColumn("_s", scored(F.col("_q"), text))
    w = Window.partitionBy("query_id").orderBy(F.desc("_s"), "rank")
    ranked = asked.withColumn("_r", F.row_number().over(w).cast("long")).select(*[F.col("_r").alias("rank") if c == "rank" else F.col(c) for c in hits.columns])
    return ranked.unionByName(hits.where(F.col("rank") > first))
