"""Property-graph operators: nodes(id, ...) and edges(id, src, dst, type, weight, ...)."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .search import top
from .sequences import fold_in_order


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways, as (a, b, weight)."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """Ends of edges at each node; a self-loop counts twice."""
    return undirected(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))


def neighbour_degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy(F.col("a").alias("id")).agg(F.count_distinct("b").alias("neighbours"))


def snapshot(edges: DataFrame, k: int = 500) -> tuple[DataFrame, DataFrame]:
    """The k nodes of highest degree and the edges with both ends among them."""
    nodes = degrees(edges).orderBy(F.desc("degree"), "id").limit(k)
    ids = F.broadcast(nodes.select("id"))  # k rows
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, kept


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, id, hops) within `depth` undirected hops of starts(start), by frontier joins."""
    both = undirected(edges).select("a", "b").distinct()
    seen = starts.select("start", F.col("start").alias("id"), F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.join(both, F.col("id") == F.col("a")).select("start", F.col("b").alias("id")).distinct()
        frontier = step.join(seen, ["start", "id"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def cost(weight: Column) -> Column:
    return 1.0 / F.greatest(weight, F.lit(0.01))


def two_hop_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Cheapest paths of one or two hops from starts(start): start, id, cost, nodes, score.

    The score is the mean weight of the path over its number of nodes. Of equally cheap paths the shorter
    one counts, then the one through the smaller node.
    """
    e = undirected(edges).groupBy("a", "b").agg(F.max("weight").alias("w"))
    first = starts.join(e, F.col("start") == F.col("a")).select("start", F.col("b").alias("mid"), F.col("w").alias("w1"))
    one = first.where("mid <> start").select("start", F.col("mid").alias("id"), cost(F.col("w1")).alias("cost"), F.lit(2).alias("nodes"), F.col("w1").alias("mean"), F.col("mid").alias("via"))
    two = first.where("mid <> start").join(e, F.col("mid") == F.col("a")).where("b <> start and b <> mid")
    two = two.select("start", F.col("b").alias("id"), (cost(F.col("w1")) + cost(F.col("w"))).alias("cost"), F.lit(3).alias("nodes"), ((F.col("w1") + F.col("w")) / 2).alias("mean"), F.col("mid").alias("via"))
    best = one.unionByName(two).groupBy("start", "id").agg(F.min_by(F.struct("cost", "nodes", "mean"), F.struct(F.round("cost", 9), "nodes", "via")).alias("p"))
    return best.select("start", "id", F.round("p.cost", 6).alias("cost"), "p.nodes", F.round(F.col("p.mean") / F.col("p.nodes"), 6).alias("score"))


def bounded_dijkstra(edges: list[tuple[object, object, float]], start: object, depth: int) -> dict[object, tuple[float, int]]:
    """Cost and hops of each node when a path may be extended only if its cheapest form has fewer than `depth` hops.

    That is not the cheapest path of so many hops: a node reached cheaply at the limit cannot go on even
    if a dearer, shorter path to it could.
    """
    around: dict = {}
    for a, b, w in edges:
        around.setdefault(a, []).append((b, 1 / max(w, 0.01)))
        around.setdefault(b, []).append((a, 1 / max(w, 0.01)))
    best, heap, done = {start: (0.0, 0)}, [(0.0, 0, start)], set()
    turn = 0
    while heap:
        c, _, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        hops = best[node][1]
        if hops >= depth:
            continue
        for other, d in around.get(node, ()):
            if other not in done and (other not in best or c + d < best[other][0]):
                best[other] = (c + d, hops + 1)
                turn += 1
                heapq.heappush(heap, (c + d, turn, other))
    return best


def compatible_paths(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, id, cost, hops) by bounded_dijkstra(): each start meets the edges within its reach, one start a task group."""
    ids = reachable(edges, starts, depth - 1).select("start", "id").distinct()
    near = undirected(edges).join(ids, F.col("a") == F.col("id")).select("start", "a", "b", "weight")

    def of(group: pd.DataFrame) -> pd.DataFrame:
        start = group["start"].iloc[0]
        found = bounded_dijkstra(list(zip(group["a"], group["b"], group["weight"])), start, depth)
        return pd.DataFrame([(start, i, c, h) for i, (c, h) in found.items() if i != start], columns=["start", "id", "cost", "hops"])

    kind = dict(starts.dtypes)["start"]
    return near.groupBy("start").applyInPandas(of, f"start {kind}, id {kind}, cost double, hops int")


def bounded_two_hops(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id, cost, hops, mean): bounded_dijkstra() to depth 2, by joins, with the mean weight of each path.

    A neighbour to which a way over another neighbour is cheaper has two hops in its cheapest form and so can't go on,
    unless that other one can't either. Only triangles decide that, in ascending order of direct cost; they
    are streamed. Of equally cheap paths the direct one counts, then that through the smaller node.
    """
    e = undirected(edges).where("a <> b").groupBy("a", "b").agg(F.max("weight").alias("w"))
    direct = starts.select("start").distinct().join(e, F.col("start") == F.col("a")).select("start", F.col("b").alias("mid"), F.col("w").alias("w1"), cost(F.col("w")).alias("c1"))
    over = direct.join(e, F.col("mid") == F.col("a")).where("b <> start").select("start", "mid", "w1", "c1", F.col("b").alias("id"), "w", (F.col("c1") + cost(F.col("w"))).alias("c"))
    cheaper = over.join(direct.select("start", F.col("mid").alias("id"), F.col("c1").alias("direct")), ["start", "id"]).where("c < direct")

    def step(closed, row):
        closed = closed or set()
        _, node, through = row
        if node in closed or through in closed:
            return closed, None
        return closed | {node}, (node,)

    kind = dict(over.dtypes)["id"]
    closed = fold_in_order(cheaper, ["start"], ["direct", "id", "mid"], ["direct", "id", "mid"], step, f"mid {kind}")
    two = over.join(closed, ["start", "mid"], "left_anti").select("start", "id", F.col("c").alias("cost"), F.lit(2).alias("hops"), ((F.col("w1") + F.col("w")) / 2).alias("mean"), F.col("mid").alias("via"))
    one = direct.select("start", F.col("mid").alias("id"), F.col("c1").alias("cost"), F.lit(1).alias("hops"), F.col("w1").alias("mean"), F.col("mid").alias("via"))
    best = one.unionByName(two).groupBy("start", "id").agg(F.min_by(F.struct("cost", "hops", "mean"), F.struct(F.round("cost", 9), "hops", "via")).alias("p"))
    return best.select("start", "id", "p.*")


def named_like(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id): nodes(id, name) whose name contains an entity of asked(query_id, entity) or is part of one, whatever the case.

    Two equality joins: on the parts of names that are as long as an entity, and on the parts of entities.
    """
    names = nodes.select("id", F.lower("name").alias("name")).where(F.col("name") != "")
    words = asked.select("query_id", F.lower("entity").alias("entity")).where(F.col("entity") != "").distinct()
    lengths = sorted(r[0] for r in words.select(F.length("entity")).distinct().collect())
    if not lengths:
        return names.join(words, F.col("name") == F.col("entity")).select("query_id", "id")
    cuts = F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("name")))
    places = F.explode(F.sequence(F.lit(1), F.length("name") - F.col("n") + 1))
    inside = names.withColumn("n", cuts).withColumn("at", places).select("id", F.substring(F.col("name"), F.col("at"), F.col("n")).alias("entity")).distinct()
    parts = words.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("entity")))).withColumn("n", F.explode(F.sequence(F.lit(1), F.length("entity") - F.col("at") + 1)))
    parts = parts.select("query_id", F.substring(F.col("entity"), F.col("at"), F.col("n")).alias("name")).distinct()
    return inside.join(words, "entity").select("query_id", "id").unionByName(names.join(parts, "name").select("query_id", "id")).distinct()


def entity_hits(nodes: DataFrame, edges: DataFrame, provenance: DataFrame, asked: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, id, score, rank): observations near the nodes that entities name, the k best.

    provenance(id, obs) has a row for each observation of a node. One at the end of a path counts the path's mean weight over
    its number of nodes, one of a named node itself 1, unless a path of a node before, by id, or of the node
    itself has reached it already. Ties go by observation.
    """
    named = named_like(nodes, asked)
    paths = bounded_two_hops(edges, named.select(F.col("id").alias("start")))
    reached = paths.join(provenance, "id").select("start", F.lit(0).alias("own"), "cost", F.col("id").alias("node"), "obs", (F.col("mean") / (F.col("hops") + 1)).alias("score"))
    kind = dict(nodes.dtypes)["id"]
    itself = provenance.join(named.select("id").distinct(), "id").select(F.col("id").alias("start"), F.lit(1).alias("own"), F.lit(0.0).alias("cost"), F.col("id").cast(kind).alias("node"), "obs", F.lit(1.0).alias("score"))
    met = named.withColumnRenamed("id", "start").join(reached.unionByName(itself), "start")
    first = met.groupBy("query_id", F.col("obs").alias("id")).agg(F.round(F.min_by("score", F.struct("start", "own", F.round("cost", 9), "node")), 6).alias("score"))
    return top(first, ["query_id"], [F.desc("score"), F.asc("id")], k)


def expansion_hits(edges: DataFrame, provenance: DataFrame, seeds: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): other observations one hop from the nodes of seeds(query_id, obs); each counts 0.5 over 3."""
    linked = seeds.join(provenance, "obs").select("query_id", F.col("id").alias("a")).distinct()
    near = linked.join(undirected(edges).where("a <> b").select("a", "b").distinct(), "a").select("query_id", F.col("b").alias("id")).distinct()
    found = near.join(provenance, "id").select("query_id", "obs").distinct().join(seeds.select("query_id", "obs"), ["query_id", "obs"], "left_anti")
    return top(found.select("query_id", F.col("obs").alias("id"), F.lit(0.5 / 3).alias("score")), ["query_id"], [F.asc("id")], k)


def appended(streams: list[DataFrame]) -> DataFrame:
    """(query_id, id, rank, score) of ranked lists one after another, as a bag: what is in several has several rows."""
    out, before = None, None
    for i, df in enumerate(streams):
        rows = df.select("query_id", "id", "score", F.col("rank").alias("_r"), F.lit(i).alias("_i"))
        out = rows if out is None else out.unionByName(rows)
    sizes = out.groupBy("query_id", "_i").agg(F.max("_r").alias("_n"))
    w = Window.partitionBy("query_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return out.join(before, ["query_id", "_i"]).select("query_id", "id", (F.col("_before") + F.col("_r")).cast("long").alias("rank"), "score")


def query_page(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 3, node_type: str | None = None, limit: int = 500, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of the nodes within `depth` hops (5 at most) of each start, nearest first, and the edges between nodes of the page.

    The type filters what is returned, not what is walked through.
    """
    found = reachable(edges, starts, min(depth or 3, 5)).join(nodes, "id")
    if node_type is not None:
        found = found.where(F.col("type") == node_type)
    w = Window.partitionBy("start").orderBy("hops", "id")
    shown = found.withColumn("_n", F.row_number().over(w)).where((F.col("_n") > offset) & (F.col("_n") <= offset + limit)).drop("_n")
    ends = shown.select("start", F.col("id").alias("src")), shown.select("start", F.col("id").alias("dst"))
    between = edges.join(ends[0], "src").join(ends[1], ["start", "dst"])
    return shown, between


def text_matches(nodes: DataFrame, text: str, properties: str = "properties") -> DataFrame:
    """Nodes whose name, or any property that is a string, contains a text, whatever the case."""
    has = lambda c: F.lower(c).contains(text.lower())
    return nodes.where(has(F.col("name")) | F.coalesce(F.exists(F.map_values(properties), has), F.lit(False)))


def grown_snapshot(degree: DataFrame, added: DataFrame, k: int = 500) -> tuple[DataFrame, DataFrame]:
    """Degrees after more edges, from degree(id, degree) and the added ones alone, and the k nodes of highest degree."""
    total = degree.unionByName(degrees(added)).groupBy("id").agg(F.sum("degree").alias("degree"))
    return total, total.orderBy(F.desc("degree"), "id").limit(k)


def concept_clusters(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(cluster, seed, id): concepts within two hops of a seed, `most` clusters of two or more.

    Seeds are concepts that no cluster, or lone seed, has taken yet, in order of their neighbours, then of id; the ways go through any
    node. Each round works out one seed's reach, so rounds are as few as clusters, and
    seeds whose reach holds no other concept are passed over all at once.
    """
    concepts = nodes.where("type = 'concept'").select("id")
    both = undirected(edges).where("a <> b").select("a", "b").distinct()
    reach = concepts.select(F.col("id").alias("start"))
    near = checkpointed(reachable(edges, reach, 2).join(concepts, "id").select("start", "id"))
    sizes = near.groupBy("start").agg(F.count("*").alias("n"))
    order = concepts.join(both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    order = order.join(sizes.where("n >= 2").select(F.col("start").alias("id")), "id")
    taken: list = []
    out = None
    for c in range(most):
        left = order if out is None else order.join(out.select("id"), "id", "left_anti")
        seed = left.orderBy(F.desc("d"), "id").first()
        if seed is None:
            break
        taken.append(seed["id"])
        own = near.where(F.col("start") == seed["id"]).select(F.lit(c).alias("cluster"), F.lit(seed["id"]).alias("seed"), "id")
        out = own if out is None else out.unionByName(own)
    if out is None:
        return near.limit(0).select(F.lit(0).alias("cluster"), F.col("start").alias("seed"), "id")
    return out


def upsert(items: DataFrame, key: list[str], order: str, sources: str, properties: str) -> DataFrame:
    """One row per key: provenance sets united, of a property the last value."""
    return items.groupBy(*key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(sources)))).alias(sources),
        F.map_from_entries(
            F.aggregate(
                F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.map_entries(properties).alias("p")))),
                F.array().cast("array<struct<key: string, value: string>>"),
                # right-biased: what comes later takes the place of its key
                lambda m, x: F.concat(F.filter(m, lambda old: ~F.exists(x["p"], lambda new: new["key"] == old["key"])), x["p"]),
            )
        ).alias(properties),
    )


# ---- time


def superseded(edges: DataFrame, key: list[str], at: str, id_col: str) -> DataFrame:
    """version, end of validity and is_latest of each edge: one of the same key ends it."""
    w = Window.partitionBy(*key).orderBy(at, id_col)
    return edges.withColumns({"version": F.row_number().over(w), "tvalid_end": F.lead(at).over(w), "is_latest": F.lead(id_col).over(w).isNull()})


def as_of(edges: DataFrame, t: Column, commit: str = "tcommit", valid: str = "tvalid", end: str = "tvalid_end") -> DataFrame:
    """Edges that were known and valid at t; bounds belong to it."""
    return edges.where((F.col(commit) <= t) & (F.col(valid).isNull() | (F.col(valid) <= t)) & (F.col(end).isNull() | (F.col(end) >= t)))


def latest_per_key(edges: DataFrame, key: list[str], at: str, id_col: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(at), F.asc(id_col))
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def related(links: DataFrame, starts: DataFrame, hops: int = 2, least: float = 0.0) -> DataFrame:
    """(start, id, hop, confidence) of memories linked within `hops`: the best confidence of a link to what was reached before, else 0.5."""
    both = links.select(F.col("src").alias("a"), F.col("dst").alias("b"), "confidence").unionByName(links.select(F.col("dst").alias("a"), F.col("src").alias("b"), "confidence"))
    seen = starts.select("start", F.col("start").alias("id"), F.lit(0).alias("hop"), F.lit(1.0).alias("confidence"))
    frontier = seen
    for hop in range(1, min(hops, 5) + 1):
        step = frontier.select("start", "id").join(both, F.col("id") == F.col("a")).groupBy("start", F.col("b").alias("id")).agg(F.coalesce(F.max("confidence"), F.lit(0.5)).alias("confidence"))
        frontier = step.join(seen, ["start", "id"], "left_anti").select("start", "id", F.lit(hop).alias("hop"), "confidence")
        seen = seen.unionByName(frontier)
    return seen.where((F.col("hop") > 0) & (F.col("confidence") >= least))
