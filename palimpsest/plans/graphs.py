"""Registered queries: graph traversal and edges in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import search as s
from ..sources.tables import table
from .registry import query

_EDGES = """WITH edges AS (
SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'in' AS type, 0.1::DOUBLE + (c_custkey % 10) / 10.0::DOUBLE AS weight FROM customer UNION ALL
SELECT 's' || s_suppkey, 'n' || s_nationkey, 'at', 0.2::DOUBLE + (s_suppkey % 5) / 10.0::DOUBLE FROM supplier UNION ALL
SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'of', 0.5::DOUBLE FROM nation),
u AS (SELECT src AS a, dst AS b, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"""


def _edges(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    one = lambda t, a, b, kind, w: table(spark, sf_dir, t).select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"), w.alias("weight"))
    return (
        one("customer", key("c", "c_custkey"), key("n", "c_nationkey"), "in", F.lit(0.1) + (F.col("c_custkey") % 10) / 10.0)
        .unionByName(one("supplier", key("s", "s_suppkey"), key("n", "s_nationkey"), "at", F.lit(0.2) + (F.col("s_suppkey") % 5) / 10.0))
        .unionByName(one("nation", key("n", "n_nationkey"), key("r", "n_regionkey"), "of", F.lit(0.5)))
    )


@query(_EDGES + " SELECT id, degree FROM (SELECT a AS id, count(*) AS degree FROM u GROUP BY a) ORDER BY degree DESC, id LIMIT 500")
def graph_degree_snapshot(spark, sf_dir):
    return g.snapshot(_edges(spark, sf_dir))[0]


@query(
    _EDGES + """, t AS (SELECT id FROM (SELECT a AS id, count(*) AS d FROM u GROUP BY a) ORDER BY d DESC, id LIMIT 40)
SELECT src, dst, type, weight FROM edges WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)"""
)
def graph_snapshot_edges(spark, sf_dir):
    return g.snapshot(_edges(spark, sf_dir), 40)[1].select("src", "dst", "type", "weight")


@query(_EDGES + " SELECT type, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY type")
def graph_stats(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query(_EDGES + " SELECT a AS id, count(DISTINCT b) AS neighbours FROM u GROUP BY a")
def neighbour_degree(spark, sf_dir):
    return g.neighbour_degrees(_edges(spark, sf_dir))


@query(
    _EDGES + """, d AS (SELECT DISTINCT a, b FROM u), s AS (SELECT DISTINCT dst AS start FROM edges WHERE type = 'of'),
h1 AS (SELECT start, b AS id FROM s JOIN d ON a = start), h2 AS (SELECT DISTINCT start, b AS id FROM h1 JOIN d ON a = id WHERE b <> start)
SELECT start, id, min(hops) AS hops FROM (SELECT start, start AS id, 0 AS hops FROM s UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL"""
)
def graph_khop(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return g.reachable(e, e.where("type = 'of'").select(F.col("dst").alias("start")).distinct(), 2)


@query(
    _EDGES + """, e AS (SELECT a, b, max(weight) AS w FROM u GROUP BY ALL), s AS (SELECT DISTINCT dst AS start FROM edges WHERE type = 'of'),
f AS (SELECT start, b AS mid, w AS w1 FROM s JOIN e ON a = start),
p AS (SELECT start, mid AS id, 1 / greatest(w1, 0.01) AS cost, 2 AS nodes, w1 AS mean, mid AS via FROM f UNION ALL
SELECT start, b, 1 / greatest(w1, 0.01) + 1 / greatest(w, 0.01), 3, (w1 + w) / 2, mid FROM f JOIN e ON a = mid WHERE b <> start)
SELECT start, id, round(cost, 6) AS cost, nodes, round(mean / nodes, 6) AS score FROM (
SELECT *, row_number() OVER (PARTITION BY start, id ORDER BY round(cost, 9), nodes, via) AS n FROM p) WHERE n = 1"""
)
def graph_shortest2(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return g.two_hop_paths(e, e.where("type = 'of'").select(F.col("dst").alias("start")).distinct())


_LINKS = """WITH l AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 100000000 AS dst, round(0.3::DOUBLE + (l_partkey % 7) / 10.0::DOUBLE, 6) AS confidence FROM lineitem),
b AS (SELECT src AS a, dst AS b, confidence FROM l UNION ALL SELECT dst, src, confidence FROM l), s AS (SELECT p_partkey AS start FROM part WHERE p_partkey % 50 = 0),
h1 AS (SELECT start, b AS id, max(confidence) AS confidence FROM s JOIN b ON a = start GROUP BY ALL),
h2 AS (SELECT start, b AS id, max(b.confidence) AS confidence FROM h1 JOIN b ON b.a = h1.id WHERE b <> start GROUP BY ALL)"""


@query(
    _LINKS + """ SELECT start, id, 1 AS hop, confidence FROM h1 WHERE confidence >= 0.5 UNION ALL
SELECT start, id, 2, confidence FROM h2 WHERE confidence >= 0.5 AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.start = h2.start AND h1.id = h2.id)"""
)
def related_bfs(spark, sf_dir):
    """Asked from the parts that 50 divides, over all links."""
    l = table(spark, sf_dir, "lineitem")
    links = l.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100_000_000).alias("dst"), F.round(F.lit(0.3) + (F.col("l_partkey") % 7) / 10.0, 6).alias("confidence")).distinct()
    starts = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("start"))
    return g.related(links, starts, 2, 0.5)


# ---- edges in time: a customer's orders of one status succeed each other

_TIMED = """WITH t AS (SELECT o_orderkey AS id, o_custkey AS src, o_orderstatus AS dst, o_orderdate AS tcommit, row_number() OVER w AS version,
lead(o_orderdate) OVER w AS tvalid_end, lead(o_orderkey) OVER w IS NULL AS is_latest FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey))"""


def _timed(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("dst"), F.col("o_orderdate").alias("tcommit"))
    return g.superseded(e, ["src", "dst"], "tcommit", "id")


@query(_TIMED + " SELECT * FROM t")
def edge_supersession(spark, sf_dir):
    return _timed(spark, sf_dir)


@query(
    _TIMED + """ SELECT id, src, dst, tcommit FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY tcommit DESC, id) AS n FROM t
WHERE tcommit <= TIMESTAMP '1998-06-01' AND (tvalid_end IS NULL OR tvalid_end >= TIMESTAMP '1998-06-01')) WHERE n = 1"""
)
def edge_asof(spark, sf_dir):
    t = F.lit("1998-06-01").cast("timestamp_ntz")
    held = g.as_of(_timed(spark, sf_dir).withColumn("tvalid", F.col("tcommit")), t)
    return g.latest_per_key(held, ["src", "dst"], "tcommit", "id").select("id", "src", "dst", "tcommit")


@query(_TIMED + " SELECT id, src, dst, tcommit, version FROM t WHERE tcommit BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'")
def edge_timeline(spark, sf_dir):
    return _timed(spark, sf_dir).where("tcommit between timestamp_ntz '1997-01-01' and timestamp_ntz '1997-12-31'").select("id", "src", "dst", "tcommit", "version")


@query(
    _TIMED + """, x AS (SELECT src, dst, tcommit <= TIMESTAMP '1997-01-01' AND (tvalid_end IS NULL OR tvalid_end >= TIMESTAMP '1997-01-01') AS a,
tcommit <= TIMESTAMP '1999-01-01' AND (tvalid_end IS NULL OR tvalid_end >= TIMESTAMP '1999-01-01') AS b, id FROM t)
SELECT src, dst, id, CASE WHEN b THEN 'added' ELSE 'removed' END AS change FROM x WHERE a <> b"""
)
def differential_state(spark, sf_dir):
    """Edges that held at one time but not at the other."""
    at = lambda d: (F.col("tcommit") <= d) & (F.col("tvalid_end").isNull() | (F.col("tvalid_end") >= d))
    a, b = at(F.lit("1997-01-01").cast("timestamp_ntz")), at(F.lit("1999-01-01").cast("timestamp_ntz"))
    return _timed(spark, sf_dir).where(a != b).select("src", "dst", "id", F.when(b, "added").otherwise("removed").alias("change"))


@query(
    """SELECT n_regionkey AS region, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments, max(c_acctbal) AS best
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""
)
def graph_upsert(spark, sf_dir):
    """Entities of the same key become one: sources united, the last property kept."""
    c = table(spark, sf_dir, "customer").join(s.small(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    items = c.select(F.col("n_regionkey").alias("region"), F.array("c_mktsegment").alias("segments"), "c_acctbal", F.create_map(F.lit("best"), F.col("c_acctbal").cast("string")).alias("p"))
    up = g.upsert(items, ["region"], "c_acctbal", "segments", "p")
    return up.select("region", F.array_join("segments", ",").alias("segments"), F.col("p")["best"].cast("double").alias("best"))
