"""Registered queries: how single records are made, merged, imported and listed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..functions import text as tx
from ..operators import context as cx
from ..operators import lifecycle as lc
from ..operators import sequences as q
from ..operators import work as wk
from ..sources import tables as src
from ..sources.tables import table
from .lifecycle import _WORK, _work
from .registry import query


@query(
    """WITH s AS (SELECT n_nationkey AS step, lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS dep FROM nation)
SELECT 'r1:' || step AS id, CASE WHEN dep IS NULL THEN 'pending' ELSE 'blocked' END AS status, 'r1:' || dep AS requires FROM s"""
)
def routine_run(spark, sf_dir):
    """A run of a routine: an action for each step, blocked while its step before isn't done."""
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    before = F.lag("n_nationkey").over(w).cast("string")
    steps = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("step"), F.filter(F.array(before), lambda x: x.isNotNull()).alias("depends_on"))
    actions, edges = wk.instantiate(steps, F.lit("r1"))
    return actions.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("requires")), "id", "left").select("id", "status", "requires")


@query(
    _WORK + """, mine AS (SELECT * FROM edges UNION ALL SELECT id, id, 'requires' FROM actions WHERE id % 50 = 0 UNION ALL SELECT id, id + 1, 'likes' FROM actions WHERE id % 60 = 0),
sound AS (SELECT src, dst, type FROM mine WHERE type IN ('requires', 'unlocks', 'spawned_by', 'gated_by', 'conflicts_with') AND src <> dst AND src IN (SELECT id FROM actions) AND (type = 'gated_by' OR dst IN (SELECT id FROM actions)))
SELECT type, count(*) AS n FROM sound GROUP BY type"""
)
def action_edges(spark, sf_dir):
    """Edges that may be made: known kinds, two different actions that are there."""
    actions, edges, _ = _work(spark, sf_dir)
    i = F.col("id")
    more = actions.where(i % 50 == 0).select(i.alias("src"), i.alias("dst"), F.lit("requires").alias("type")).unionByName(actions.where(i % 60 == 0).select(i.alias("src"), (i + 1).alias("dst"), F.lit("likes").alias("type")))
    return wk.valid_edges(edges.unionByName(more), actions).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, least(10, greatest(1, coalesce(CASE WHEN p_partkey % 6 <> 0 THEN p_size - 5 END, 5))) AS priority FROM part")
def action_priority(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), wk.priority(F.when(F.col("p_partkey") % 6 != 0, F.col("p_size") - 5)).alias("priority"))


@query(
    """SELECT doc_id AS id, substr(text, 1, 80) AS title, 7 AS strength, 1 + (lag(doc_id) OVER w IS NOT NULL)::INT * (row_number() OVER w - 1) AS version, lead(doc_id) OVER w IS NULL AS is_latest,
CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_days((doc_id % 90)::INT) END AS forget_after FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY doc_id)"""
)
def remember_fields(spark, sf_dir):
    """What a remembered text becomes: title, strength, time to live, and a version after each like it."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.md5("text").alias("k"))
    until = F.when(F.col("id") % 3 == 0, F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 90).cast("int")))
    chain = q.version_chain(d, "k", ["id"], "id")
    return chain.select("id", F.substring("text", 1, 80).alias("title"), F.lit(7).alias("strength"), F.col("version").cast("long").alias("version"), "is_latest", until.alias("forget_after"))


@query(
    r"""SELECT item_id, kind, a, b FROM (SELECT item_id, regexp_extract(x, 'type="([^"]*)"', 1) AS kind, regexp_extract(x, 'source="([^"]*)"', 1) AS a, regexp_extract(x, 'target="([^"]*)"', 1) AS b FROM (
SELECT item_id, unnest(regexp_extract_all('<relationship type="uses" source="e' || item_id || '" target="x"/><relationship type="" source="y" target="z"/><fact>f ' || item_id || '</fact>', '<relationship [^>]*/>')) AS x FROM benchmark)) WHERE kind <> ''
UNION ALL SELECT item_id, 'fact', trim(regexp_extract(y, '(?s)<fact>(.*?)</fact>', 1)), NULL FROM (SELECT item_id, unnest(regexp_extract_all('<fact> ' || substr(text, 1, 20) || '</fact><fact>second</fact>', '(?s)<fact>.*?</fact>')) AS y FROM benchmark)"""
)
def xml_relations(spark, sf_dir):
    """Relationships and facts in a model's answer; relationships of no kind are dropped."""
    b = table(spark, sf_dir, "benchmark")
    answer = F.concat(F.lit('<relationship type="uses" source="e'), F.col("item_id").cast("string"), F.lit('" target="x"/><relationship type="" source="y" target="z"/><fact>f '), F.col("item_id").cast("string"), F.lit("</fact>"))
    facts = F.concat(F.lit("<fact> "), F.substring("text", 1, 20), F.lit("</fact><fact>second</fact>"))
    rel = tx.xml_rows(b.select("item_id", answer.alias("answer")), "answer", "relationship", ["type", "source", "target"]).where("type <> ''").select("item_id", F.col("type").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"))
    return rel.unionByName(tx.xml_texts(b.select("item_id", facts.alias("answer")), "answer", "fact").select("item_id", F.lit("fact").alias("kind"), F.col("text").alias("a"), F.lit(None).cast("string").alias("b")))


@query("SELECT user_id AS session, (n - 1) // 400 AS chunk, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY ALL")
def summarize_chunks(spark, sf_dir):
    """Chunks of 400 observations of a session, each summarised by itself and then together."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "event_id", F.floor((F.row_number().over(w) - 1) / 400).alias("chunk"))
    return e.groupBy("session", "chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(
    """SELECT doc_id, least(100, CASE WHEN length(substr(text, 1, 12)) >= 5 THEN 20 ELSE 0 END + CASE WHEN length(text) >= 20 THEN 25 ELSE 0 END + CASE WHEN length(text) >= 100 THEN 5 ELSE 0 END + CASE WHEN doc_id % 3 > 0 THEN 20 ELSE 0 END + CASE WHEN doc_id % 4 > 0 THEN 15 ELSE 0 END + 15) AS summary,
least(100, CASE WHEN length(text) > 0 THEN 20 ELSE 0 END + CASE WHEN contains(lower(text), lower(lang)) THEN 20 ELSE 0 END + CASE WHEN contains(text, '<') THEN 15 ELSE 0 END + CASE WHEN s >= 2 THEN 15 ELSE 0 END + CASE WHEN s >= 4 THEN 10 ELSE 0 END + CASE WHEN length(text) >= 100 THEN 10 ELSE 0 END + CASE WHEN length(text) >= 500 THEN 10 ELSE 0 END) AS context
FROM (SELECT *, len(regexp_extract_all(text, '<[A-Za-z0-9_]+>')) AS s FROM documents)"""
)
def quality_scores(spark, sf_dir):
    """The rubrics of summaries and of contexts."""
    i = F.col("doc_id")
    some = lambda n: F.when(i % n > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", sc.summary_quality(F.substring("text", 1, 12), F.col("text"), some(3), some(4), F.array("source")).alias("summary"), sc.context_quality(F.col("text"), F.col("lang")).alias("context"))


@query(
    """SELECT event_id, CASE WHEN a = b THEN coalesce(sum(300) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE (epoch_us(t) - epoch_us(a)) // 1000 END::BIGINT AS offset_ms FROM (
SELECT *, min(t) OVER (PARTITION BY user_id) AS a, max(t) OVER (PARTITION BY user_id) AS b FROM (SELECT event_id, user_id, CASE WHEN user_id % 4 = 0 THEN TIMESTAMP '2024-01-01' ELSE ts END AS t FROM events))"""
)
def replay_clock(spark, sf_dir):
    """Offsets by the clock, or by durations in sessions whose events all have one time."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("user_id") % 4 == 0, F.lit("2024-01-01").cast("timestamp_ntz")).otherwise(F.col("ts")).alias("t"), F.lit(300).alias("ms"))
    return q.replay_timeline(e, "user_id", "t", "event_id", "ms").select("event_id", "offset_ms")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, p_size + 100 FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0")
def import_skip(spark, sf_dir):
    """Rows that are there stay, others come in."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return src.merge_import(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 2 = 0").withColumn("p_size", F.col("p_size") + 100), "p_partkey", "skip")


@query("SELECT p_partkey, p_size + 100 AS p_size FROM part WHERE p_partkey % 2 = 0")
def import_replace(spark, sf_dir):
    """Only what comes in is left."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return src.merge_import(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 2 = 0").withColumn("p_size", F.col("p_size") + 100), "p_partkey", "replace")


@query(
    """SELECT o_custkey AS session_id, count(*) AS observation_count, min(o_orderdate) AS started_at, max(o_orderdate) AS ended_at, coalesce(min(CASE WHEN o_orderkey % 3 <> 0 THEN 'old' END), 'new') AS status FROM orders GROUP BY 1"""
)
def import_sessions(spark, sf_dir):
    """Sessions after an import of more of their observations."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), "o_orderkey", "o_orderdate")

    def part(rows, status):
        return rows.groupBy("session_id").agg(F.count("*").alias("observation_count"), F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("ended_at"), F.lit("p").alias("project"), F.lit(None).cast("string").alias("first_prompt"), F.lit(status).alias("status"))

    return src.merged_sessions(part(o.where("o_orderkey % 3 <> 0"), "old"), part(o.where("o_orderkey % 3 = 0"), "new")).select("session_id", "observation_count", "started_at", "ended_at", "status")


@query("SELECT c_custkey AS session, count(o_orderkey) AS n FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 40 OFFSET 25) LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def export_sessions(spark, sf_dir):
    """A page of an export, with the rows that belong to its sessions."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), "o_orderkey")
    page, _ = src.export_page(c, {"orders": o}, offset=25, most=40)
    return page["sessions"].join(page["orders"], "session", "left").groupBy("session").agg(F.count("o_orderkey").alias("n"))


@query(
    """WITH t AS (SELECT *, doc_id % 4 AS refs, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents),
f AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM t WHERE refs = 0 AND doc_id < 900) SELECT source, doc_id FROM f WHERE total - earlier > 20000"""
)
def quota_with_grace(spark, sf_dir):
    """Files that go for a quota: nothing refers to them and they weren't touched lately."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", (F.col("doc_id") % 4).alias("refs"))
    return lc.over_quota(d, ["source"], "doc_id", "doc_id", "n_chars", 20_000, F.lit(900), "refs").select("source", "doc_id")


@query(
    """SELECT project, id, paged_out FROM (SELECT p_brand AS project, p_partkey AS id, p_partkey % 10 <> 0 AND sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey % 10 = 0 DESC, floor(round(p_size / 50.0::DOUBLE / 0.2, 6)) DESC, p_retailprice DESC, p_partkey) > 200 AS paged_out FROM part WHERE p_partkey % 4 <> 1)"""
)
def archival_context(spark, sf_dir):
    """Latest memories by steps of strength and then the newest, and which of them don't fit the archive's budget."""
    p = table(spark, sf_dir, "part").where("p_partkey % 4 <> 1").select(F.col("p_brand").alias("project"), F.col("p_partkey").alias("id"), "p_size", "p_retailprice", (F.col("p_partkey") % 10 == 0).alias("pinned"), cx.strength_step(F.col("p_size") / 50.0).alias("step"))
    w = Window.partitionBy("project").orderBy(F.desc("pinned"), F.desc("step"), F.desc("p_retailprice"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return p.select("project", "id", (~F.col("pinned") & (F.sum("p_size").over(w) > 200)).alias("paged_out"))
