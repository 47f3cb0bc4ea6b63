"""Registered queries: profiles, patterns, facets, timelines, sessions, quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..operators import search as s
from ..operators import sequences as q
from ..sources.tables import table
from .registry import query

_K = "(props::JSON ->> 'k')"


def _k():
    return F.get_json_object("props", "$.k")


# ---- sessions and timelines


@query(
    """SELECT user_id, count(*) AS observations, min(ts) AS started_at, max(ts) AS ended_at, arg_min(event_type, (ts, event_id)) AS first_type,
count_if(event_type = 'error') AS errors FROM events GROUP BY user_id"""
)
def session_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(
        F.count("*").alias("observations"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
        F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.count_if(F.col("event_type") == "error").alias("errors"),
    )


@query(
    r"""SELECT conv_id, count(*) AS turns, substr(trim(regexp_replace(arg_min(text, turn) FILTER (role = 'user' AND trim(text) <> ''), '\s+', ' ', 'g')), 1, 200) AS first_prompt
FROM conversations GROUP BY conv_id"""
)
def first_prompts(spark, sf_dir):
    said = (F.col("role") == "user") & (F.trim("text") != "")
    first = F.min_by(F.when(said, F.col("text")), F.when(said, F.col("turn")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.substring(F.trim(F.regexp_replace(first, r"\s+", " ")), 1, 200).alias("first_prompt"))


@query(
    """WITH n AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
a AS (SELECT user_id, arg_min(n, (abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), n)) AS mid FROM n GROUP BY user_id)
SELECT user_id, event_id, ts, n - mid AS position FROM n JOIN a USING (user_id) WHERE n - mid BETWEEN -5 AND 5"""
)
def timeline_anchor(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return q.around_anchor(e, "user_id", "ts", "event_id", F.lit("2024-01-15 12:00:00").cast("timestamp")).withColumn("position", F.col("position").cast("long"))


@query(
    """SELECT conv_id, turn, coalesce(array_to_string(array_agg(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS previous,
coalesce(array_to_string(array_agg(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ','), '') AS following FROM conversations"""
)
def context_window_3_2(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    w = q.context_window(c, "conv_id", "turn", "role")
    return w.select("conv_id", "turn", F.array_join("previous", ",").alias("previous"), F.array_join("following", ",").alias("following"))


_FOLLOW = f"""WITH s AS (SELECT user_id, event_id, ts, event_type, [{_K}::BIGINT // 10] AS ids FROM events WHERE event_type IN ('view', 'click')),
l AS (SELECT *, lag(ts) OVER w AS before_ts, lag(event_type) OVER w AS said, lag(ids) OVER w AS had FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT user_id, event_id, coalesce(epoch_us(ts) - epoch_us(before_ts) <= 3600000000 AND event_type <> said AND NOT list_has_any(ids, had), false) AS followup FROM l)"""


def _followups(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    e = e.withColumn("ids", F.array(F.floor(_k().cast("long") / 10)))
    return q.followups(e, "user_id", "ts", "event_type", "ids", "event_id", 3600).select("user_id", "event_id", "followup")


@query(_FOLLOW + " SELECT * FROM f WHERE followup")
def followup_events(spark, sf_dir):
    return _followups(spark, sf_dir).where("followup")


@query(_FOLLOW + " SELECT count(*) AS searches, count_if(followup) AS followups, round(count_if(followup)::DOUBLE / count(*), 6) AS rate FROM f")
def followup_rate(spark, sf_dir):
    n = F.count_if("followup")
    return _followups(spark, sf_dir).agg(F.count("*").alias("searches"), n.alias("followups"), F.round(n / F.count("*"), 6).alias("rate"))


@query(
    f"""WITH RECURSIVE e AS (SELECT sha256(concat_ws(':', user_id, event_type, {_K}::BIGINT % 3)) AS h, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type, {_K}::BIGINT % 3 ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT h, n, event_id, ts AS last, true AS accepted FROM e WHERE n = 1
UNION ALL SELECT e.h, e.n, e.event_id, CASE WHEN epoch_us(e.ts) - epoch_us(r.last) > 86400000000 THEN e.ts ELSE r.last END, epoch_us(e.ts) - epoch_us(r.last) > 86400000000
FROM r JOIN e ON e.h = r.h AND e.n = r.n + 1) SELECT h AS hash, event_id FROM r WHERE accepted"""
)
def obs_dedup_window(spark, sf_dir):
    """Repeats within a day of the accepted event are dropped; the engine's default is five minutes."""
    h = F.sha2(F.concat_ws(":", "user_id", "event_type", (_k().cast("long") % 3).cast("string")), 256)
    return q.dedup_with_expiry(table(spark, sf_dir, "events").withColumn("hash", h), ["hash"], "ts", "event_id", 86_400)


@query(
    """WITH d AS (SELECT conv_id, turn, least(20000, greatest(300, floor(length(text) / 40.0::DOUBLE * 1000 + 0.5)::INT)) AS ms FROM conversations)
SELECT conv_id, turn, ms, coalesce(sum(ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ms FROM d"""
)
def replay_timeline(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", sc.replay_duration(F.col("text")).alias("ms"))
    return q.replay_offsets(c, "conv_id", "turn", "ms")


@query("SELECT user_id, event_id, n - coalesce(lag(n) OVER (PARTITION BY user_id ORDER BY n), 0) AS delta FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 5 = 0")
def session_deltas(spark, sf_dir):
    """Growth of a session's count from one recorded version to the next."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("n")).where("n % 5 = 0")
    return v.select("user_id", "event_id", (F.col("n") - F.coalesce(F.lag("n").over(Window.partitionBy("user_id").orderBy("n")), F.lit(0))).alias("delta"))


# ---- profiles and patterns


@query(
    f"""WITH newest AS (SELECT user_id FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 20)
SELECT concept, n FROM (SELECT {_K} AS concept, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM newest) GROUP BY 1) ORDER BY n DESC, concept LIMIT 15"""
)
def profile_topk(spark, sf_dir):
    """Concepts of the 20 newest sessions."""
    e = table(spark, sf_dir, "events")
    newest = e.groupBy("user_id").agg(F.max("ts").alias("t")).orderBy(F.desc("t"), "user_id").limit(20)
    seen = e.join(F.broadcast(newest.select("user_id")), "user_id", "left_semi")
    return seen.groupBy(_k().alias("concept")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "concept").limit(15)


@query(
    """SELECT user_id, strftime(ts, '%Y-%m-%d') || ' ' || event_type AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events WHERE value >= 7) WHERE n = 1"""
)
def session_highlights(spark, sf_dir):
    """The most important observation of each session, if important at all."""
    e = table(spark, sf_dir, "events").where("value >= 7")
    best = s.top(e, ["user_id"], [F.desc("value"), F.asc("event_id")], 1)
    return best.select("user_id", F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" "), F.col("event_type")).alias("top"))


@query(
    """SELECT p_brand AS team, p_type AS concept, members, n FROM (SELECT p_brand, p_type, count(DISTINCT p_size) AS members, count(*) AS n,
row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY p_brand, p_type) WHERE r <= 10"""
)
def team_profile(spark, sf_dir):
    n = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("team"), F.col("p_type").alias("concept")).agg(F.count_distinct("p_size").alias("members"), F.count("*").alias("n"))
    return s.top(n, ["team"], [F.desc("n"), F.asc("concept")], 10).drop("rank")


_PAIRS = """WITH f AS (SELECT DISTINCT l_orderkey AS session, l_suppkey AS file FROM lineitem),
p AS (SELECT a.file AS a, b.file AS b, count(*) AS sessions FROM f a JOIN f b ON a.session = b.session AND a.file < b.file GROUP BY ALL HAVING count(*) >= 3)"""


def _pairs(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_suppkey").alias("file")).distinct()
    a, b = f.select("session", F.col("file").alias("a")), f.select("session", F.col("file").alias("b"))
    return a.join(b, "session").where("a < b").groupBy("a", "b").agg(F.count("*").alias("sessions")).where("sessions >= 3")


@query(_PAIRS + " SELECT a, b, sessions FROM p ORDER BY sessions DESC, a, b LIMIT 20")
def patterns_cochange(spark, sf_dir):
    """Pairs that come together in three sessions or more; counted by session."""
    return _pairs(spark, sf_dir).orderBy(F.desc("sessions"), "a", "b").limit(20)


_ERRORS = f"SELECT lower({_K}) AS title, count(*) AS n, count(DISTINCT user_id) AS sessions FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 2"


def _errors(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.groupBy(F.lower(_k()).alias("title")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("sessions")).where("n >= 2")


@query(_ERRORS)
def patterns_error_repeat(spark, sf_dir):
    return _errors(spark, sf_dir)


@query(
    _PAIRS + f""", r AS ({_ERRORS}) SELECT 'When ' || a || ' changes, look at ' || b AS rule, sessions AS frequency FROM p WHERE sessions >= 4
UNION ALL SELECT 'Error ' || title || ' comes again', n FROM r WHERE n >= 3"""
)
def rules(spark, sf_dir):
    c = _pairs(spark, sf_dir).where("sessions >= 4").select(F.format_string("When %d changes, look at %d", "a", "b").alias("rule"), F.col("sessions").alias("frequency"))
    e = _errors(spark, sf_dir).where("n >= 3").select(F.format_string("Error %s comes again", "title").alias("rule"), F.col("n").alias("frequency"))
    return c.unionByName(e)


@query(
    f"""WITH g AS (SELECT lower({_K}) AS concept, event_id, value FROM events WHERE value >= 5),
n AS (SELECT concept FROM g GROUP BY concept HAVING count(*) >= 3 ORDER BY count(*) DESC, concept LIMIT 10)
SELECT concept, event_id, value, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY value DESC, event_id) AS r FROM g JOIN n USING (concept)) WHERE r <= 8"""
)
def consolidation_groups(spark, sf_dir):
    """Concepts with three observations or more, the largest ten, each with its eight most important rows."""
    g = table(spark, sf_dir, "events").where("value >= 5").select(F.lower(_k()).alias("concept"), "event_id", "value")
    n = g.groupBy("concept").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "concept").limit(10)
    return s.top(g.join(F.broadcast(n.select("concept")), "concept"), ["concept"], [F.desc("value"), F.asc("event_id")], 8)


@query(
    """SELECT coalesce(turn::VARCHAR, role, '_ungrouped') AS grp, count(*) AS n, min(conv_id) AS first_id FROM
(SELECT conv_id, CASE WHEN turn > 3 THEN turn END AS turn, CASE WHEN conv_id % 2 = 0 THEN role END AS role FROM conversations) GROUP BY 1"""
)
def action_groups(spark, sf_dir):
    """Groups by parent, else project, else none."""
    key = F.coalesce(F.when(F.col("turn") > 3, F.col("turn").cast("string")), F.when(F.col("conv_id") % 2 == 0, F.col("role")), F.lit("_ungrouped"))
    return table(spark, sf_dir, "conversations").groupBy(key.alias("grp")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first_id"))


@query(
    """SELECT coalesce(nullif(conv_id % 40, 0), conv_id) AS thread, count(*) AS messages, max(turn) AS last_turn, array_to_string(list_sort(list(DISTINCT role)), ',') AS participants
FROM conversations GROUP BY 1 ORDER BY last_turn DESC, thread LIMIT 20"""
)
def signal_threads(spark, sf_dir):
    key = F.coalesce(F.nullif(F.col("conv_id") % 40, F.lit(0)), F.col("conv_id"))
    c = table(spark, sf_dir, "conversations").groupBy(key.alias("thread"))
    n = c.agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("participants"))
    return n.orderBy(F.desc("last_turn"), "thread").limit(20)


# ---- facets

_FACETS = "SELECT p_partkey AS target, unnest(['brand', 'type', 'size']) AS dimension, unnest([p_brand, p_type, p_size::VARCHAR]) AS value FROM part"


def _facets(spark, sf_dir):
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value")) for d, c in (("brand", "p_brand"), ("type", "p_type"), ("size", "p_size"))))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target"), F.inline(pairs))


@query(f"SELECT dimension, value, count(*) AS n FROM ({_FACETS}) GROUP BY ROLLUP (dimension, value)")
def facet_stats(spark, sf_dir):
    return _facets(spark, sf_dir).rollup("dimension", "value").agg(F.count("*").alias("n"))


@query(f"SELECT dimension, count(*) AS n, count(DISTINCT value) AS distinct_values FROM ({_FACETS}) GROUP BY dimension")
def facet_dimensions(spark, sf_dir):
    return _facets(spark, sf_dir).groupBy("dimension").agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"))


@query(f"SELECT dimension, array_to_string(list_sort(list(value)), ',') AS all_values FROM ({_FACETS}) WHERE target = 7 GROUP BY dimension")
def facet_get(spark, sf_dir):
    return _facets(spark, sf_dir).where("target = 7").groupBy("dimension").agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("all_values"))


@query(
    f"""WITH f AS ({_FACETS}), m AS (SELECT p_brand AS b FROM part WHERE p_partkey = 1), t AS (SELECT p_type AS x FROM part WHERE p_partkey IN (1, 2, 3))
SELECT target, array_to_string(list_sort(list(dimension || ':' || value)), '|') AS keys FROM f GROUP BY target
HAVING bool_or(dimension = 'brand' AND value IN (SELECT b FROM m)) AND bool_or(dimension = 'type' AND value IN (SELECT x FROM t))"""
)
def facet_query(spark, sf_dir):
    """Targets that carry all of one set of facets and any of another."""
    p = table(spark, sf_dir, "part")
    must = p.where("p_partkey = 1").agg(F.collect_set(F.concat(F.lit("brand:"), "p_brand")).alias("must"))
    some = p.where("p_partkey in (1, 2, 3)").agg(F.collect_set(F.concat(F.lit("type:"), "p_type")).alias("some"))
    keys = _facets(spark, sf_dir).groupBy("target").agg(F.collect_set(F.concat_ws(":", "dimension", "value")).alias("keys"))
    hit = keys.join(F.broadcast(must)).join(F.broadcast(some)).where((F.size(F.array_except("must", "keys")) == 0) & F.arrays_overlap("some", "keys"))
    return hit.select("target", F.array_join(F.sort_array("keys"), "|").alias("keys"))


# ---- metrics and rubrics


@query(
    """WITH g AS (SELECT source, doc_id, coalesce(quality, 0) AS rel, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, sum(coalesce(quality, 0)) OVER (PARTITION BY source) AS all_rel
FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, round(sum(rel) FILTER (r <= 10) / any_value(all_rel)::DOUBLE, 6) AS recall, round(sum(rel) FILTER (r <= 10) / 10.0::DOUBLE, 6) AS precision_at_k,
round(1.0::DOUBLE / min(r) FILTER (rel = 1), 6) AS mrr,
round(coalesce(sum(rel / log2(r + 1)) FILTER (r <= 10), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= least(10, any_value(g.all_rel))), 6) AS ndcg
FROM g GROUP BY source HAVING any_value(all_rel) > 0"""
)
def ir_metrics(spark, sf_dir):
    """Recall, precision, reciprocal rank and NDCG of a ranking per source against the labels."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    w = Window.partitionBy("source")
    g = d.select("source", F.coalesce("quality", F.lit(0)).alias("rel"), F.row_number().over(w.orderBy(F.desc("n_chars"), "doc_id")).alias("r")).withColumn("all_rel", F.sum("rel").over(w))
    top10 = F.col("r") <= 10
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.max("all_rel")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1.0)))
    found = F.sum(F.when(top10, F.col("rel")).otherwise(0))
    return g.where("all_rel > 0").groupBy("source").agg(
        F.round(found / F.max("all_rel"), 6).alias("recall"), F.round(found / 10.0, 6).alias("precision_at_k"),
        F.round(1.0 / F.min(F.when(F.col("rel") == 1, F.col("r"))), 6).alias("mrr"),
        F.round(F.sum(F.when(top10, F.col("rel") / F.log2(F.col("r") + F.lit(1.0))).otherwise(0.0)) / ideal, 6).alias("ndcg"),
    )


@query(
    """SELECT event_type, max(value) FILTER (n = greatest(1, ceil(a * 0.5::DOUBLE))) AS p50, max(value) FILTER (n = greatest(1, ceil(a * 0.9::DOUBLE))) AS p90, max(value) FILTER (n = greatest(1, ceil(a * 0.99::DOUBLE))) AS p99
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS a FROM events) GROUP BY event_type"""
)
def nearest_rank_pctl(spark, sf_dir):
    return q.nearest_rank(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value")


@query("SELECT event_type, count(*) AS calls, round(avg(value), 6) AS avg_latency, count_if(value >= 10) AS successes, count_if(value < 10) AS failures FROM events GROUP BY event_type")
def function_metrics(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.avg(v), 6).alias("avg_latency"), F.count_if(v >= 10).alias("successes"), F.count_if(v < 10).alias("failures"))


@query(
    r"""SELECT doc_id, least(100, 25 + CASE WHEN len(f) >= 3 THEN 10 ELSE 0 END + CASE WHEN length(text) >= 20 THEN 20 ELSE 0 END + CASE WHEN length(text) >= 50 THEN 5 ELSE 0 END
+ CASE WHEN length(f[1]) BETWEEN 5 AND 120 THEN 15 ELSE 0 END + 15 + CASE WHEN doc_id % 12 BETWEEN 1 AND 10 THEN 10 ELSE 0 END) AS quality
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS f FROM documents)"""
)
def quality_rubric(spark, sf_dir):
    lines = F.split("text", "\n")
    score = sc.compression_quality(lines, F.col("text"), F.element_at(lines, 1), F.array("source"), F.col("doc_id") % 12)
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("quality"))


@query(
    """SELECT event_id, CASE WHEN value * 10 > 500 OR value > 90 OR (value > 95 AND event_id % 2 = 0) THEN 'critical'
WHEN value * 10 > 100 OR value > 80 OR (value > 80 AND event_id % 2 = 0) THEN 'degraded' ELSE 'healthy' END AS status FROM events"""
)
def health_status(spark, sf_dir):
    v = F.col("value")
    rss = F.when(F.col("event_id") % 2 == 0, 2**30).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", sc.health(v * 10, v, v, rss).alias("status"))
