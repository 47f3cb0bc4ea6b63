"""Registered queries: integrity, deletion, slots and context blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import context as cx
from ..operators import integrity as it
from ..operators import lifecycle as lc
from ..operators import search as s
from ..operators import similarity as sim
from ..sources.tables import table
from .lifecycle import _WORK, _work
from .registry import query
from .retrieval import _PREFIX, _SCORED, _TERMS, _bm25

# ---- all tables of a memory, out of the test tables; the time is the 25th of January 2024

_AT = "TIMESTAMP '2024-01-25'"
_ALL = _WORK + f""",
acts AS (SELECT id, status, id % 150 AS assigned_to FROM actions),
leases AS (SELECT event_id AS id, event_id * 2 AS action, user_id AS agent, CASE WHEN event_type = 'purchase' THEN 'released' ELSE 'active' END AS status, ts + INTERVAL 4 DAY AS expires_at FROM events),
sentinels AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'watching' ELSE 'triggered' END AS status, TIMESTAMP '2024-01-01' + to_days((s_suppkey % 50)::INT) AS expires_at, [s_suppkey * 3, -s_suppkey] AS actions FROM supplier),
sketches AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'active' ELSE 'done' END AS status, TIMESTAMP '2024-01-01' + to_days(p_size) AS expires_at FROM part),
signals AS (SELECT event_id AS id, ts + INTERVAL 20 DAY AS expires_at FROM events WHERE event_type = 'view'),
sessions AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'active' ELSE 'completed' END AS status, TIMESTAMP '2024-01-01' + to_days((c_custkey % 40)::INT) AS started_at FROM customer),
memories AS (SELECT p_partkey AS id, list_filter([CASE WHEN p_partkey % 10 = 0 THEN p_partkey - 1 END, CASE WHEN p_partkey % 25 = 0 THEN -p_partkey END], lambda x: x IS NOT NULL) AS supersedes, p_partkey % 4 <> 1 AS is_latest, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS project FROM part),
lessons AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 <> 0 THEN p_size / 45.0::DOUBLE END AS confidence, p_partkey % 9 = 0 AS deleted FROM part),
semantic AS (SELECT s_suppkey AS id, s_acctbal / 9000.0::DOUBLE AS confidence FROM supplier),
mesh AS (SELECT r_regionkey AS id, TIMESTAMP '2024-01-24 22:30:00' + to_minutes((r_regionkey * 30)::INT) AS last_sync_at, CASE WHEN r_regionkey = 3 THEN 'error' ELSE 'idle' END AS status FROM region),
ready AS (SELECT e.src AS id, bool_and(coalesce(d.status, '') = 'done') AS ready FROM edges e LEFT JOIN actions d ON d.id = e.dst WHERE e.type = 'requires' GROUP BY e.src),
live AS (SELECT action AS id FROM leases WHERE status = 'active' AND expires_at > {_AT}),
sup AS (SELECT DISTINCT unnest(supersedes) AS id FROM memories),
f AS (SELECT 'active-no-lease' AS kind, id::VARCHAR AS id, 'actions' AS category, 'warn' AS status, false AS fixable FROM acts WHERE status = 'active' AND id NOT IN (SELECT id FROM live)
UNION ALL SELECT 'blocked-deps-done', a.id::VARCHAR, 'actions', 'fail', true FROM acts a JOIN ready USING (id) WHERE status = 'blocked' AND ready
UNION ALL SELECT 'pending-unsatisfied-deps', a.id::VARCHAR, 'actions', 'fail', true FROM acts a JOIN ready USING (id) WHERE status = 'pending' AND NOT ready
UNION ALL SELECT 'expired-lease', id::VARCHAR, 'leases', 'fail', true FROM leases WHERE status = 'active' AND expires_at <= {_AT}
UNION ALL SELECT 'orphaned-lease', id::VARCHAR, 'leases', 'fail', true FROM leases WHERE action NOT IN (SELECT id FROM acts)
UNION ALL SELECT 'expired-sentinel', id::VARCHAR, 'sentinels', 'fail', true FROM sentinels WHERE status = 'watching' AND expires_at <= {_AT}
UNION ALL SELECT 'sentinel-missing-action', id || ':' || r, 'sentinels', 'warn', false FROM (SELECT id, unnest(actions) AS r FROM sentinels) WHERE r NOT IN (SELECT id FROM acts)
UNION ALL SELECT 'expired-sketch', id::VARCHAR, 'sketches', 'fail', true FROM sketches WHERE status = 'active' AND expires_at <= {_AT}
UNION ALL SELECT 'expired-signal', id::VARCHAR, 'signals', 'fail', true FROM signals WHERE expires_at <= {_AT}
UNION ALL SELECT 'abandoned-session', id::VARCHAR, 'sessions', 'warn', false FROM sessions WHERE status = 'active' AND started_at < {_AT} - INTERVAL 1 DAY
UNION ALL SELECT 'memory-missing-supersedes', id || ':' || r, 'memories', 'warn', false FROM (SELECT id, unnest(supersedes) AS r FROM memories) WHERE r NOT IN (SELECT id FROM memories)
UNION ALL SELECT 'memory-stale-latest', id::VARCHAR, 'memories', 'fail', true FROM memories WHERE is_latest AND id IN (SELECT id FROM sup)
UNION ALL SELECT 'lesson-bad-confidence', id::VARCHAR, 'lessons', 'warn', false FROM lessons WHERE NOT deleted AND (confidence IS NULL OR confidence < 0 OR confidence > 1)
UNION ALL SELECT 'summary-missing-title', n_nationkey::VARCHAR, 'summaries', 'warn', false FROM nation WHERE n_nationkey % 7 = 0
UNION ALL SELECT 'semantic-bad-confidence', id::VARCHAR, 'semantic', 'warn', false FROM semantic WHERE confidence < 0 OR confidence > 1
UNION ALL SELECT 'procedural-empty-steps', r_regionkey::VARCHAR, 'procedural', 'warn', false FROM region WHERE r_regionkey % 2 = 0
UNION ALL SELECT 'crystal-empty-narrative', n_nationkey::VARCHAR, 'crystals', 'warn', false FROM nation WHERE n_nationkey % 11 = 0
UNION ALL SELECT 'stale-peer', id::VARCHAR, 'mesh', 'warn', false FROM mesh WHERE last_sync_at < {_AT} - INTERVAL 1 HOUR
UNION ALL SELECT 'error-peer', id::VARCHAR, 'mesh', 'warn', false FROM mesh WHERE status = 'error'),
findings AS (SELECT kind || ':' || id AS name, category, status, fixable FROM f
UNION ALL SELECT c || '-ok', c, 'pass', false FROM (SELECT unnest([{", ".join(f"'{c}'" for c in it.CATEGORIES)}]) AS c) WHERE c NOT IN (SELECT category FROM f)
UNION ALL SELECT 'memory-project-coverage', 'memories', CASE WHEN b = 0 THEN 'pass' WHEN b < n THEN 'warn' ELSE 'fail' END, b > 0 FROM (SELECT count(*) AS n, count_if(project IS NULL) AS b FROM memories WHERE is_latest))"""


def _now():
    return F.lit("2024-01-25").cast("timestamp_ntz")


def _everything(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    actions, edges, _ = _work(spark, sf_dir)
    days = lambda c, begin="2024-01-01": F.lit(begin).cast("timestamp_ntz") + F.make_dt_interval(c.cast("int"))
    e, p, su, n, rg = t("events"), t("part"), t("supplier"), t("nation"), t("region")
    pk = F.col("p_partkey")
    some = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return {
        "actions": actions.withColumn("assigned_to", F.col("id") % 150), "edges": edges,
        "leases": e.select(F.col("event_id").alias("id"), (F.col("event_id") * 2).alias("action"), F.col("user_id").alias("agent"), F.when(F.col("event_type") == "purchase", "released").otherwise("active").alias("status"), (F.col("ts") + F.expr("interval 4 days")).alias("expires_at")),
        "sentinels": su.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "watching").otherwise("triggered").alias("status"), days(F.col("s_suppkey") % 50).alias("expires_at"), F.array(F.col("s_suppkey") * 3, -F.col("s_suppkey")).alias("actions")),
        "sketches": p.select(pk.alias("id"), F.when(F.col("p_size") % 2 == 0, "active").otherwise("done").alias("status"), days(F.col("p_size")).alias("expires_at")),
        "signals": e.where("event_type = 'view'").select(F.col("event_id").alias("id"), (F.col("ts") + F.expr("interval 20 days")).alias("expires_at")),
        "sessions": t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "active").otherwise("completed").alias("status"), days(F.col("c_custkey") % 40).alias("started_at")),
        "memories": p.select(pk.alias("id"), some(F.when(pk % 10 == 0, pk - 1), F.when(pk % 25 == 0, -pk)).alias("supersedes"), (pk % 4 != 1).alias("is_latest"), F.when(pk % 2 == 0, F.col("p_brand")).alias("project")),
        "lessons": p.select(pk.alias("id"), F.when(pk % 50 != 0, F.col("p_size") / 45.0).alias("confidence"), (pk % 9 == 0).alias("deleted")),
        "summaries": n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 7 == 0, " ").otherwise(F.col("n_name")).alias("title")),
        "semantic": su.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 9000.0).alias("confidence")),
        "procedural": rg.select(F.col("r_regionkey").alias("id"), F.when(F.col("r_regionkey") % 2 == 1, F.array(F.lit("do"))).alias("steps")),
        "crystals": n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 11 != 0, F.col("n_name")).alias("narrative")),
        "insights": su.select(F.col("s_suppkey").alias("id"), F.lit(0.5).alias("confidence"), F.lit(None).cast("boolean").alias("deleted")),
        "mesh": rg.select(F.col("r_regionkey").alias("id"), (F.lit("2024-01-24 22:30:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("r_regionkey") * 30)).alias("last_sync_at"), F.when(F.col("r_regionkey") == 3, "error").otherwise("idle").alias("status")),
    }


@query(_ALL + " SELECT name, category, status, fixable FROM findings")
def diagnose_all(spark, sf_dir):
    """All categories of checks."""
    return it.diagnose(_everything(spark, sf_dir), _now())


@query(_ALL + " SELECT count(*) AS total, count_if(status = 'pass') AS passed, count_if(status = 'warn') AS warned, count_if(status = 'fail') AS failed, count_if(fixable) AS fixable FROM findings")
def diagnose_counts(spark, sf_dir):
    return it.rollup(it.diagnose(_everything(spark, sf_dir), _now()))


_HEALED = _ALL + f""", freed AS (SELECT DISTINCT a.id FROM acts a JOIN leases l ON l.action = a.id AND l.agent = a.assigned_to WHERE a.status = 'active' AND l.status = 'active' AND l.expires_at <= {_AT} AND a.id NOT IN (SELECT id FROM live))"""


@query(
    _HEALED + """ SELECT status, count(*) AS n FROM (SELECT CASE WHEN id IN (SELECT id FROM freed) THEN 'pending' WHEN id IN (SELECT id FROM ready WHERE ready) AND status = 'blocked' THEN 'pending'
WHEN id IN (SELECT id FROM ready WHERE NOT ready) AND status = 'pending' THEN 'blocked' ELSE status END AS status FROM acts) GROUP BY status"""
)
def heal_actions(spark, sf_dir):
    """Actions by status after repair."""
    return it.heal(_everything(spark, sf_dir), _now())[0]["actions"].groupBy("status").agg(F.count("*").alias("n"))


@query(
    _HEALED + """ SELECT category, id, CASE WHEN kind IN ('expired-sentinel', 'expired-sketch', 'expired-signal') THEN 'expired' ELSE kind END AS reason FROM f WHERE fixable
UNION ALL SELECT 'actions', id::VARCHAR, 'lease-expired' FROM freed"""
)
def heal_audit(spark, sf_dir):
    """What a repair does."""
    return it.heal(_everything(spark, sf_dir), _now())[1]


@query(
    """WITH asked AS (SELECT r_regionkey AS request, r_regionkey + 3 AS session FROM region), o AS (SELECT event_id AS id, user_id AS session FROM events)
SELECT 'left' AS what, count(*) AS n FROM o WHERE session NOT IN (SELECT session FROM asked) AND NOT (session = 20 AND id % 7 = 0)
UNION ALL SELECT 'deleted', sum(n)::BIGINT FROM (SELECT count(id) + 2 AS n FROM asked LEFT JOIN o USING (session) GROUP BY request UNION ALL SELECT count(*) FROM o WHERE session = 20 AND id % 7 = 0 UNION ALL SELECT 25)"""
)
def forget_requests(spark, sf_dir):
    """Sessions, single observations and memories that are to be forgotten."""
    o = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session"))
    none = F.lit(None).cast("long")
    whole = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("request"), none.alias("memory"), (F.col("r_regionkey") + 3).cast("long").alias("session"), none.alias("observation"))
    one = o.where("session = 20 and id % 7 = 0").select((100 + F.col("id")).alias("request"), none.alias("memory"), "session", F.col("id").alias("observation"))
    memory = table(spark, sf_dir, "nation").select((F.lit(-1) - F.col("n_nationkey")).cast("long").alias("request"), F.col("n_nationkey").cast("long").alias("memory"), none.alias("session"), none.alias("observation"))
    sessions = o.select("session").distinct()
    memories = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    left, counts = it.forget(o, sessions, sessions, memories, whole.unionByName(one).unionByName(memory))
    return left["observations"].agg(F.lit("left").alias("what"), F.count("*").alias("n")).unionByName(counts.agg(F.lit("deleted").alias("what"), F.sum("deleted").alias("n")))


@query("SELECT o_orderkey AS id, 'delete' AS operation, 'low value' AS reason FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 20000")
def governance_delete(spark, sf_dir):
    """Audit rows of a bulk deletion."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    return it.govern(o, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 20000), reason="low value")[1]


@query(
    """WITH c AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS c, l_orderkey % 3 <> 0 AS is_latest FROM lineitem), s AS (SELECT id FROM c WHERE NOT is_latest AND id % 30 = 0 GROUP BY id HAVING count(*) >= 2),
m AS (SELECT a.id, b.id AS o FROM c a JOIN s ON s.id = a.id JOIN c b ON b.c = a.c AND b.is_latest AND b.id <> a.id GROUP BY ALL HAVING count(*) >= 2)
SELECT s.id, count(o) AS siblings FROM s LEFT JOIN m ON m.id = s.id GROUP BY s.id"""
)
def cascade_siblings(spark, sf_dir):
    """Latest memories that share two concepts with a superseded one."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("concepts"))
    m = l.withColumn("is_latest", F.col("id") % 3 != 0)
    return lc.shared_concepts(m, m.where("not is_latest and id % 30 = 0"), "id", "concepts")


@query(
    """SELECT user_id, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS n FROM (SELECT user_id, (props::JSON ->> 'k') AS k, min((ts, event_id)) AS first FROM events WHERE event_type = 'error' GROUP BY ALL)) WHERE n <= 10"""
)
def first_errors(spark, sf_dir):
    """The first ten different errors of each session, in order of first appearance."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", F.get_json_object("props", "$.k").alias("k"), F.struct("ts", "event_id").alias("at"))
    return s.top(e.groupBy("user_id", "k").agg(F.min("at").alias("at")), ["user_id"], [F.asc("at")], 10).select("user_id", "k")


@query("SELECT c_custkey AS session, o_orderkey AS summary FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_totalprice > 200000 GROUP BY 1) ON o_custkey = c_custkey")
def session_summaries(spark, sf_dir):
    """Sessions with their summary, if there is one."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("session")).agg(F.max("o_orderkey").alias("summary"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session")).join(o, "session", "left")


@query(
    """SELECT id, rank FROM (SELECT p_partkey AS id, row_number() OVER (ORDER BY floor(round(p_size / 50.0::DOUBLE / 0.2, 6)) DESC, p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 100"""
)
def near_equal_order(spark, sf_dir):
    """Memories by strength in steps of 0.2, then the newest first: a comparator that calls near values equal has no order, steps have one."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), cx.strength_step(F.col("p_size") / 50.0).alias("step"), "p_retailprice")
    best = p.orderBy(F.desc("step"), F.desc("p_retailprice"), "id").limit(100)  # a window over so many rows only
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("step"), F.desc("p_retailprice"), "id")).cast("long")).select("id", "rank")


@query(
    """SELECT event_id, CASE hook WHEN 'prompt_submit' THEN 'prompt' WHEN 'stop' THEN CASE WHEN body <> '' THEN 'response' ELSE 'hook' END WHEN 'pre_tool_use' THEN 'tool_call' WHEN 'post_tool_use' THEN 'tool_result' WHEN 'post_tool_failure' THEN 'tool_error'
WHEN 'session_start' THEN 'session_start' WHEN 'session_end' THEN 'session_end' ELSE 'hook' END AS kind,
CASE hook WHEN 'prompt_submit' THEN CASE WHEN body <> '' THEN body ELSE 'User prompt' END WHEN 'stop' THEN CASE WHEN body <> '' THEN body ELSE 'stop' END WHEN 'pre_tool_use' THEN coalesce(tool, 'tool') || ' ▸ call' WHEN 'post_tool_use' THEN coalesce(tool, 'tool') || ' ▸ result'
WHEN 'post_tool_failure' THEN coalesce(tool, 'tool') || ' ▸ error' WHEN 'session_start' THEN 'Session start' WHEN 'session_end' THEN 'Session end' ELSE hook END AS label FROM (
SELECT event_id, ['prompt_submit', 'stop', 'pre_tool_use', 'post_tool_use', 'post_tool_failure', 'session_start', 'session_end', 'notification'][1 + event_id % 8] AS hook, CASE WHEN event_id % 3 <> 0 THEN event_type END AS tool, CASE WHEN event_id % 5 <> 0 THEN props ELSE '' END AS body FROM events)"""
)
def replay_labels(spark, sf_dir):
    """Kind and label of each event of a replay."""
    hooks = F.array(*map(F.lit, ["prompt_submit", "stop", "pre_tool_use", "post_tool_use", "post_tool_failure", "session_start", "session_end", "notification"]))
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(i, F.element_at(hooks, (1 + i % 8).cast("int")).alias("hook"), F.when(i % 3 != 0, F.col("event_type")).alias("tool"), F.when(i % 5 != 0, F.col("props")).otherwise("").alias("body"))
    return e.select("event_id", cx.replay_kind(F.col("hook"), F.col("body")).alias("kind"), cx.replay_label(F.col("hook"), F.col("tool"), F.col("body")).alias("label"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id AS session, count(*) AS reviewed, count_if(event_type = 'error') AS errors, count_if(event_type = 'click') AS commands,
coalesce(string_agg(CASE WHEN contains(props, '7') OR contains('event ' || event_id, '7') THEN '- event ' || event_id END, chr(10) ORDER BY n), '') AS pending FROM r WHERE n <= 50 GROUP BY 1"""
)
def slot_reflect(spark, sf_dir):
    """What the newest fifty observations of each session add to its slots."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), "ts", F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("title"), F.col("props").alias("narrative"), F.when(F.col("event_type") == "click", "command_run").otherwise(F.col("event_type")).alias("type"))
    return cx.reflected(e, "session", ["ts", "id"], todo="7").select("session", "reviewed", "errors", "commands", "pending")


# ---- context


@query(
    r"""WITH ls AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN 'src' || (p_partkey % 25) END AS project, p_name AS content, p_size / 50.0::DOUBLE AS confidence FROM part),
pr AS (SELECT DISTINCT source AS project FROM documents),
lr AS (SELECT pr.project, ls.id, content, row_number() OVER (PARTITION BY pr.project ORDER BY round(confidence * CASE WHEN ls.project IS NOT NULL THEN 1.5 ELSE 1 END, 6) DESC, ls.id) AS n FROM pr JOIN ls ON ls.project = pr.project OR ls.project IS NULL),
bl AS (SELECT project, 'lessons' AS kind, string_agg('- ' || content, chr(10) ORDER BY n) AS content, 1000000000 AS recency, 0 AS id FROM lr WHERE n <= 10 GROUP BY project
UNION ALL SELECT project, 'profile', 'Concepts: ' || string_agg(lang, ', ' ORDER BY n DESC, lang), 1000000001, 0 FROM (SELECT source AS project, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL) GROUP BY project
UNION ALL SELECT source, 'session', text, n_chars, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents WHERE n_chars < 1500) WHERE n <= 10),
b AS (SELECT project, kind, id, ceil((length(content) + 40) / 3.0)::BIGINT AS t, row_number() OVER (PARTITION BY project ORDER BY recency DESC, id) AS n FROM bl),
r AS (SELECT * FROM b)
SELECT project, kind, id, used FROM (WITH RECURSIVE w AS (SELECT project, 0::BIGINT AS n, 0::BIGINT AS used, NULL::VARCHAR AS kind, NULL::BIGINT AS id FROM b GROUP BY project
UNION ALL SELECT w.project, b.n, CASE WHEN w.used + b.t <= 2000 THEN w.used + b.t ELSE w.used END, CASE WHEN w.used + b.t <= 2000 THEN b.kind END, b.id FROM w JOIN b ON b.project = w.project AND b.n = w.n + 1) SELECT * FROM w) WHERE kind IS NOT NULL"""
)
def context_blocks(spark, sf_dir):
    """The blocks that make up a project's context: profile, lessons, then its newest sessions, as far as the budget goes."""
    d, p = table(spark, sf_dir, "documents"), table(spark, sf_dir, "part")
    projects = d.select(F.col("source").alias("project")).distinct()
    lessons = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("src"), (F.col("p_partkey") % 25).cast("string"))).alias("project"), F.col("p_name").alias("content"), (F.col("p_size") / 50.0).alias("confidence"))
    concepts = d.where("lang is not null").groupBy(F.col("source").alias("project"), F.col("lang").alias("concept")).agg(F.count("*").alias("n"))
    newest = s.top(d.where("n_chars < 1500").withColumnRenamed("source", "project"), ["project"], [F.desc("n_chars"), F.asc("doc_id")], 10, "n")
    blocks = [
        cx.profile_block(concepts, 8, 1_000_000_001),
        cx.lesson_block(projects, lessons, 10, 1_000_000_000),
        newest.select("project", F.lit("session").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("n_chars").alias("recency")),
    ]
    return cx.packed(blocks, 2000).select("project", "kind", "id", "used")


_ENRICH = _TERMS + _SCORED.format(prefix=_PREFIX, k=5) + """,
near AS (SELECT query_id, string_agg(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10) ORDER BY rank) AS x FROM bm25 JOIN documents ON doc_id = id GROUP BY query_id),
bugs AS (SELECT query_id, string_agg('- ' || title || ': ' || content, chr(10) ORDER BY n) AS x FROM (SELECT b.item_id AS query_id, p_name AS title, p_type AS content, row_number() OVER (PARTITION BY b.item_id ORDER BY p_partkey DESC) AS n
  FROM benchmark b JOIN part ON contains('src/' || p_brand, 'src/Brand#' || (1 + b.item_id % 5)) WHERE p_size % 5 = 0) WHERE n <= 3 GROUP BY query_id),
whole AS (SELECT item_id AS request, concat_ws(chr(10) || chr(10), '<relevant-context>' || chr(10) || near.x || chr(10) || '</relevant-context>', '<past-errors>' || chr(10) || bugs.x || chr(10) || '</past-errors>') AS c
  FROM benchmark LEFT JOIN near ON near.query_id = item_id LEFT JOIN bugs ON bugs.query_id = item_id)"""


@query(_ENRICH + " SELECT request, substr(c, 1, 4000) AS context, length(c) > 4000 AS truncated FROM whole")
def enrich(spark, sf_dir):
    """What is known beside a file that is about to be touched: search results, then past errors in files alike."""
    b, d, p = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "part")
    hits = _bm25(spark, sf_dir, 5).join(d.select(F.col("doc_id").alias("id"), F.col("text").alias("narrative")), "id").select(F.col("query_id").alias("request"), "rank", "narrative")
    files = b.select(F.col("item_id").alias("request"), F.concat(F.lit("src/Brand#"), (1 + F.col("item_id") % 5).cast("string")).alias("file"))
    bugs = p.where("p_size % 5 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("content"), F.concat(F.lit("src/"), "p_brand").alias("file"), F.col("p_partkey").alias("updated_at"))
    return cx.enriched(b.select(F.col("item_id").alias("request")), hits, cx.bugs_in(files, bugs))


@query(
    r"""WITH w AS (SELECT DISTINCT 'f' || item_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: length(x) > 3)) AS term FROM benchmark
UNION SELECT 'l' || p_partkey, unnest([lower(p_brand), lower(p_type)]) FROM part),
c AS (SELECT term, count(*) AS n FROM w GROUP BY term HAVING count(*) >= 2),
p AS (SELECT a.term AS a, b.term AS b, count(*)::DOUBLE / (any_value(ca.n) + any_value(cb.n) - count(*)) AS j FROM w a JOIN w b ON a.id = b.id AND a.term < b.term JOIN c ca ON ca.term = a.term JOIN c cb ON cb.term = b.term GROUP BY a.term, b.term)
SELECT a, b, round(j, 6) AS similarity FROM p WHERE j > 0.3"""
)
def concept_pairs(spark, sf_dir):
    """Terms of facts and tags of lessons that the same memories use: those over 0.3 alike, from which clusters are picked."""
    return sim.concept_pairs(_concepts(spark, sf_dir), 0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))


def _concepts(spark, sf_dir):
    facts = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("id"), tx.long_terms(F.col("text")).alias("terms"))
    return facts.unionByName(table(spark, sf_dir, "part").select(F.concat(F.lit("l"), F.col("p_partkey").cast("string")).alias("id"), F.array(F.lower("p_brand"), F.lower("p_type")).alias("terms")))


@query(None)
def concept_clusters_jaccard(spark, sf_dir):
    """Greedy clusters of concepts by the memories that use them; held against a plain version in the tests."""
    return sim.greedy_clusters(sim.concept_pairs(_concepts(spark, sf_dir), 0.3))
