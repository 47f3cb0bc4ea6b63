"""Registered queries: decay, eviction, merging, work coordination, checks. Times are given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..functions import text as tx
from ..operators import lifecycle as lc
from ..operators import paths
from ..operators import search as s
from ..operators import sequences as q
from ..operators import work as wk
from ..sources import tables as src
from ..sources.tables import table
from .registry import query

_NOW = "TIMESTAMP '2001-09-01'"
_AGE = "(epoch_us(TIMESTAMP '2001-09-01') - epoch_us({})) / 86400000000.0::DOUBLE"


def _now():
    return F.lit("2001-09-01").cast("timestamp")


# ---- retention: orders are memories, their lines the accesses

_RETENTION = f"""WITH acc AS (SELECT l_orderkey AS id, count(*) AS n, list({_AGE.format("l_shipdate")}) AS days FROM lineitem GROUP BY 1),
m AS (SELECT o_orderkey AS id, {_AGE.format("o_orderdate")} AS age, coalesce(n, 0) AS n, coalesce(days, []) AS days,
CASE o_orderkey % 7 WHEN 0 THEN 0.9 WHEN 1 THEN 0.85 WHEN 2 THEN 0.8 WHEN 3 THEN 0.7 WHEN 4 THEN 0.6 ELSE 0.5 END::DOUBLE AS w FROM orders LEFT JOIN acc ON id = o_orderkey),
r AS (SELECT id, round(least(1.0, least(1.0, w + least(0.2::DOUBLE, 0.02::DOUBLE * n)) * exp(-0.01::DOUBLE * age) + 0.3::DOUBLE * coalesce(list_sum([1 / d FOR d IN days IF d > 0]), 0)), 6) AS score FROM m)"""


def _retention(spark, sf_dir):
    acc = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.sum(sc.boost(sc.days_between(_now(), F.col("l_shipdate")))).alias("boost"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate").join(acc, "id", "left")
    kinds = F.array(*map(F.lit, [*sc.TYPE_WEIGHT, "fact"]))
    kind = F.element_at(kinds, (1 + F.col("id") % 7).cast("int"))
    score = sc.retention(sc.salience(kind, F.coalesce("n", F.lit(0))), sc.days_between(_now(), F.col("o_orderdate")), F.coalesce("boost", F.lit(0.0)))
    return o.select("id", F.round(score, 6).alias("score"))


@query(_RETENTION + " SELECT * FROM r")
def retention_score(spark, sf_dir):
    return _retention(spark, sf_dir)


@query(_RETENTION + " SELECT CASE WHEN score >= 0.7 THEN 'hot' WHEN score >= 0.4 THEN 'warm' WHEN score >= 0.15 THEN 'cold' ELSE 'evictable' END AS tier, count(*) AS n FROM r GROUP BY 1")
def retention_tiers(spark, sf_dir):
    return _retention(spark, sf_dir).groupBy(sc.tier(F.col("score")).alias("tier")).agg(F.count("*").alias("n"))


@query(_RETENTION + " SELECT id, score FROM r WHERE score < 0.15 ORDER BY score, id LIMIT 50")
def retention_evict(spark, sf_dir):
    return _retention(spark, sf_dir).where("score < 0.15").orderBy("score", "id").limit(50)


@query(
    f"""SELECT o_orderkey AS id, round(CASE WHEN d > 30 THEN greatest(0.1, st * pow(0.9::DOUBLE, floor(d / 30))) ELSE st END, 6) AS strength FROM (
SELECT o_orderkey, {_AGE.format("o_orderdate")} / 20 AS d, (1 + o_orderkey % 10) / 10.0::DOUBLE AS st FROM orders)"""
)
def strength_decay(spark, sf_dir):
    days = sc.days_between(_now(), F.col("o_orderdate")) / 20
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(sc.strength_decay((1 + F.col("o_orderkey") % 10) / 10.0, days), 6).alias("strength"))


@query(
    """SELECT id, c AS confidence, c <= 0.1 AND r = 0 AS deleted FROM (SELECT id, r, CASE WHEN d >= 7 THEN round(greatest(0.05, cf - 0.05::DOUBLE * (d / 7.0::DOUBLE)), 3) ELSE cf END AS c FROM (
SELECT event_id AS id, event_id % 3 AS r, 0.3::DOUBLE + (event_id % 7) / 10.0::DOUBLE AS cf, (epoch_us(TIMESTAMP '2024-02-15') - epoch_us(ts)) / 86400000000.0::DOUBLE AS d FROM events))"""
)
def confidence_decay(spark, sf_dir):
    days = sc.days_between(F.lit("2024-02-15").cast("timestamp"), F.col("ts"))
    c = sc.confidence_decay(F.lit(0.3) + (F.col("event_id") % 7) / 10.0, F.lit(0.05), days)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), c.alias("confidence"), (F.col("event_id") % 3).alias("r"))
    return rows.select("id", "confidence", ((F.col("confidence") <= 0.1) & (F.col("r") == 0)).alias("deleted"))


@query(
    """SELECT 'lsn_' || substr(sha256(lower(trim(p_name))), 1, 16) AS id, count(*) AS saves, round(least(1.0, 1 - 0.5::DOUBLE * pow(0.9::DOUBLE, count(*) - 1)), 6) AS confidence FROM part GROUP BY lower(trim(p_name))"""
)
def lesson_save(spark, sf_dir):
    """A lesson that is saved again is reinforced."""
    key = F.lower(F.trim("p_name"))
    n = table(spark, sf_dir, "part").groupBy(key.alias("k")).agg(F.count("*").alias("saves"))
    return n.select(F.concat(F.lit("lsn_"), F.substring(F.sha2("k", 256), 1, 16)).alias("id"), "saves", F.round(sc.reinforced(F.lit(0.5), F.col("saves") - 1), 6).alias("confidence"))


@query(
    """SELECT p_partkey AS id, round(c * ((contains(t, 'ti')::INT + contains(t, 'red')::INT) / 2.0::DOUBLE) / (1 + 0.01::DOUBLE * p_size), 3) AS relevance
FROM (SELECT *, 0.2::DOUBLE + (p_partkey % 8) / 10.0::DOUBLE AS c, lower(p_name || ' ' || p_type) AS t FROM part)
WHERE contains(t, 'ti')::INT + contains(t, 'red')::INT > 0 AND c >= 0.4"""
)
def lesson_recall(spark, sf_dir):
    """Terms of more than one character are sought anywhere in the text."""
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    c = F.lit(0.2) + (F.col("p_partkey") % 8) / 10.0
    found = table(spark, sf_dir, "part").where((c >= 0.4) & (text.contains("ti") | text.contains("red")))
    return found.select(F.col("p_partkey").alias("id"), sc.relevance("ti x red", text, c, F.col("p_size")).alias("relevance"))


@query(
    """SELECT event_id, round(0.5::DOUBLE * (event_id % 10) / 10 + 0.3::DOUBLE / (1 + 0.1::DOUBLE * ((epoch_us(TIMESTAMP '2024-02-15') - epoch_us(ts)) / 86400000000.0::DOUBLE)) + 0.2::DOUBLE * log2(user_id % 20 + 1) / 10, 6) AS score FROM events"""
)
def core_memory_score(spark, sf_dir):
    days = sc.days_between(F.lit("2024-02-15").cast("timestamp"), F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", F.round(sc.core_score(F.col("event_id") % 10, days, F.col("user_id") % 20), 6).alias("score"))


# ---- eviction


@query("SELECT p_brand AS project, p_partkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS n, count(*) OVER (PARTITION BY p_brand) AS a FROM part) WHERE n <= a - 5")
def evict_cap_per_project(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), F.col("p_partkey").alias("id"), "p_size")
    return q.capped(p, ["project"], [F.asc("p_size"), F.asc("id")], 5).select("project", "id")


@query(
    f"""SELECT c_custkey AS session, max(o_orderdate) AS last_at FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1
HAVING epoch_us({_NOW}) - epoch_us(max(o_orderdate)) > 30 * 86400000000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"""
)
def evict_stale_sessions(spark, sf_dir):
    """Sessions quiet for 30 days that have no summary."""
    o = table(spark, sf_dir, "orders")
    last = o.groupBy(F.col("o_custkey").alias("session")).agg(F.max("o_orderdate").alias("last_at")).where(sc.days_between(_now(), F.col("last_at")) > 30)
    return last.join(o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("session")), "session", "left_anti")


@query("SELECT event_id, user_id FROM events WHERE TIMESTAMP '2024-01-20' > ts + INTERVAL 10 DAY AND event_type = 'view' OR (ts < TIMESTAMP '2024-01-05' AND event_id % 10 <= 2)")
def auto_forget_ttl(spark, sf_dir):
    """Rows past their time, and old ones of little importance."""
    over = (F.lit("2024-01-20").cast("timestamp_ntz") > F.col("ts") + F.expr("interval 10 days")) & (F.col("event_type") == "view")
    dull = (F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("event_id") % 10 <= 2)
    return table(spark, sf_dir, "events").where(over | dull).select("event_id", "user_id")




@query(
    r"""WITH b AS (SELECT * FROM (SELECT doc_id AS id, n_chars AS born, text FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1000)),
t AS (SELECT id, born, list_distinct([lower(w) FOR w IN list_slice(string_split(text, ' '), 1, 12) IF length(w) > 2]) AS c, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: length(w) > 2)) AS s FROM b),
p AS (SELECT a.id AS ia, b.id AS ib, a.born AS ba, b.born AS bb, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS n FROM t a JOIN t b ON a.id < b.id AND list_has_any(a.c, b.c) WHERE len(a.s) > 0 AND len(b.s) > 0)
SELECT CASE WHEN bb <= ba THEN ib ELSE ia END AS older, CASE WHEN bb <= ba THEN ia ELSE ib END AS newer, round(i::DOUBLE / (n - i), 6) AS similarity FROM p WHERE i::DOUBLE / (n - i) > 0.9"""
)
def auto_forget_contradictions(spark, sf_dir):
    """The first words stand for the concepts, by which pairs are sought; the whole contents are compared."""
    concepts = F.filter(F.slice(F.split("text", " "), 1, 12), lambda w: F.length(w) > 2)
    newest = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text").orderBy(F.desc("n_chars"), "doc_id").limit(1000)
    rows = src.spread(newest).select("doc_id", "n_chars", concepts.alias("concepts"), tx.jaccard_tokens(F.lower("text")).alias("words"))
    return lc.contradictions(rows, "doc_id", "concepts", "words", "n_chars")


@query("SELECT DISTINCT l_suppkey AS node FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-02-01')")
def cascade_stale(spark, sf_dir):
    """Nodes any of whose sources is gone."""
    sources = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_orderkey").alias("source"))
    gone = table(spark, sf_dir, "orders").where("o_orderdate < timestamp_ntz '1995-02-01'").select(F.col("o_orderkey").alias("source"))
    return lc.stale_by_provenance(sources, gone, "node")


@query("SELECT p_brand AS session, p_partkey AS id FROM (SELECT *, sum(p_size) OVER (PARTITION BY p_brand) - coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM part) WHERE l > 100")
def auto_page(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("session"), F.col("p_partkey").alias("id"), "p_retailprice", "p_size")
    return lc.page_out(p, ["session"], "p_retailprice", "id", "p_size", 100).select("session", "id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate + INTERVAL 40 DAY <= TIMESTAMP '1995-06-01' AND o_orderstatus = 'O'")
def expiry_sweep(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), (F.col("o_orderdate") + F.expr("interval 40 days")).alias("expires_at"))
    return lc.expired(o, "expires_at", F.lit("1995-06-01").cast("timestamp_ntz")).select("id")


# ---- merging


@query(
    """SELECT k, v, at FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY at DESC, fresh) AS n FROM (
SELECT o_custkey AS k, o_totalprice AS v, o_orderdate AS at, 0 AS fresh FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders o2 WHERE o2.o_custkey = orders.o_custkey) UNION ALL
SELECT o_custkey, o_totalprice, o_orderdate, 1 FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders o2 WHERE o2.o_custkey = orders.o_custkey))) WHERE n = 1""".replace(" AS at", ' AS "at"').replace("at DESC", '"at" DESC').replace("k, v, at ", 'k, v, "at" AS changed ')
)
def lww_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"))
    pick = lambda f: o.agg(f("o_totalprice", "o_orderkey").alias("v"), f("o_orderdate", "o_orderkey").alias("changed"))
    return lc.last_write_wins(pick(F.min_by), pick(F.max_by), "k", "changed")


@query(
    """WITH n AS (SELECT o_custkey AS item, o_orderstatus AS v, count(*) AS n FROM orders GROUP BY ALL),
a AS (SELECT item, arg_max(v, (n, v)) AS w, max(n) AS t, sum(n) AS s, count(*) AS k FROM n GROUP BY item)
SELECT item, CASE WHEN t * 2 > s OR k = 1 THEN w END AS winner, NOT (t * 2 > s OR k = 1) AS ambiguous FROM a"""
)
def majority_project(spark, sf_dir):
    return lc.majority(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderstatus").alias("v")), "item", "v")


@query(
    """SELECT o_orderkey AS id, row_number() OVER w AS version, lag(o_orderkey) OVER w AS parent, lead(o_orderkey) OVER w IS NULL AS is_latest
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
)
def version_chain(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate")
    return q.version_chain(o, "o_custkey", ["o_orderdate", "id"], "id").select("id", "version", "parent", "is_latest")


@query(
    """SELECT id, array_to_string(list_reverse(sup), ',') AS supersedes FROM (SELECT o_orderkey AS id, lead(o_orderkey) OVER w IS NULL AS is_latest,
array_agg(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sup FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE is_latest AND len(sup) > 0"""
)
def supersedes_of_latest(spark, sf_dir):
    """All that the latest version of each lineage supersedes, newest first."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate")
    chain = q.version_chain(o, "o_custkey", ["o_orderdate", "id"], "id")
    return q.superseded_by(chain, "o_custkey", "id", chain.where("is_latest").select("id")).select("id", F.array_join("supersedes", ",").alias("supersedes"))


@query(
    """WITH a AS (SELECT event_id, event_type FROM events WHERE event_id % 10 <> 3), b AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'changed' ELSE event_type END AS event_type FROM events WHERE event_id % 10 <> 7)
SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)"""
)
def setops_delta(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    b = e.where("event_id % 10 <> 7").withColumn("event_type", F.when(F.col("event_id") % 50 == 0, "changed").otherwise(F.col("event_type")))
    return src.snapshot_diff(e.where("event_id % 10 <> 3"), b)


@query(
    """SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 <> 0 UNION ALL SELECT p_partkey, p_size + 100 FROM part WHERE p_partkey % 2 = 0"""
)
def import_merge(spark, sf_dir):
    """Incoming rows take the place of those of their id, others stay."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return src.merge_import(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 2 = 0").withColumn("p_size", F.col("p_size") + 100), "p_partkey", "merge")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30' AND o_totalprice < 100000")
def governance_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where(F.col("o_orderstatus").isin("F", "P") & F.expr("o_orderdate between timestamp_ntz '1996-01-01' and timestamp_ntz '1996-06-30'") & (F.col("o_totalprice") < 100000)).select(F.col("o_orderkey").alias("id"))


@query("SELECT event_id, ts, event_type FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id LIMIT 100")
def audit_query(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type").where("event_type = 'error' and ts between timestamp_ntz '2024-01-05' and timestamp_ntz '2024-01-25'")
    return e.orderBy(F.desc("ts"), "event_id").limit(100)


@query("SELECT p_partkey AS id, p_name, (SELECT count(*) FROM part) AS total FROM part ORDER BY p_partkey LIMIT 50 OFFSET 100")
def pagination(spark, sf_dir):
    """A page with the total; the total is an aggregate of its own, so no window gathers the table."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return p.orderBy("id").offset(100).limit(50).join(F.broadcast(p.agg(F.count("*").alias("total"))))


@query("SELECT p_partkey AS id, p_name FROM part WHERE contains(p_name, 'e') AND regexp_matches(p_type, '(?i)^[m-z]') ORDER BY p_partkey LIMIT 40")
def text_predicate(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(F.col("p_name").contains("e") & F.col("p_type").rlike("(?i)^[m-z]"))
    return p.select(F.col("p_partkey").alias("id"), "p_name").orderBy("id").limit(40)


@query(
    r"""SELECT page_id, p.p AS wanted FROM (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages) JOIN (SELECT DISTINCT p FROM (SELECT 'en/' || p_partkey AS p FROM part UNION ALL SELECT 'x/de/' || p_partkey FROM part)) p
ON path = p OR ends_with(path, '/' || p) OR ends_with(p, '/' || path)"""
)
def path_suffix(spark, sf_dir):
    """Paths of pages and wanted paths of which one ends in the other, from a slash on."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    n = F.col("p_partkey").cast("string")
    part = table(spark, sf_dir, "part")
    wanted = part.select(F.concat(F.lit("en/"), n).alias("wanted")).unionByName(part.select(F.concat(F.lit("x/de/"), n).alias("wanted"))).distinct()
    return paths.by_suffix(pages, "path", wanted, "wanted").select("page_id", "wanted")


# ---- work: orders are actions

_WORK = """WITH actions AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'active' ELSE CASE WHEN o_orderkey % 9 = 0 THEN 'blocked' ELSE 'pending' END END AS status,
1 + o_orderkey % 10 AS priority, o_orderdate AS created FROM orders),
edges AS (SELECT id AS src, id - 7 AS dst, 'requires' AS type FROM actions WHERE id % 3 = 0 UNION ALL SELECT id, -id, 'requires' FROM actions WHERE id % 11 = 0 UNION ALL
SELECT id, id + 5, 'unlocks' FROM actions WHERE id % 4 = 0 UNION ALL SELECT id, id - 1, 'spawned_by' FROM actions WHERE id % 5 = 0 UNION ALL
SELECT id, id + 2, 'conflicts_with' FROM actions WHERE id % 13 = 0 UNION ALL SELECT id, id % 50, 'gated_by' FROM actions WHERE id % 6 = 0),
cps AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'passed' ELSE 'pending' END AS status FROM supplier),
blocked AS (SELECT src AS id FROM edges JOIN actions a ON a.id = dst WHERE type = 'requires' AND status <> 'done' UNION SELECT src FROM edges JOIN cps ON cps.id = dst WHERE type = 'gated_by' AND status <> 'passed'
UNION SELECT src FROM edges JOIN actions a ON a.id = dst WHERE type = 'conflicts_with' AND status = 'active' UNION SELECT dst FROM edges JOIN actions a ON a.id = src WHERE type = 'conflicts_with' AND status = 'active'),
front AS (SELECT id, priority, status, round(10 * priority + least(0.5::DOUBLE * ((epoch_us(TIMESTAMP '2001-09-01') - epoch_us(created)) / 86400000000.0::DOUBLE * 24), 20) + 5 * (SELECT count(*) FROM edges WHERE src = a.id AND type = 'unlocks')
+ CASE WHEN EXISTS (SELECT 1 FROM edges WHERE src = a.id AND type = 'spawned_by') THEN 3 ELSE 0 END + CASE WHEN status = 'active' THEN 15 ELSE 0 END, 2) AS score
FROM actions a WHERE status IN ('pending', 'active') AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b.id = a.id))"""


def _work(spark, sf_dir):
    i, st = F.col("id"), F.col("o_orderstatus")
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    status = F.when(st == "F", "done").when(st == "P", "active").when(i % 9 == 0, "blocked").otherwise("pending")
    actions = o.select("id", status.alias("status"), (1 + i % 10).alias("priority"), F.col("o_orderdate").alias("created"))
    kinds = [(3, i - 7, "requires"), (11, -i, "requires"), (4, i + 5, "unlocks"), (5, i - 1, "spawned_by"), (13, i + 2, "conflicts_with"), (6, i % 50, "gated_by")]
    links = F.array(*(F.when(i % n == 0, F.struct(i.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))) for n, dst, kind in kinds))
    edges = actions.select(F.inline(F.filter(links, lambda e: e.isNotNull())))
    cps = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "passed").otherwise("pending").alias("status"))
    return actions, edges, cps


@query(_WORK + " SELECT * FROM front")
def frontier(spark, sf_dir):
    return wk.frontier(*_work(spark, sf_dir), _now())


@query(_WORK + " SELECT * FROM front ORDER BY score DESC, id LIMIT 1")
def next_action(spark, sf_dir):
    return wk.ranked(wk.frontier(*_work(spark, sf_dir), _now()))


@query(_WORK + " SELECT a.id FROM actions a WHERE status = 'blocked' AND EXISTS (SELECT 1 FROM edges WHERE src = a.id AND type = 'requires') AND NOT EXISTS (SELECT 1 FROM edges e LEFT JOIN actions d ON d.id = e.dst WHERE e.src = a.id AND e.type = 'requires' AND coalesce(d.status, '') <> 'done')")
def unblock(spark, sf_dir):
    actions, edges, _ = _work(spark, sf_dir)
    return wk.unblocked(actions, edges)


@query(
    _WORK + """ SELECT id::VARCHAR AS name, 'actions' AS category, 'warn' AS status, false AS fixable FROM actions a WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM cps WHERE cps.id = a.id) UNION ALL
SELECT src::VARCHAR, 'edges', 'fail', true FROM edges e WHERE type = 'requires' AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.id = e.dst) UNION ALL
SELECT id::VARCHAR, 'actions', 'fail', false FROM actions WHERE priority NOT BETWEEN 1 AND 9"""
)
def diagnose(spark, sf_dir):
    """Active actions without a lease, edges to nowhere, priorities out of range."""
    actions, edges, cps = _work(spark, sf_dir)
    return (
        lc.check(actions.where("status = 'active'").join(cps.select("id"), "id", "left_anti"), F.col("id"), "actions", "warn", False)
        .unionByName(lc.check(lc.orphans(edges.where("type = 'requires'"), "dst", actions, "id"), F.col("src"), "edges", "fail", True))
        .unionByName(lc.check(actions.where("priority not between 1 and 9"), F.col("id"), "actions", "fail", False))
    )


@query(
    _WORK + """, c AS (SELECT 'active without lease' AS c, count(*) AS n FROM actions a WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM cps WHERE cps.id = a.id)),
o AS (SELECT 'missing requirement', count(*) FROM edges e WHERE type = 'requires' AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.id = e.dst)) SELECT * FROM c UNION ALL SELECT * FROM o"""
)
def diagnose_rollup(spark, sf_dir):
    actions, edges, cps = _work(spark, sf_dir)
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("c"), "n")
    return n(actions.where("status = 'active'").join(cps.select("id"), "id", "left_anti"), "active without lease").unionByName(n(lc.orphans(edges.where("type = 'requires'"), "dst", actions, "id"), "missing requirement"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id % 5 AS action, event_id, user_id AS who, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click'),
r AS (SELECT action, n, event_id, who, t + 36000000000 AS until, true AS granted FROM e WHERE n = 1 UNION ALL
SELECT e.action, e.n, e.event_id, CASE WHEN e.t >= r.until THEN e.who ELSE r.who END, CASE WHEN e.t >= r.until THEN e.t + 36000000000 ELSE r.until END, e.t >= r.until OR e.who = r.who
FROM r JOIN e ON e.action = r.action AND e.n = r.n + 1) SELECT action, event_id FROM r WHERE granted"""
)
def lease_acquire(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'click'").withColumn("action", F.col("user_id") % 5)
    return wk.leases(e, "action", "ts", "user_id", "event_id", 600)


@query(
    """WITH st AS (SELECT o_custkey AS run, o_orderkey + CASE WHEN o_orderkey % 40 = 0 THEN 10000000 ELSE 0 END AS action FROM orders),
j AS (SELECT run, coalesce(CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'active' ELSE 'pending' END, 'cancelled') AS s, o_orderkey FROM st LEFT JOIN orders ON o_orderkey = action)
SELECT run, count(*) AS steps, count_if(s = 'done' AND o_orderkey IS NOT NULL) AS done, count_if(s = 'active') AS active,
CASE WHEN bool_and(s = 'done' AND o_orderkey IS NOT NULL) THEN 'completed' WHEN bool_or(o_orderkey IS NULL) THEN 'failed' ELSE 'running' END AS state FROM j GROUP BY run"""
)
def routine_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    actions = o.select(F.col("o_orderkey").alias("id"), F.when(st == "F", "done").when(st == "P", "active").otherwise("pending").alias("status"))
    steps = o.select(F.col("o_custkey").alias("run"), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 40 == 0, 10_000_000).otherwise(0)).alias("action"))
    return wk.routine_status(steps, actions)


@query(
    f"""WITH p AS (SELECT o_custkey AS a, o_orderkey AS b, least(0.3, 0.1 * (o_orderkey % 5))::DOUBLE AS sh, {_AGE.format("o_orderdate")} AS d, o_orderkey % 3 AS k FROM orders)
SELECT a, b, round(greatest(0, least(1, 0.5::DOUBLE + sh + CASE WHEN d < 7 THEN 0.1 WHEN d > 90 THEN -0.1 ELSE 0 END + CASE k WHEN 0 THEN 0.1 WHEN 1 THEN -0.05 ELSE 0 END)), 6) AS confidence FROM p"""
)
def relation_confidence(spark, sf_dir):
    days = sc.days_between(_now(), F.col("o_orderdate"))
    kind = F.element_at(F.array(F.lit("supersedes"), F.lit("contradicts"), F.lit("related")), (1 + F.col("o_orderkey") % 3).cast("int"))
    c = sc.relation_confidence(F.col("o_orderkey") % 5, days, days, kind)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"), F.round(c, 6).alias("confidence"))


@query(
    """SELECT c_custkey AS id, array_to_string(list_slice(list_sort(list(o_orderkey)), -20, -1), ',') AS recent, count(*) AS n, max(o_orderdate) AS last_at FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1"""
)
def access_log(spark, sf_dir):
    """The last twenty accesses of each memory, kept by a bounded window before they are gathered."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))
    o = table(spark, sf_dir, "orders")
    last = o.withColumn("r", F.row_number().over(w)).where("r <= 20").groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")), ",").alias("recent"))
    return o.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_at")).join(last, "id")
