"""Registered queries: functions that put several operators together."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import search as s
from ..operators import similarity as sim
from ..operators import slots
from ..sources.tables import spread, table
from .registry import query
from .retrieval import _SETS


@query(
    """SELECT file, id, rank FROM (SELECT f.p_partkey AS file, d.doc_id AS id, row_number() OVER (PARTITION BY f.p_partkey ORDER BY d.n_chars DESC, d.doc_id) AS rank
FROM part f JOIN documents d ON d.source = 'src' || f.p_partkey OR ends_with(d.source, '/src' || f.p_partkey) WHERE d.n_chars >= 400) WHERE rank <= 5"""
)
def file_context(spark, sf_dir):
    """Observations of a file, by path or by a suffix that begins at a slash: the last part is joined on, the whole is checked."""
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.concat(F.lit("src"), F.col("p_partkey")).alias("path"))
    docs = table(spark, sf_dir, "documents").where("n_chars >= 400").select(F.col("doc_id").alias("id"), "source", "n_chars")
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    met = docs.withColumn("k", last("source")).join(s.small(files.withColumn("k", last("path"))), "k")
    met = met.where((F.col("source") == F.col("path")) | F.col("source").endswith(F.concat(F.lit("/"), "path")) | F.col("path").endswith(F.concat(F.lit("/"), "source")))
    return s.top(met, ["file"], [F.desc("n_chars"), F.asc("id")], 5).select("file", "id", "rank")


@query(
    """SELECT o_orderkey AS memory, count(*) AS citations, count(DISTINCT l_suppkey) AS sessions, count_if(s_suppkey IS NULL) AS missing
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 9 <> 0 GROUP BY 1"""
)
def verify_citations(spark, sf_dir):
    """A memory's source observations and their sessions; those that are gone are counted."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("memory"), "l_suppkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("memory")).join(l, "memory", "left")
    sessions = s.small(table(spark, sf_dir, "supplier").where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(1).alias("there")))
    out = o.join(sessions, "l_suppkey", "left").groupBy("memory")
    return out.agg(F.count("*").alias("citations"), F.count_distinct("l_suppkey").alias("sessions"), F.count_if(F.col("there").isNull()).alias("missing"))


@query(
    """WITH RECURSIVE b AS (SELECT source, doc_id, ceil((length(text) + 40) / 3.0)::BIGINT AS t, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents),
r AS (SELECT source, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS id FROM b GROUP BY source
UNION ALL SELECT r.source, b.n, CASE WHEN r.used + b.t <= 2000 THEN r.used + b.t ELSE r.used END, CASE WHEN r.used + b.t <= 2000 THEN b.doc_id END FROM r JOIN b ON b.source = r.source AND b.n = r.n + 1)
SELECT source, id, used FROM r WHERE id IS NOT NULL"""
)
def context_pack(spark, sf_dir):
    """Blocks in order of recency, header and footer counted, passing over what doesn't fit."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(w).alias("n"), F.ceil((F.length("text") + 40) / 3).alias("t"))
    return s.skip_budget(d, ["source"], "n", "doc_id", "t", 2000)


@query(
    """WITH e AS (SELECT p_brand AS session, p_partkey AS id, p_size AS t, p_partkey % 10 = 0 AS pinned, round(p_retailprice, 2) AS score FROM part),
o AS (SELECT *, sum(t) OVER (PARTITION BY session ORDER BY pinned DESC, score DESC, id) AS used FROM e) SELECT session, id, pinned OR used <= 100 AS admitted FROM o"""
)
def working_context(spark, sf_dir):
    """Pinned entries always, then by score within the budget."""
    e = table(spark, sf_dir, "part").select(F.col("p_brand").alias("session"), F.col("p_partkey").alias("id"), F.col("p_size").alias("t"), (F.col("p_partkey") % 10 == 0).alias("pinned"), F.round("p_retailprice", 2).alias("score"))
    w = Window.partitionBy("session").orderBy(F.desc("pinned"), F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.select("session", "id", (F.col("pinned") | (F.sum("t").over(w) <= 100)).alias("admitted"))


@query(
    """SELECT lower(p_name) AS title, p_brand AS project, count(*) AS version, max(p_partkey) AS latest, array_to_string(list_slice(list_reverse(list_sort(list(p_partkey))), 2, 1000000), ',') AS supersedes FROM part GROUP BY 1, 2"""
)
def consolidate_upsert(spark, sf_dir):
    """A memory of the same title in the same project evolves: one latest version, the others superseded, newest first."""
    ids = F.reverse(F.sort_array(F.collect_list("p_partkey")))
    g = table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("title"), F.col("p_brand").alias("project")).agg(F.count("*").alias("version"), F.max("p_partkey").alias("latest"), ids.alias("ids"))
    return g.select("title", "project", "version", "latest", F.array_join(F.slice("ids", 2, 1_000_000), ",").alias("supersedes"))


@query("SELECT lower(p_type) AS fact, count(*) AS access_count, max((p_partkey % 10) / 10.0::DOUBLE) AS confidence, round(least(1.0, 0.5::DOUBLE + 0.1::DOUBLE * (count(*) - 1)), 6) AS strength FROM part GROUP BY 1")
def semantic_upsert(spark, sf_dir):
    n = F.count("*")
    return table(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("fact")).agg(n.alias("access_count"), F.max((F.col("p_partkey") % 10) / 10.0).alias("confidence"), F.round(F.least(F.lit(1.0), 0.5 + 0.1 * (n - 1)), 6).alias("strength"))


@query(
    """SELECT 'skill_' || substr(sha256(lower(event_type) || '|' || (user_id % 7)), 1, 16) AS id, count(DISTINCT user_id) AS sessions, round(least(1.0, 0.5::DOUBLE + 0.15::DOUBLE * (count(DISTINCT user_id) - 1)), 6) AS strength FROM events GROUP BY lower(event_type), user_id % 7"""
)
def skill_upsert(spark, sf_dir):
    """A skill is reinforced once by each session."""
    n = F.count_distinct("user_id")
    g = table(spark, sf_dir, "events").groupBy(F.lower("event_type").alias("t"), (F.col("user_id") % 7).alias("u")).agg(n.alias("sessions"), F.round(F.least(F.lit(1.0), 0.5 + 0.15 * (n - 1)), 6).alias("strength"))
    return g.select(tx.fingerprint_id("skill", F.concat_ws("|", "t", F.col("u").cast("string"))).alias("id"), "sessions", "strength")


@query(
    """SELECT 'sha' || (o_orderkey % 97) AS sha, count(DISTINCT o_custkey) AS sessions, min(o_orderdate) AS linked_at, arg_max(o_orderpriority, o_orderkey) AS branch FROM orders GROUP BY 1"""
)
def commit_linking(spark, sf_dir):
    """Sessions of a commit united, the first link's time kept, the newest known field wins."""
    g = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("sha"), (F.col("o_orderkey") % 97).cast("string")).alias("sha"))
    return g.agg(F.size(F.collect_set("o_custkey")).cast("long").alias("sessions"), F.min("o_orderdate").alias("linked_at"), F.max_by("o_orderpriority", "o_orderkey").alias("branch"))


@query("SELECT user_id, (n - 1) // 25 AS batch, count(*) AS n, min(event_id) AS first_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY ALL")
def graph_build_batches(spark, sf_dir):
    """Batches of 25 observations a session, for extraction."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor((F.row_number().over(w) - 1) / 25).alias("batch"))
    return e.groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT 'events' AS scope, event_id AS id FROM events WHERE ts > TIMESTAMP '2024-01-28' UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '2001-06-01'")
def mesh_delta(spark, sf_dir):
    """What changed since a time, scope by scope."""
    e = table(spark, sf_dir, "events").where("ts > timestamp_ntz '2024-01-28'").select(F.lit("events").alias("scope"), F.col("event_id").alias("id"))
    return e.unionByName(table(spark, sf_dir, "orders").where("o_orderdate > timestamp_ntz '2001-06-01'").select(F.lit("orders").alias("scope"), F.col("o_orderkey").alias("id")))


@query(
    """WITH s AS (SELECT unnest([1, 2, 3, 4]) AS id, unnest(['gt', 'lt', 'eq', 'gt']) AS op, unnest([100, 100, 0, 1000000]) AS bound),
c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT id, event_type, n FROM s JOIN c ON (op = 'gt' AND n > bound) OR (op = 'lt' AND n < bound) OR (op = 'eq' AND n = bound)"""
)
def sentinel_threshold(spark, sf_dir):
    """Sentinels on counts: a few of them against a few groups."""
    rules = spark.createDataFrame([(1, "gt", 100), (2, "lt", 100), (3, "eq", 0), (4, "gt", 1_000_000)], "id int, op string, bound long")
    c = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    n, b, op = F.col("n"), F.col("bound"), F.col("op")
    return c.join(F.broadcast(rules), ((op == "gt") & (n > b)) | ((op == "lt") & (n < b)) | ((op == "eq") & (n == b))).select("id", "event_type", "n")


@query("SELECT user_id, min(event_id) AS first_match FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND regexp_matches(event_type, '(?i)^ERR|chase$') GROUP BY user_id")
def sentinel_pattern(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("ts >= timestamp_ntz '2024-01-10'").where(F.col("event_type").rlike("(?i)^ERR|chase$"))
    return e.groupBy("user_id").agg(F.min("event_id").alias("first_match"))


@query(
    """SELECT o_custkey AS action, bool_and(o_orderstatus <> 'P') AS gates_passed, bool_and(l IS NOT NULL) AS requires_done FROM orders
LEFT JOIN (SELECT DISTINCT l_orderkey AS l FROM lineitem WHERE l_returnflag = 'R') ON l = o_orderkey GROUP BY 1 HAVING bool_and(o_orderstatus <> 'P') AND bool_or(l IS NOT NULL)"""
)
def checkpoint_resolve(spark, sf_dir):
    """Actions whose gates have all passed, with whether all that they require is done."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("done", F.lit(True))
    o = table(spark, sf_dir, "orders").join(done, "o_orderkey", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    g = o.groupBy(F.col("o_custkey").alias("action")).agg(F.bool_and(F.col("o_orderstatus") != "P").alias("gates_passed"), F.bool_and("done").alias("requires_done"), F.bool_or("done").alias("_any"))
    return g.where("gates_passed and _any").drop("_any")


@query(
    """SELECT source, doc_id FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source) - coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l
FROM documents WHERE doc_id % 4 <> 0) WHERE l > 20000"""
)
def image_quota(spark, sf_dir):
    """The oldest that nothing refers to go until the rest fits the quota."""
    from ..operators.lifecycle import page_out

    d = table(spark, sf_dir, "documents").where("doc_id % 4 <> 0").select("source", "doc_id", "n_chars")
    return page_out(d, ["source"], "doc_id", "doc_id", "n_chars", 20_000).select("source", "doc_id")


@query(
    _SETS.format(more="doc_id % 5 = 4 AS fresh, CASE WHEN doc_id % 7 <> 0 THEN lang END AS p,")
    + """, l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT k, k FROM c), s AS (SELECT t.*, k FROM t JOIN c ON t.w = c.w)
SELECT n.doc_id AS id, min(o.doc_id) AS supersedes FROM s n JOIN l ON n.k = l.a JOIN s o ON o.k = l.b WHERE n.fresh AND NOT o.fresh AND (n.p IS NULL OR o.p IS NULL OR n.p = o.p) GROUP BY 1"""
)
def remember_supersede(spark, sf_dir):
    """A new memory supersedes the first, not the likeliest, that is over 0.7 alike; memories of two known projects never do."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    t = d.select("doc_id", tx.jaccard_tokens(F.lower("text")).alias("w"), F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("p"))
    return sim.first_similar(t.where("doc_id % 5 = 4"), t.where("doc_id % 5 <> 4"), "doc_id", "w", "p", 0.7)


@query(
    r"""SELECT item_id, n, kind, least(1, greatest(0, coalesce(try_cast(w AS DOUBLE), 0.5))) AS weight FROM (
SELECT item_id, regexp_extract(x, 'name="([^"]*)"', 1) AS n, regexp_extract(x, 'type="([^"]*)"', 1) AS kind, regexp_extract(x, 'weight="([^"]*)"', 1) AS w FROM (
SELECT item_id, unnest(regexp_extract_all('<entity name="e' || item_id || '" type="file" weight="' || (item_id / 10.0::DOUBLE) || '"/><entity name="x" type="fn" weight="no"/>', '<entity [^>]*/>')) AS x FROM benchmark))"""
)
def xml_entities(spark, sf_dir):
    """Entities in a model's answer; a weight that is no number is 0.5, others are held within 0 and 1."""
    answer = F.concat(F.lit('<entity name="e'), F.col("item_id").cast("string"), F.lit('" type="file" weight="'), (F.col("item_id") / 10.0).cast("string"), F.lit('"/><entity name="x" type="fn" weight="no"/>'))
    x = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all(answer, F.lit("<entity [^>]*/>"), F.lit(0))).alias("x"))
    attr = lambda a: F.regexp_extract("x", f'{a}="([^"]*)"', 1)
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(attr("weight").try_cast("double"), F.lit(0.5))))
    return x.select("item_id", attr("name").alias("n"), attr("type").alias("kind"), weight.alias("weight"))


@query(
    r"""WITH RECURSIVE c AS (SELECT conv_id, text AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations WHERE text <> ''),
r AS (SELECT conv_id, 0::BIGINT AS n, '' AS content, 0 AS rejected FROM c GROUP BY conv_id UNION ALL
SELECT r.conv_id, c.n, CASE WHEN length(x) <= 2000 THEN x ELSE content END, rejected + (length(x) > 2000)::INT FROM (
  SELECT r.conv_id, r.content, r.rejected, c.n, r.content || CASE WHEN r.content <> '' AND NOT ends_with(r.content, chr(10)) THEN chr(10) ELSE '' END || c.t AS x FROM r JOIN c ON c.conv_id = r.conv_id AND c.n = r.n + 1) r JOIN c ON c.conv_id = r.conv_id AND c.n = r.n)
SELECT conv_id, content, rejected FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1"""
)
def slot_append(spark, sf_dir):
    """Whole texts are added to a slot as lines; one that would exceed the limit is rejected and the next is tried."""
    c = table(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", "text")
    return slots.appended(c, "conv_id", ["turn", "text"], "text", 2000)


@query(
    r"""SELECT source, count(*) AS docs, count_if(lang = 'en') * 2 > count(*) AS mostly_english, count_if(contains(text, '|')) * 2 > count(*) AS tabular, count_if(regexp_matches(text, '[a-z_]+ ?= ?\S+')) > 0 AS has_settings FROM documents GROUP BY source"""
)
def conventions(spark, sf_dir):
    """Conventions of a project: what holds for more than half of its rows."""
    more = lambda c: F.count_if(c) * 2 > F.count("*")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"), more(F.col("lang") == "en").alias("mostly_english"), more(F.col("text").contains("|")).alias("tabular"), (F.count_if(F.col("text").rlike(r"[a-z_]+ ?= ?\S+")) > 0).alias("has_settings"))


@query(
    r"""SELECT doc_id, length(text) > 6000 OR len(list_distinct(v)) > 1 OR regexp_matches(text, '(?i)\b(before|after|until|since)\b') AS complex FROM (
SELECT doc_id, text, regexp_extract_all(text, 'token = "?([A-Za-z0-9]+)', 1) AS v FROM documents)"""
)
def consolidation_complexity(spark, sf_dir):
    """Long inputs, settings that contradict each other, and words of time need the better model."""
    values = F.array_distinct(F.regexp_extract_all("text", F.lit('token = "?([A-Za-z0-9]+)'), F.lit(1)))
    words = F.col("text").rlike(r"(?i)(?<![A-Za-z0-9_])(before|after|until|since)(?![A-Za-z0-9_])")
    return table(spark, sf_dir, "documents").select("doc_id", ((F.length("text") > 6000) | (F.size(values) > 1) | words).alias("complex"))


@query("SELECT user_id, session_state, n FROM (SELECT user_id, CASE WHEN max(ts) < TIMESTAMP '2024-01-25' THEN 'completed' ELSE 'active' END AS session_state, count(*) AS n FROM events GROUP BY user_id)")
def session_states(spark, sf_dir):
    ended = F.max("ts") < F.lit("2024-01-25").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.when(ended, "completed").otherwise("active").alias("session_state"), F.count("*").alias("n"))


@query(
    """SELECT p_partkey AS id, round(s * r, 6) AS score FROM (SELECT p_partkey, (1 + p_partkey % 9) / 10.0::DOUBLE AS s, (contains(lower(p_name), 'red')::INT + contains(lower(p_name), 'bolt')::INT) / 2.0::DOUBLE AS r FROM part) WHERE r > 0"""
)
def skill_match(spark, sf_dir):
    """Strength times the share of the query's longer terms that the trigger contains."""
    name, strength = F.lower("p_name"), (1 + F.col("p_partkey") % 9) / 10.0
    share = sum(name.contains(t).cast("int") for t in ("red", "bolt")) / 2.0
    return table(spark, sf_dir, "part").where(share > 0).select(F.col("p_partkey").alias("id"), F.round(strength * share, 6).alias("score"))

