"""Registered queries: search requests end to end, the graph's part in them, and the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph as g
from ..operators import paths
from ..operators import recall as r
from ..operators import search as s
from ..sources.tables import latest, table
from .registry import query
from .retrieval import _FUSED, _PREFIX, _SCORED, _TERMS, _bm25, _fused, _vectors

# ---- what is searched: three of four documents are observations, the others memories; sessions 40 to 49 are not known

_WORLD = """,
obs AS (SELECT doc_id AS id, 's' || (doc_id % 50) AS session, substr(text, 1, 30) AS title, source AS type, text AS narrative, (doc_id % 10)::BIGINT AS importance, n_chars AS "timestamp", CASE WHEN doc_id % 9 <> 0 THEN lang END AS agent FROM documents WHERE doc_id % 4 <> 0),
mem AS (SELECT doc_id AS id, CASE WHEN doc_id % 8 = 0 THEN 'memory' END AS session, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'p1' ELSE 'p2' END AS project, CASE WHEN doc_id % 20 <> 0 THEN substr(text, 1, 30) ELSE '' END AS title, text AS content,
  (doc_id % 7)::BIGINT AS strength, n_chars AS updated_at, lang AS agent, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS is_latest FROM documents WHERE doc_id % 4 = 0),
ses AS (SELECT DISTINCT 's' || (doc_id % 50) AS session, 'p' || (doc_id % 50 % 3) AS project, '/w/' || (doc_id % 50 % 2) || '/src' AS cwd FROM documents WHERE doc_id % 50 < 40),
whole AS (SELECT id, session, title, type, narrative, "timestamp", agent, NULL AS mp FROM obs UNION ALL SELECT id, session, title, 'decision', content, updated_at, agent, project FROM mem)"""


def _world(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    named = lambda n: F.concat(F.lit("s"), (i % n).cast("string"))
    head = F.substring("text", 1, 30)
    obs = d.where(i % 4 != 0).select(i.alias("id"), named(50).alias("session"), head.alias("title"), F.col("source").alias("type"), F.col("text").alias("narrative"), (i % 10).alias("importance"), F.col("n_chars").alias("timestamp"), F.when(i % 9 != 0, F.col("lang")).alias("agent"))
    project = F.when(i % 3 == 1, "p1").when(i % 3 == 2, "p2")
    mem = d.where(i % 4 == 0).select(
        i.alias("id"), F.when(i % 8 == 0, "memory").alias("session"), project.alias("project"), F.when(i % 20 != 0, head).otherwise("").alias("title"), F.col("text").alias("content"),
        (i % 7).alias("strength"), F.col("n_chars").alias("updated_at"), F.col("lang").alias("agent"), F.when(i % 5 == 0, None).otherwise(i % 5 != 1).alias("is_latest"),
    )
    ses = d.where(i % 50 < 40).select(named(50).alias("session"), F.concat(F.lit("p"), (i % 50 % 3).cast("string")).alias("project"), F.concat(F.lit("/w/"), (i % 50 % 2).cast("string"), F.lit("/src")).alias("cwd")).distinct()
    return obs, mem, ses


_SEARCH = _TERMS + _SCORED.format(prefix=_PREFIX, k=200) + _WORLD


def _page_sql(fits: str, n: int) -> str:
    return f""", hits AS (SELECT b.query_id, b.id, b.score, w.session, w.title, w.type, w.narrative, w."timestamp", w.agent FROM bm25 b JOIN whole w USING (id) LEFT JOIN ses ON ses.session = w.session WHERE {fits}),
pg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hits) WHERE rank <= {n})"""


@query(
    _SEARCH + _page_sql("CASE WHEN ses.session IS NOT NULL THEN ses.project = 'p1' ELSE w.mp IS NULL OR w.mp = 'p1' END", 20) + """,
u AS (SELECT *, sum(greatest(1, ceil(length(concat_ws(' ', title, type)) / 3.0)::BIGINT)) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS used, greatest(1, ceil(length(concat_ws(' ', title, type)) / 3.0)::BIGINT) AS tokens FROM pg)
SELECT query_id, id, session, score, rank, title, type, "timestamp", tokens, used FROM u WHERE used <= 120"""
)
def search_project_compact(spark, sf_dir):
    """Basic search in a project: compact rows until the token budget is used up."""
    return r.basic_search(lambda k: _bm25(spark, sf_dir, k), *_world(spark, sf_dir), project="p1", form="compact", budget=120)


@query(
    _SEARCH + _page_sql("(ses.session IS NULL OR ses.cwd = '/w/1/src') AND w.agent = 'en'", 20)
    + ' SELECT query_id, id, session, score, rank, title, narrative, "timestamp" FROM pg'
)
def search_agent_narrative(spark, sf_dir):
    """Basic search in a directory for one agent's rows, with whole narratives."""
    agent = r.agent_scope("en", isolated=True, own=None)
    return r.basic_search(lambda k: _bm25(spark, sf_dir, k), *_world(spark, sf_dir), cwd="/w/1/src", agent=agent, form="narrative")


@query(
    _FUSED + _WORLD + """, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM fused) WHERE n <= 30)
SELECT query_id, id, session, score, rank, title, type, "timestamp" FROM (SELECT f.*, w.session, w.title, w.type, w."timestamp", row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, f.id) AS rank FROM f JOIN whole w USING (id) WHERE w.agent = 'en') WHERE rank <= 10"""
)
def smart_search(spark, sf_dir):
    """Hybrid search, more asked for than a page holds, then one agent's rows."""
    obs, mem, _ = _world(spark, sf_dir)
    return r.smart_search(lambda k: _fused(spark, sf_dir), obs, mem, 10, r.agent_scope(None, True, "en"))


@query(
    "WITH x AS (SELECT 1)" + _WORLD + """, a AS (SELECT item_id AS query_id, n AS place, item_id * 7 + n * 3 AS id FROM benchmark, range(1, 26) t(n))
SELECT query_id, id, session, title, narrative, importance FROM a JOIN obs USING (id) WHERE place <= 20 AND agent = 'en'"""
)
def expand_ids(spark, sf_dir):
    """Observations in full for the first twenty ids of each request."""
    obs, _, _ = _world(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(25))).alias("at")).withColumn("id", F.col("query_id") * 7 + F.col("at") * 3)
    return r.expand(asked, obs, "en").select("query_id", "id", "session", "title", "narrative", "importance")


@query(
    "WITH x AS (SELECT 1)" + _WORLD + """SELECT id, coalesce(session, 'memory') AS session, concat_ws(' ', title, content) AS text FROM mem WHERE is_latest IS DISTINCT FROM false AND title <> '' AND content <> ''
UNION ALL SELECT id, session, concat_ws(' ', title, narrative, type) FROM obs WHERE title <> '' AND narrative <> ''""".replace("SELECT id, coalesce", " SELECT id, coalesce", 1)
)
def index_rebuild(spark, sf_dir):
    """The texts of a rebuilt index."""
    obs, mem, _ = _world(spark, sf_dir)
    return r.indexable(mem, obs)


@query("SELECT p_partkey, p_name, p_brand FROM part JOIN benchmark ON p_partkey = item_id")
def point_lookup(spark, sf_dir):
    """Rows of a batch of keys; the keys are the small side."""
    keys = s.small(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("p_partkey")))
    return table(spark, sf_dir, "part").join(keys, "p_partkey").select("p_partkey", "p_name", "p_brand")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def upsert_log(spark, sf_dir):
    """The table that a log of upserts and deletions (errors) amounts to."""
    log = table(spark, sf_dir, "events").withColumn("gone", F.col("event_type") == "error")
    return latest(log, "user_id", F.struct("ts", "event_id"), "gone").select("user_id", "event_id", "event_type", "value")


@query("SELECT doc_id AS id FROM documents WHERE source = 'src1' OR starts_with(source || '/x', 'src1/') OR starts_with('src1/' || lang, 'src1/en')")
def path_prefix(spark, sf_dir):
    """Directories that are a root or lie below it."""
    d = table(spark, sf_dir, "documents")
    below = paths.under(F.concat(F.col("source"), F.lit("/x")), F.lit("src1")) | paths.under(F.concat(F.lit("src1/"), F.col("lang")), F.lit("src1/en"))
    return d.where((F.col("source") == "src1") | below).select(F.col("doc_id").alias("id"))


# ---- the graph: countries and regions, of which customers and suppliers are observed

_NET = """WITH nodes AS (SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT 1000 + r_regionkey, r_name FROM region),
edges AS (SELECT n_nationkey::BIGINT AS src, (1000 + n_regionkey)::BIGINT AS dst, 0.2::DOUBLE + (n_nationkey % 8) / 10.0::DOUBLE AS weight FROM nation),
prov AS (SELECT c_nationkey::BIGINT AS id, c_custkey AS obs FROM customer UNION ALL SELECT 1000 + n_regionkey, 10000000 + s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
asked AS (SELECT r_regionkey::BIGINT AS query_id, lower(substr(r_name, 1, 3 + r_regionkey)) AS entity FROM region UNION ALL SELECT 100 + n_nationkey, 'in ' || n_name || ' now' FROM nation WHERE n_nationkey % 5 = 0),
u AS (SELECT src AS a, dst AS b, weight AS w FROM edges UNION ALL SELECT dst, src, weight FROM edges),
hit AS (SELECT DISTINCT query_id, id FROM asked JOIN nodes ON contains(lower(name), lower(entity)) OR contains(lower(entity), lower(name))),
p AS (SELECT a AS start, b AS id, 1 / greatest(w, 0.01) AS cost, w / 2 AS score FROM u UNION ALL
  SELECT x.a, y.b, 1 / greatest(x.w, 0.01) + 1 / greatest(y.w, 0.01), (x.w + y.w) / 2 / 3 FROM u x JOIN u y ON x.b = y.a WHERE y.b <> x.a),
met AS (SELECT query_id, obs, start, 0 AS own, round(cost, 9) AS cost, p.id AS node, score FROM hit JOIN p ON p.start = hit.id JOIN prov ON prov.id = p.id UNION ALL
  SELECT query_id, obs, hit.id, 1, 0, hit.id, 1.0 FROM hit JOIN prov ON prov.id = hit.id),
ent AS (SELECT query_id, obs AS id, round(arg_min(score, (start, own, cost, node)), 6) AS score FROM met GROUP BY ALL),
ents AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ent) WHERE rank <= 20)"""


def _net(spark, sf_dir):
    n, rg = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nodes = n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")).unionByName(rg.select((1000 + F.col("r_regionkey")).cast("long").alias("id"), F.col("r_name").alias("name")))
    edges = n.select(F.col("n_nationkey").cast("long").alias("src"), (1000 + F.col("n_regionkey")).cast("long").alias("dst"), (F.lit(0.2) + (F.col("n_nationkey") % 8) / 10.0).alias("weight"))
    seen = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("id"), F.col("c_custkey").alias("obs"))
    there = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("n_nationkey") == F.col("s_nationkey")).select((1000 + F.col("n_regionkey")).cast("long").alias("id"), (10_000_000 + F.col("s_suppkey")).alias("obs"))
    asked = rg.select(F.col("r_regionkey").cast("long").alias("query_id"), F.lower(F.expr("substring(r_name, 1, 3 + r_regionkey)")).alias("entity"))
    asked = asked.unionByName(n.where("n_nationkey % 5 = 0").select((100 + F.col("n_nationkey")).cast("long").alias("query_id"), F.concat(F.lit("in "), "n_name", F.lit(" now")).alias("entity")))
    return nodes, edges, seen.unionByName(there), asked


@query(_NET + " SELECT * FROM ents")
def graph_entity_search(spark, sf_dir):
    """Observations near the nodes that entities name, by cheapest paths of up to two hops."""
    return g.entity_hits(*_net(spark, sf_dir))


_SEEDS = """, seeds AS (SELECT query_id, c_custkey AS obs FROM (SELECT DISTINCT query_id FROM asked) JOIN customer ON c_custkey % 40 = query_id % 40),
x AS (SELECT DISTINCT s.query_id, q.obs AS id FROM seeds s JOIN prov ON prov.obs = s.obs JOIN u ON u.a = prov.id JOIN prov q ON q.id = u.b WHERE NOT EXISTS (SELECT 1 FROM seeds t WHERE t.query_id = s.query_id AND t.obs = q.obs)),
exps AS (SELECT * FROM (SELECT query_id, id, 0.5::DOUBLE / 3 AS score, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM x) WHERE rank <= 5)"""


def _seeds(spark, sf_dir):
    *_, asked = _net(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("obs"), (F.col("c_custkey") % 40).alias("k"))
    return asked.select("query_id").distinct().withColumn("k", F.col("query_id") % 40).join(c, "k").select("query_id", "obs")


@query(_NET + _SEEDS + " SELECT query_id, id, round(score, 6) AS score, rank FROM exps")
def graph_expand_chunks(spark, sf_dir):
    """Observations one hop from those already found."""
    _, edges, prov, _ = _net(spark, sf_dir)
    return g.expansion_hits(edges, prov, _seeds(spark, sf_dir), 5).withColumn("score", F.round("score", 6))


@query(
    _NET + _SEEDS + """, n AS (SELECT query_id, max(rank) AS n FROM ents GROUP BY 1), gr AS (SELECT query_id, id, rank FROM ents UNION ALL SELECT e.query_id, id, rank + coalesce(n, 0) FROM exps e LEFT JOIN n USING (query_id)),
kw AS (SELECT q.query_id, c_custkey AS id, row_number() OVER (PARTITION BY q.query_id ORDER BY c_acctbal DESC, c_custkey) AS rank FROM (SELECT DISTINCT query_id FROM asked) q JOIN customer ON c_nationkey = q.query_id % 25),
al AS (SELECT query_id, id, rank, 'b' AS s FROM kw WHERE rank <= 20 UNION ALL SELECT query_id, id, rank, 'g' FROM gr),
e AS (SELECT query_id, id, min(CASE WHEN s = 'b' THEN rank END) AS b, min(CASE WHEN s = 'g' THEN rank END) AS g FROM al GROUP BY ALL),
w AS (SELECT *, CASE WHEN max(g IS NOT NULL) OVER (PARTITION BY query_id) THEN 0.3::DOUBLE ELSE 0.0 END AS wg FROM e)
SELECT query_id, id, round((0.4::DOUBLE * coalesce(1.0::DOUBLE / (60 + b), 0) + wg * coalesce(1.0::DOUBLE / (60 + g), 0)) / (0.4::DOUBLE + wg), 9) AS score FROM w"""
)
def hybrid_graph_stream(spark, sf_dir):
    """The graph's hits, by entities and then by expansion, one list after the other, fused with another ranking."""
    nodes, edges, prov, asked = _net(spark, sf_dir)
    graph = g.appended([g.entity_hits(nodes, edges, prov, asked), g.expansion_hits(edges, prov, _seeds(spark, sf_dir), 5)])
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("score"))
    ranked = s.top(asked.select("query_id").distinct().withColumn("k", (F.col("query_id") % 25).cast("int")).join(c, "k"), ["query_id"], [F.desc("score"), F.asc("id")], 20)
    return s.rrf({"bm25": ranked, "graph": graph})


_TRIPLE = (
    _FUSED.replace("u AS (SELECT query_id, id, min", """near AS (SELECT d.source AS a, d.doc_id AS obs FROM documents d),
lk AS (SELECT DISTINCT source AS a, lang AS b FROM documents), ed AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk), pv AS (SELECT source AS id, doc_id AS obs FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT lang, doc_id FROM documents WHERE doc_id % 3 <> 0),
sd AS (SELECT query_id, id AS obs FROM vec WHERE rank <= 5), xp AS (SELECT DISTINCT s.query_id, q.obs AS id FROM sd s JOIN pv ON pv.obs = s.obs JOIN ed ON ed.a = pv.id JOIN pv q ON q.id = ed.b WHERE NOT EXISTS (SELECT 1 FROM sd t WHERE t.query_id = s.query_id AND t.obs = q.obs)),
gr AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM xp) WHERE rank <= 5),
u AS (SELECT query_id, id, min(CASE WHEN s = 'g' THEN rank END) AS g, min""")
    .replace("UNION ALL SELECT query_id, id, rank, 'v' FROM vec)", "UNION ALL SELECT query_id, id, rank, 'v' FROM vec UNION ALL SELECT query_id, id, rank, 'g' FROM gr)")
    .replace("AS wv FROM u)", "AS wv, CASE WHEN max(g IS NOT NULL) OVER (PARTITION BY query_id) THEN 0.3::DOUBLE ELSE 0.0 END AS wg FROM u)")
    .replace("wv * coalesce(1.0::DOUBLE / (60 + v), 0)) / (0.4::DOUBLE + wv)", "wv * coalesce(1.0::DOUBLE / (60 + v), 0) + wg * coalesce(1.0::DOUBLE / (60 + g), 0)) / (0.4::DOUBLE + wv + wg)")
)


@query(_TRIPLE + " SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 10")
def hybrid_triple(spark, sf_dir):
    """Keywords, vectors, and what the graph adds to the five nearest vectors, fused."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = table(spark, sf_dir, "benchmark").join(e, F.col("item_id") == F.col("id")).select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))
    vec = s.vector_top(e, asked, 20)
    d = table(spark, sf_dir, "documents")
    edges = d.select(F.col("source").alias("src"), F.col("lang").alias("dst")).distinct().withColumn("weight", F.lit(1.0))
    prov = d.where("doc_id % 3 = 0").select(F.col("source").alias("id"), F.col("doc_id").alias("obs")).unionByName(d.where("doc_id % 3 <> 0").select(F.col("lang").alias("id"), F.col("doc_id").alias("obs")))
    graph = g.expansion_hits(edges, prov, vec.where("rank <= 5").select("query_id", F.col("id").alias("obs")), 5)
    return s.top(s.rrf({"bm25": _bm25(spark, sf_dir, 20), "vector": vec, "graph": graph}), ["query_id"], [F.desc("score"), F.asc("id")], 10)


@query(
    _NET + """, st AS (SELECT id AS start FROM nodes WHERE id >= 1000), d AS (SELECT DISTINCT a, b FROM u),
h1 AS (SELECT start, b AS id FROM st JOIN d ON a = start), h2 AS (SELECT DISTINCT start, d.b AS id FROM h1 JOIN d ON d.a = h1.id),
al AS (SELECT start, id, min(h) AS hops FROM (SELECT start, start AS id, 0 AS h FROM st UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL)
SELECT start, id, hops, name FROM (SELECT al.*, name, row_number() OVER (PARTITION BY start ORDER BY hops, al.id) AS n FROM al JOIN nodes USING (id) WHERE id < 1000) WHERE n > 1 AND n <= 4"""
)
def graph_page(spark, sf_dir):
    """A page of the nations about each region; the type filters what is shown, not the ways."""
    nodes, edges, _, _ = _net(spark, sf_dir)
    typed = nodes.withColumn("type", F.when(F.col("id") < 1000, "nation").otherwise("region"))
    return g.query_page(typed, edges, nodes.where("id >= 1000").select(F.col("id").alias("start")), 2, "nation", 3, 1)[0].select("start", "id", "hops", "name")


@query("SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'ti') OR contains(lower(p_brand), 'ti') OR contains(lower(p_type), 'ti')")
def graph_text_query(spark, sf_dir):
    """Nodes whose name or any of whose properties holds a text."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("properties"))
    return g.text_matches(p, "TI").select("id")


@query("SELECT id, count(*) AS degree FROM (SELECT l_partkey AS id FROM lineitem UNION ALL SELECT 100000000 + l_suppkey FROM lineitem) GROUP BY id ORDER BY degree DESC, id LIMIT 500")
def graph_snapshot_grown(spark, sf_dir):
    """The snapshot after more edges, from the degrees before and the new edges alone."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (100_000_000 + F.col("l_suppkey")).alias("dst"), F.lit(1.0).alias("weight"), "l_linenumber")
    return g.grown_snapshot(g.degrees(e.where("l_linenumber <= 4")), e.where("l_linenumber > 4"))[1]


@query(None)
def concept_clusters_graph(spark, sf_dir):
    """Clusters of concepts within two hops; held against a plain version in the tests."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (100_000_000 + F.col("l_orderkey")).alias("dst"), F.lit(1.0).alias("weight")).distinct()
    nodes = l.select(F.col("src").alias("id")).distinct().withColumn("type", F.lit("concept")).unionByName(l.select(F.col("dst").alias("id")).distinct().withColumn("type", F.lit("file")))
    return g.concept_clusters(nodes, l)


@query(
    """WITH t AS (SELECT vec_id AS id, len(embedding) AS n FROM embeddings) SELECT id, 64 AS dims FROM t WHERE n = 64 UNION ALL SELECT id, 64 FROM t JOIN documents ON doc_id = id WHERE n <> 64"""
)
def vector_migration(spark, sf_dir):
    """Vectors of another length are made again from their texts."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return r.migrate_vectors(v, d, 64).select("id", F.size("v").alias("dims"))


@query("SELECT vec_id AS id, label, count(*) OVER (PARTITION BY label) AS total, rank FROM (SELECT v.vec_id, v.label, row_number() OVER (PARTITION BY v.label ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) QUALIFY rank <= 50")
def vision_search(spark, sf_dir):
    """The images of each session most like a given one, with how many there are; the page is clamped to 50."""
    e = table(spark, sf_dir, "embeddings")
    asked = F.broadcast(e.where("vec_id = 0").limit(1).select(F.col("embedding").alias("q")))
    met = e.join(asked).select(F.col("vec_id").alias("id"), "label", F.round(s.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    totals = e.groupBy("label").agg(F.count("*").alias("total"))
    return s.top(met, ["label"], [F.desc("score"), F.asc("id")], r.clamp("vision", 80)).join(F.broadcast(totals), "label").select("id", "label", "total", "rank")
