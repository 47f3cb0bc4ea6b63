"""Registered queries: keyword, vector and fused search, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import search as s
from ..operators import similarity as sim
from ..session import ship
from ..sources.tables import spread, table
from .registry import query

# ---- keyword search

_TERMS = rf"""
WITH doc_terms AS (
  SELECT doc_id AS id, t AS term FROM (
    SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '{tx.NOT_TOKEN_RE2}', ' ', 'g'), '\s+')) AS t FROM documents)
  WHERE length(t) >= 2),
q_terms AS (
  SELECT DISTINCT item_id AS query_id, t AS term FROM (
    SELECT item_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '{tx.NOT_TOKEN_RE2}', ' ', 'g'), '\s+')) AS t FROM benchmark)
  WHERE length(t) >= 2),
p AS (SELECT id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
d AS (SELECT id, sum(tf) AS dl FROM p GROUP BY id),
st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM d),
v AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""
_SCORED = """,
r AS (SELECT query_id, term, any_value(df) AS df, sum(w) AS w FROM (
    SELECT q.query_id, v.term, v.df, 1.0::DOUBLE AS w FROM q_terms q JOIN v ON v.term = q.term {prefix})
  GROUP BY query_id, term),
scored AS (
  SELECT r.query_id, p.id, round(sum(r.w * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM r JOIN p ON p.term = r.term JOIN d ON d.id = p.id CROSS JOIN st GROUP BY r.query_id, p.id),
bm25 AS (SELECT query_id, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= {k})"""
_PREFIX = "UNION ALL SELECT q.query_id, b.term, b.df, 0.5 FROM q_terms q JOIN (SELECT term, df, substr(term, 1, unnest(range(1, length(term)))) AS b FROM v) b ON b.b = q.term"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _bm25(spark: SparkSession, sf_dir: str, k: int, prefixes: bool = True, stems: bool = False) -> DataFrame:
    synonyms = None
    if stems:
        ship(spark)
        synonyms = spark.createDataFrame(tx.synonym_rows(), "of string, synonym string, at int")
    index = s.postings(s.terms_of(_texts(spark, sf_dir) if stems else table(spark, sf_dir, "documents"), "doc_id", F.col("text"), stems))
    # statistics, vocabulary and scoring all read the postings, and several steps the queries: they are kept where they are made, till the next search (write_index lasts)
    s.release()
    asked = s.held(s.weighted_terms(s.terms_of(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"), stems), synonyms))
    return s.bm25(s.held(index), asked, k, prefixes).select("query_id", "id", "score", "rank")


@query(_TERMS + _SCORED.format(prefix="", k=10) + " SELECT * FROM bm25")
def bm25_exact(spark, sf_dir):
    return _bm25(spark, sf_dir, 10, prefixes=False)


@query(_TERMS + _SCORED.format(prefix=_PREFIX, k=10) + " SELECT * FROM bm25")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 10)


@query(None)
def bm25_stemmed(spark, sf_dir):
    """With stems and synonyms; the stemmer is held against golden words in the tests."""
    return _bm25(spark, sf_dir, 10, stems=True)


@query(_TERMS + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM p GROUP BY term")
def term_statistics(spark, sf_dir):
    index = s.postings(s.terms_of(table(spark, sf_dir, "documents"), "doc_id", F.col("text")))
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


# ---- vectors: the stated queries are the ids that 50 divides

_VECTORS = """
WITH vec AS (SELECT query_id, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS id, {group} round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)) WHERE rank <= {k})"""


def _vectors(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return s.vector_top(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), asked, k).select("query_id", "id", "score", "rank")


@query(_VECTORS.format(k=10, group="") + " SELECT * FROM vec")
def vector_topk(spark, sf_dir):
    return _vectors(spark, sf_dir, 10)


@query(
    "SELECT query_id, label, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS rank FROM ("
    "SELECT q.vec_id AS query_id, v.label, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score "
    "FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id AND q.label = v.label WHERE q.vec_id % 50 = 0)) WHERE rank <= 3"
)
def vector_topk_per_group(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    met = e.join(s.small(asked), "label").where("vec_id <> query_id").select("query_id", "label", F.col("vec_id").alias("id"), F.round(s.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    return s.top(met, ["query_id", "label"], [F.desc("score"), F.asc("id")], 3)


@query("SELECT len(embedding) AS dims, count(*) AS vectors, count_if(len(embedding) <> 64) AS wrong FROM embeddings GROUP BY 1")
def vector_dimensions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.size("embedding").cast("long").alias("dims"))
    return e.groupBy("dims").agg(F.count("*").alias("vectors"), F.count_if(F.col("dims") != 64).alias("wrong"))


# ---- fusion: query i of the benchmark asks with the vector of the same number

_FUSED = (
    _TERMS + _SCORED.format(prefix=_PREFIX, k=20) + """,
vq AS (SELECT item_id AS query_id, embedding AS q, vec_id FROM benchmark JOIN embeddings ON vec_id = item_id),
vec AS (SELECT query_id, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT q.query_id, v.vec_id AS id, round(list_cosine_similarity(q.q::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
    FROM vq q JOIN embeddings v ON q.vec_id <> v.vec_id)) WHERE rank <= 20),
u AS (SELECT query_id, id, min(CASE WHEN s = 'b' THEN rank END) AS b, min(CASE WHEN s = 'v' THEN rank END) AS v FROM (
  SELECT query_id, id, rank, 'b' AS s FROM bm25 UNION ALL SELECT query_id, id, rank, 'v' FROM vec) GROUP BY query_id, id),
w AS (SELECT *, CASE WHEN max(v IS NOT NULL) OVER (PARTITION BY query_id) THEN 0.6::DOUBLE ELSE 0.0 END AS wv FROM u),
fused AS (SELECT query_id, id, round((0.4::DOUBLE * coalesce(1.0::DOUBLE / (60 + b), 0) + wv * coalesce(1.0::DOUBLE / (60 + v), 0)) / (0.4::DOUBLE + wv), 9) AS score FROM w)"""
)


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = table(spark, sf_dir, "benchmark").join(e, F.col("item_id") == F.col("id")).select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))
    return s.rrf({"bm25": _bm25(spark, sf_dir, 20), "vector": s.vector_top(e, asked, 20)})


@query(_FUSED + " SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 10")
def hybrid_rrf(spark, sf_dir):
    return s.top(_fused(spark, sf_dir), ["query_id"], [F.desc("score"), F.asc("id")], 10)


@query(
    _FUSED + """, g AS (SELECT *, id % 5 AS session, row_number() OVER (PARTITION BY query_id, id % 5 ORDER BY score DESC, id) > 3 AS over FROM fused)
SELECT query_id, id, session, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over, score DESC, id) AS rank FROM g) WHERE rank <= 12"""
)
def diversified_topk(spark, sf_dir):
    return s.diversified(_fused(spark, sf_dir).withColumn("session", F.col("id") % 5), "session", 12)


@query(
    _TERMS + _SCORED.format(prefix=_PREFIX, k=20) + """, m AS (SELECT query_id // 2 AS request, id, max(score) AS score FROM bm25 GROUP BY ALL)
SELECT request, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, id) AS rank FROM m) WHERE rank <= 10"""
)
def expanded_search(spark, sf_dir):
    """Two wordings of a request; each document keeps its better score."""
    found = _bm25(spark, sf_dir, 20).withColumn("request", F.floor(F.col("query_id") / 2))
    return s.top(found.groupBy("request", "id").agg(F.max("score").alias("score")), ["request"], [F.desc("score"), F.asc("id")], 10)


# ---- text functions

_SQL_STRINGS = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query(
    rf"""SELECT item_id, e.entity FROM (SELECT item_id, unnest(list_distinct(list_concat(regexp_extract_all(text, '{tx.QUOTED}', 1),
list_filter(regexp_extract_all(text, '{tx.CAPITALISED}', 1), lambda w: NOT list_contains([{_SQL_STRINGS(tx.NO_ENTITIES)}], w))))) AS entity FROM benchmark) e"""
)
def entity_extract(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(tx.entities(F.col("text"))).alias("entity"))


def _redact_sql(col: str) -> str:
    out = f"regexp_replace({col}, '{tx.PRIVATE}', '[REDACTED]', 'g')"
    for p in tx.SECRETS:
        out = f"regexp_replace({out}, '{p.replace(chr(39), chr(39) * 2)}', '[REDACTED_SECRET]', 'g')"
    return out


@query(f"SELECT doc_id, r AS redacted FROM (SELECT doc_id, text, {_redact_sql('text')} AS r FROM documents) WHERE r <> text")
def privacy_redact(spark, sf_dir):
    docs = _texts(spark, sf_dir).select("doc_id", "text", tx.redact(F.col("text")).alias("redacted"))
    return docs.where("redacted <> text").select("doc_id", "redacted")


@query("SELECT doc_id, 'doc_' || substr(sha256(text), 1, 16) AS fingerprint, ceil(length(text) / 3.0)::BIGINT AS tokens FROM documents")
def fingerprint_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.fingerprint_id("doc", F.col("text")).alias("fingerprint"), tx.token_estimate(F.col("text")).cast("long").alias("tokens"))


_SETS = r"""WITH t AS (SELECT doc_id, {more} list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: length(w) > 2))) AS w FROM documents),
c AS (SELECT w, min(doc_id) AS k FROM t GROUP BY w),
p AS (SELECT a, b, j FROM (SELECT x.k AS a, y.k AS b, len(list_intersect(x.w, y.w)) AS i, len(x.w) + len(y.w) AS n, i::DOUBLE / (n - i) AS j FROM c x JOIN c y ON x.k < y.k AND len(x.w) > 0 AND len(y.w) > 0
  AND least(len(x.w), len(y.w)) > 0.7 * greatest(len(x.w), len(y.w))) WHERE j > 0.7)"""


@query(_SETS.format(more="") + " SELECT a, b, round(j, 6) AS j FROM p UNION ALL SELECT k, doc_id, 1.0 FROM t JOIN c ON t.w = c.w WHERE doc_id <> k")
def jaccard_near_dups(spark, sf_dir):
    """All pairs of different word sets over 0.7, each set by the first document that has it, and the copies of each."""
    words = _texts(spark, sf_dir).select("doc_id", tx.jaccard_tokens(F.lower("text")).alias("w"))
    return sim.near_copies(words, "doc_id", "w", 0.7).select("a", "b", F.round("j", 6).alias("j"))


_TOOLS = ["WebFetch", "Grep", "Bash", "MultiEdit", "write_file", "view-image", "TaskList", "Notebook", "runner", "HTTPGet"]
_HOOKS = ["post_tool_use", "post_tool_failure", "prompt_submit", "task_completed", "notification"]


def _infer_sql() -> str:
    snake = r"lower(regexp_replace(regexp_replace(tool, '([a-z])([A-Z])', '\1_\2', 'g'), '[-\s]+', '_', 'g'))"
    tools = " ".join(f"WHEN regexp_matches({snake}, '^({w})|({w})$|_({w})_') THEN '{t}'" for t, ws in tx.TOOL_WORDS for w in [ws.replace(" ", "|")])
    hooks = " ".join(f"WHEN hook = '{h}' THEN '{t}'" for h, t in tx.HOOK_TYPES.items())
    return f"CASE {hooks} {tools} ELSE 'other' END"


@query(
    f"""SELECT event_id, tool, hook, {_infer_sql()} AS type FROM (
SELECT event_id, [{_SQL_STRINGS(_TOOLS)}][1 + event_id % {len(_TOOLS)}] AS tool, [{_SQL_STRINGS(_HOOKS)}][1 + user_id % {len(_HOOKS)}] AS hook FROM events)"""
)
def obs_type_infer(spark, sf_dir):
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (1 + F.col(c) % len(xs)).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", pick(_TOOLS, "event_id").alias("tool"), pick(_HOOKS, "user_id").alias("hook"))
    return e.withColumn("type", tx.infer_type(F.col("tool"), F.col("hook")))


@query(
    """SELECT event_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 79) || '…' ELSE t END AS title,
CASE WHEN length(n) > 400 THEN substr(n, 1, 399) || '…' ELSE n END AS narrative, 5 AS importance, 0.3::DOUBLE AS confidence
FROM (SELECT event_id, event_type || ' by user ' || user_id AS t, concat_ws(' | ', event_type, props, (props::JSON ->> 'k')) AS n FROM events)"""
)
def synthetic_compress(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    title = F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string"))
    narrative = F.concat_ws(" | ", "event_type", "props", F.get_json_object("props", "$.k"))
    return e.select("event_id", tx.truncated(title, 80).alias("title"), tx.truncated(narrative, 400).alias("narrative"), F.lit(5).alias("importance"), F.lit(0.3).alias("confidence"))


# ---- budgets


@query(
    """SELECT session, doc_id, tokens, used FROM (SELECT doc_id % 20 AS session, doc_id, ceil(length(text) / 3.0)::BIGINT AS tokens,
sum(ceil(length(text) / 3.0)::BIGINT) OVER (PARTITION BY doc_id % 20 ORDER BY doc_id)::BIGINT AS used FROM documents) WHERE used <= 2000"""
)
def budget_prefix(spark, sf_dir):
    blocks = table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("session"), "doc_id", tx.token_estimate(F.col("text")).cast("long").alias("tokens"))
    return s.prefix_budget(blocks, ["session"], [F.asc("doc_id")], "tokens", 2000)


@query(
    """WITH RECURSIVE b AS (SELECT doc_id % 20 AS session, doc_id, ceil(length(text) / 3.0)::BIGINT AS t, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS n FROM documents),
r AS (SELECT session, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS id FROM b GROUP BY session
UNION ALL SELECT r.session, b.n, CASE WHEN r.used + b.t <= 2000 THEN r.used + b.t ELSE r.used END, CASE WHEN r.used + b.t <= 2000 THEN b.doc_id END
FROM r JOIN b ON b.session = r.session AND b.n = r.n + 1) SELECT session, id, used FROM r WHERE id IS NOT NULL"""
)
def budget_skip(spark, sf_dir):
    blocks = table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("session"), "doc_id", tx.token_estimate(F.col("text")).alias("tokens"))
    return s.skip_budget(blocks, ["session"], "doc_id", "doc_id", "tokens", 2000)
