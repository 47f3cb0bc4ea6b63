"""Keyword, vector and fused search over batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .sequences import fold_in_order

K1, B = 1.2, 0.75
PREFIX, SYNONYM = 0.5, 0.7
RRF_K, WEIGHTS = 60, {"bm25": 0.4, "vector": 0.6, "graph": 0.3}
#: A query side of at most so many rows is sent to all executors; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if a bounded count finds it small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tasks_of(spark: SparkSession) -> int:
    """So many tasks an index is dealt out to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def parts(spark: SparkSession, n: int) -> list[int]:
    """n numbers, one for each of n partitions that they are dealt out to by hash."""
    found = spark.range(64 * n).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k"))
    return sorted(r["k"] for r in found.collect())


def terms_of(docs: DataFrame, id_col: str, text: Column, stems: bool = False) -> DataFrame:
    """(part, id, pos, term, dl) of every token, dl being the text's number of tokens; with stems the tokens' stems, but for empty ones.

    All of a document is in one part, and all of a part in one task.
    """
    # dealt out by document while it's still text, so that counting its terms needs no further shuffle; to a stated number of
    # tasks, since a few megabytes of text, which would be drawn together to one task, are work for many
    spark = docs.sparkSession
    tasks = tasks_of(spark)
    tokens = tx.tokenize(text)
    if stems:
        # before texts are dealt out, as Spark doesn't know after a step in Python how rows lie
        docs, tokens = docs.select(id_col, tx.stemmed_text(tokens).alias("stems")), F.split("stems", " ")
    keys = parts(spark, tasks)
    part = F.get(F.array(*map(F.lit, keys)), F.pmod(F.xxhash64(id_col), F.lit(len(keys))).cast("int"))
    listed = docs.withColumn("part", part).repartition(tasks, "part").select("part", F.col(id_col).alias("id"), tokens.alias("tokens"))
    # the length goes before the tokens are spread out, else each takes the whole array along; an inner explode would
    # bring a filter of its own, for which texts are cut into tokens once more
    found = listed.select("part", "id", "tokens", F.size("tokens").cast("long").alias("dl")).select("part", "id", "dl", F.posexplode_outer("tokens").alias("pos", "term"))
    return found.where(F.length("term") > 0)


def postings(terms: DataFrame) -> DataFrame:
    """(part, id, dl, term, tf) of terms_of(); the length comes with the tokens, so that scoring needs no further join."""
    return terms.groupBy("part", "id", "dl", "term").agg(F.count("*").alias("tf"))


def write_index(index: DataFrame, path: str, files: int) -> None:
    """Postings in order of terms, so that a later search reads only the files its terms fall into; an index that is there is replaced."""
    index.repartitionByRange(files, "term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """A written index; with terms, those that are one of them or begin with one, by ranges that reach the scan."""
    index = spark.read.parquet(path)
    if terms is None:
        return index
    wanted = F.lit(False)
    for t in terms:
        wanted = wanted | begins_with("term", t)
    return index.where(wanted)


def begins_with(column: str, prefix: str) -> Column:
    """Values that begin with a prefix, as a range, of which file statistics know whether a file holds any."""
    return (F.col(column) >= prefix) & (F.col(column) < prefix + "\U0010ffff")


_held: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """df, kept where it is made until release() or for the queries of one request: what several steps of a plan read is made once."""
    _held.append(df.persist())
    return df


def release() -> None:
    """Let go of all that held() keeps; a plan that still reads it makes it again."""
    while _held:
        _held.pop().unpersist()


def weighted_terms(queries: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(query_id, term, weight) from (id, pos, term): each term at the weight of its first mention, itself or as a synonym."""
    own = queries.select(F.col("id").alias("query_id"), "pos", F.lit(-1).alias("at"), "term", F.lit(1.0).alias("weight"))
    if synonyms is not None:
        more = own.join(F.broadcast(synonyms), own.term == synonyms.of).select("query_id", "pos", synonyms["at"], F.col("synonym").alias("term"), F.lit(SYNONYM).alias("weight"))
        own = own.unionByName(more)
    return own.groupBy("query_id", "term").agg(F.min_by("weight", F.struct("pos", "at")).alias("weight"))


def bm25(index: DataFrame, queries: DataFrame, k: int | None = 10, prefixes: bool = True) -> DataFrame:
    """The k best documents of each query (all that score with k None): query_id, id, score, rank.

    index from postings(), queries from weighted_terms(). A term counts in full where it is found, half
    where it begins a longer term: an equality join on as much of the vocabulary's terms as a query term is long. What a
    document gains by a term that is asked for is worked out once, however many queries ask for it.
    What is asked for, and in how many documents it is, goes to the parts that hold it, so that postings are never
    shuffled. Scores are rounded to six places and ties go to the smaller id.
    """
    # an index dealt out by part meets its terms by part and term as it lies
    spark = index.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # a document's tf / dl add to 1, so documents are counted without gathering distinct ids
    stats = index.agg(F.sum("tf").alias("total"), F.round(F.sum(F.col("tf") / F.col("dl"))).alias("n")).select("n", (F.col("total") / F.col("n")).alias("avgdl"))
    vocabulary = index.groupBy("part", "term").agg(F.count("*").alias("df")).groupBy("term").agg(F.sum("df").alias("df"), F.collect_list("part").alias("parts"))
    said = queries.select(F.col("term").alias("said")).distinct()
    begin = F.col("term")
    if prefixes:
        # as many rows as there are lengths of terms asked for
        lengths = sorted(r[0] for r in said.select(F.length("said")).distinct().collect())
        cuts = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("term"))
        vocabulary, begin = vocabulary.select("term", "df", "parts", F.explode(cuts).alias("n")), F.substring(F.col("term"), F.lit(1), F.col("n"))
    reached = vocabulary.withColumn("begin", begin).join(small(said), F.col("said") == F.col("begin")).groupBy("term").agg(F.collect_list("said").alias("said"), F.first("df").alias("df"), F.first("parts").alias("parts"))
    reached = reached.select(F.explode("parts").alias("part"), "term", "df", "said").repartition(tasks_of(spark), "part").hint("shuffle_hash")
    base = F.when(F.col("said") == F.col("term"), 1.0).otherwise(PREFIX)
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    met = index.join(reached, ["part", "term"]).join(F.broadcast(stats)).select("part", "id", "term", (idf * norm).alias("gain"), F.explode("said").alias("said"))
    gains = met.groupBy("part", "id", "said").agg(F.sum(base * F.col("gain")).alias("gain"))
    asked = queries.select("query_id", F.col("term").alias("said"), "weight")
    # an index dealt out by part stays so through the joins: nothing is shuffled but the best
    scored = gains.join(small(asked), "said").groupBy("part", "query_id", "id").agg(F.round(F.sum(F.col("weight") * F.col("gain")), 6).alias("score"))
    return top(scored.select("query_id", "id", "score"), ["query_id"], [F.desc("score"), F.asc("id")], k)


def top(df: DataFrame, by: list[str], order: list[Column], k: int | None, name: str = "rank") -> DataFrame:
    """The first k rows of each group; the limit is taken before the shuffle too. All are ranked with k None."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return ranked if k is None else ranked.where(F.col(name) <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths and for zero vectors."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def vector_top(vectors: DataFrame, queries: DataFrame, k: int = 10, blocks: int = 64) -> DataFrame:
    """The k most similar of vectors(id, v) for each of a stated set of queries(query_id, q), its own id apart.

    Vectors are dealt out to blocks and each query is held against every block: an equality join on the
    block, so that no side has to fit on one machine. Norms are worked out once a row.
    """
    dealt = vectors.select("id", F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).withColumn("nv", F.sqrt(dot(F.col("v"), F.col("v"))))
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).withColumn("nq", F.sqrt(dot(F.col("q"), F.col("q"))))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    size = F.col("nv") * F.col("nq")
    score = F.when((F.size("v") != F.size("q")) | (size == 0), 0.0).otherwise(dot(F.col("v"), F.col("q")) / F.nullif(size, F.lit(0.0)))
    met = dealt.join(small(asked, BROADCAST_ROWS), "block").where(F.col("id") != F.col("query_id")).select("query_id", "id", F.round(score, 6).alias("score"))
    return top(met, ["query_id"], [F.desc("score"), F.asc("id")], k)


def rrf(streams: dict[str, DataFrame], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Weighted reciprocal-rank fusion of streams(query_id, id, rank, score): query_id, id, score.

    A stream without results for a query loses its weight there, but the keyword stream keeps its; weights
    then add to 1. A repeated id counts at its best rank.
    """
    rows = None
    for name, df in streams.items():
        one = df.select("query_id", "id", "rank", F.lit(name).alias("stream"))
        rows = one if rows is None else rows.unionByName(one)
    each = rows.groupBy("query_id", "id").agg(*(F.min(F.when(F.col("stream") == s, F.col("rank"))).alias(s) for s in streams))
    w = Window.partitionBy("query_id")
    weight = {s: F.lit(weights[s]) if s == "bm25" else F.when(F.max(F.col(s).isNotNull()).over(w), weights[s]).otherwise(0.0) for s in streams}
    total = sum(weight.values())
    parts = sum(weight[s] * F.coalesce(1.0 / (RRF_K + F.col(s)), F.lit(0.0)) for s in streams)
    return each.withColumn("score", F.round(parts / total, 9)).select("query_id", "id", "score")


def diversified(ranked: DataFrame, group: str, k: int, cap: int = 3) -> DataFrame:
    """At most `cap` rows of a group first, then the rest in order of score, up to k a query."""
    nth = F.row_number().over(Window.partitionBy("query_id", group).orderBy(F.desc("score"), "id"))
    return top(ranked.withColumn("over", nth > cap), ["query_id"], [F.asc("over"), F.desc("score"), F.asc("id")], k).drop("over")


def prefix_budget(blocks: DataFrame, by: list[str], order: list[Column], tokens: str, budget: int) -> DataFrame:
    """Rows in order until the first that does not fit."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def skip_budget(blocks: DataFrame, by: list[str], order: str, id_col: str, tokens: str, budget: int) -> DataFrame:
    """Ids in order that fit what is left, passing over those that don't: (by, id, used)."""

    def step(used, row):
        total = (used or 0) + row[1]
        return (used, None) if total > budget else (total, (row[0], total))

    rows = blocks.select(*by, F.col(order).alias("_o"), F.col(id_col).cast("long").alias("id"), F.col(tokens).cast("long").alias("_t"))
    return fold_in_order(rows, by, ["_o", "id"], ["id", "_t"], step, "id long, used long")
