"""Readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table; filters and column choices made on it reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, if its scan has fewer: a small table in one file, whose texts take long to work on.

    A table with a split for every core is left as it is, so nothing large is ever shuffled for it.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


#: A line of an agent's transcript; lines that are no such JSON are dropped by read_transcripts().
TRANSCRIPT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("sessionId", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("cwd", T.StringType()),
        T.StructField("message", T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])),
    ]
)
_PART = "array<struct<type: string, text: string, name: string, input: string, tool_use_id: string, content: string, is_error: boolean>>"


def read_transcripts(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Events of JSONL transcripts: session_id, project, timestamp, hook, tool, text, one row per content part.

    User text is a submitted prompt, a tool's result its use or failure, assistant text a stop, a
    tool call the moment before its use. The project is the last part of the working directory, else
    `unknown`. Invalid lines are skipped.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).withColumn("file", F.input_file_name())
    if max_files is not None:
        first = lines.select("file").distinct().orderBy("file").limit(max_files)
        lines = lines.join(F.broadcast(first), "file", "left_semi")
    raw = lines.select("file", F.from_json("value", TRANSCRIPT).alias("e")).where("e.message is not null")
    content = F.col("e.message.content")
    parts = F.when(content.startswith("["), F.from_json(content, _PART)).otherwise(
        F.from_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))), _PART)
    )
    role = F.coalesce(F.col("e.message.role"), F.col("e.type"))
    kind = F.col("p.type")
    hook = (
        F.when((role == "user") & (kind == "text"), "prompt_submit")
        .when((kind == "tool_result") & F.col("p.is_error"), "post_tool_failure")
        .when(kind == "tool_result", "post_tool_use")
        .when((role == "assistant") & (kind == "text"), "stop")
        .when(kind == "tool_use", "pre_tool_use")
    )
    # the first session and directory that a file names hold for all of it
    w = Window.partitionBy("file")
    named = lambda c: F.min_by(c, "e.timestamp").over(w)
    sid = F.when(F.trim(F.col("e.sessionId")) != "", F.col("e.sessionId"))
    cwd = F.when(F.trim(F.col("e.cwd")) != "", F.col("e.cwd"))
    rows = raw.withColumns({"session_id": F.coalesce(sid, named(sid)), "cwd": F.coalesce(cwd, named(cwd))})
    rows = rows.select("session_id", "cwd", F.col("e.timestamp").alias("timestamp"), role.alias("role"), F.posexplode(parts).alias("part", "p"), "e")
    return rows.select(
        "session_id",
        F.coalesce(F.regexp_extract("cwd", r"([^/\\]+)[/\\]*$", 1), F.lit("")).alias("project"),
        "timestamp", "part", hook.alias("hook"), F.col("p.name").alias("tool"), F.coalesce("p.text", "p.content", "p.input").alias("text"),
    ).withColumn("project", F.when(F.col("project") == "", "unknown").otherwise(F.col("project"))).where("hook is not null")


def sessions_of(events: DataFrame) -> DataFrame:
    """One row per imported session: count, first and last time, first prompt of at most 200 characters."""
    prompt = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 200)
    said = (F.col("hook") == "prompt_submit") & (prompt != "")
    return events.groupBy("session_id", "project").agg(
        F.count("*").alias("observation_count"), F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"),
        F.min_by(F.when(said, prompt), F.when(said, F.col("timestamp"))).alias("first_prompt"), F.lit("completed").alias("status"), F.lit("jsonl-import").alias("tag"),
    )


def merge_import(existing: DataFrame, incoming: DataFrame, key: str, strategy: str = "merge") -> DataFrame:
    """merge: an incoming row replaces that of its id; skip: existing ones stay; replace: only incoming ones."""
    if strategy == "replace":
        return incoming
    if strategy == "skip":
        return existing.unionByName(incoming.join(existing, key, "left_anti"))
    if strategy == "merge":
        return existing.join(incoming, key, "left_anti").unionByName(incoming)
    raise ValueError(f"unknown strategy {strategy}")


def latest(log: DataFrame, key: str, order: Column, deleted: str | None = None) -> DataFrame:
    """The table that an append log of upserts amounts to: the last row of each key, if not a deletion."""
    w = Window.partitionBy(key).orderBy(order.desc())
    last = log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return last.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else last


def merged_sessions(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """Sessions after an import: counts add up, times widen, the first prompt that is known stays, as does the status."""
    both = existing.withColumn("_i", F.lit(0)).unionByName(imported.withColumn("_i", F.lit(1)), allowMissingColumns=True)
    kept = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_i"))).alias(c)
    return both.groupBy("session_id").agg(F.sum("observation_count").alias("observation_count"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), *map(kept, ("project", "first_prompt", "status")))


def export_page(sessions: DataFrame, tables: dict[str, DataFrame], key: str = "session", offset: int = 0, most: int | None = None) -> tuple[dict[str, DataFrame], bool]:
    """A page of sessions in order, the rows of the other tables that belong to them, and whether there are more."""
    ordered = sessions.orderBy(key).offset(offset)
    page = ordered if most is None else ordered.limit(most)
    ids = page.select(key)
    more = most is not None and not ordered.offset(most).isEmpty()
    return {"sessions": page} | {n: df.join(ids, key, "left_semi") for n, df in tables.items()}, more


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines in a folder of its name; one that is there is replaced."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def snapshot(df: DataFrame, path: str, version: int) -> None:
    """A version of a table as its own parquet directory."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """The versions there are, in order; by Spark's reader, so any file system will do."""
    return sorted(r[0] for r in spark.read.parquet(path).select("version").distinct().collect())


def restored(spark: SparkSession, path: str, version: int) -> DataFrame:
    """A table as it was in a version."""
    return spark.read.parquet(f"{path}/version={version}")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two versions has, with change = added or removed."""
    return after.exceptAll(before).withColumn("change", F.lit("added")).unionByName(before.exceptAll(after).withColumn("change", F.lit("removed")))


def write_markdown(notes: DataFrame, path: str, title: str = "title", body: str = "content") -> None:
    """Each note as Markdown text, dealt out by its first letter."""
    text = F.concat_ws("\n", F.concat(F.lit("# "), F.col(title)), F.lit(""), F.col(body), F.lit(""))
    notes.select(F.lower(F.substring(title, 1, 1)).alias("letter"), text.alias("value")).write.mode("overwrite").partitionBy("letter").text(path)
