"""Structured Streaming: ingest of observations, dedup, sessions and event-time windows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as tx

OBSERVATION = "event_id long, ts timestamp, session_id long, hook string, tool string, input string"


def read_observations(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON files that arrive in a folder, redacted and typed; lines that are no such JSON are dropped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    e = lines.select(F.from_json("value", OBSERVATION).alias("e")).where("e.event_id is not null and e.ts is not null").select("e.*")
    return e.withColumns({"input": tx.redact(F.col("input")), "type": tx.infer_type(F.col("tool"), F.col("hook")), "hash": dedup_hash()})


def dedup_hash():
    """Session, tool and the first 500 characters of the input."""
    return F.sha2(F.concat_ws(":", F.col("session_id").cast("string"), "tool", F.substring("input", 1, 500)), 256)


def dedup(events: DataFrame, minutes: int = 5) -> DataFrame:
    """Spark's own dedup within the watermark: a repeat in the time after the first is dropped."""
    return events.withWatermark("ts", f"{minutes} minutes").dropDuplicatesWithinWatermark(["hash"])


def dedup_exact(events: DataFrame, seconds: int = 300) -> DataFrame:
    """A hash is passed over for `seconds` after its last accepted event, which repeats don't extend; exactly at the end it still is.

    The state of a hash is one time, and goes when it can't matter any more.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        kept = []
        for t, i in zip(rows["ts"], rows["event_id"]):
            at = t.value // 1000
            if last is None or at - last > seconds * 1_000_000:
                last = at
                kept.append((key[0], int(i), t))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(kept, columns=["hash", "event_id", "ts"])

    keyed = events.withWatermark("ts", f"{seconds} seconds").select("hash", "event_id", "ts").groupBy("hash")
    return keyed.applyInPandasWithState(step, "hash string, event_id long, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame) -> DataFrame:
    """Running state of each session, for the update or complete mode."""
    return events.groupBy("session_id").agg(F.count("*").alias("observation_count"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "type", "n")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("session_id", w.alias("w")).agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_to(events: DataFrame, path: str, checkpoint: str):
    """Append to a table dealt out by batch and day; restarts go on where they stopped.

    Each batch has a folder of its own, which a batch that is run again after a failure replaces: no row is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
