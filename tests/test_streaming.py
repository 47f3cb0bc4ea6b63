"""Streams over files give what the batch operators give."""

import json

from pyspark.sql import functions as F

from palimpsest.operators import sequences as q
from palimpsest.streaming import ingest


def write(path, name, rows):
    (path / name).write_text("\n".join(json.dumps(r) for r in rows) + "\nno json\n")


def event(i, second, session=1, tool="Bash", text="ls"):
    return {"event_id": i, "ts": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z", "session_id": session, "hook": "post_tool_use", "tool": tool, "input": text}


def run(df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_exact_dedup_matches_the_batch_fold(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [event(1, 0), event(2, 60), event(3, 300), event(4, 301), event(5, 302, text="other")]
    write(src, "a.json", rows)
    out = run(ingest.dedup_exact(ingest.read_observations(spark, str(src))), "deduped")
    batch = spark.createDataFrame([(r["event_id"], r["ts"], r["input"]) for r in rows], "event_id long, ts string, input string").withColumn("ts", F.to_timestamp("ts"))
    want = {r.event_id for r in q.dedup_with_expiry(batch, ["input"], "ts", "event_id").collect()}
    assert {r.event_id for r in out.collect()} == want == {1, 4, 5}


def test_sessions_and_windows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src, "a.json", [event(i, i * 10, session=i % 2) for i in range(6)])
    events = ingest.read_observations(spark, str(src))
    assert sorted((r.session_id, r.observation_count) for r in run(ingest.sessions(events), "sessions", "complete").collect()) == [(0, 3), (1, 3)]
    assert sum(r.n for r in run(ingest.tumbling(events, "1 minute", "0 seconds"), "windows", "complete").collect()) == 6


def test_append_goes_on_where_it_stopped(spark, tmp_path):
    src, out, at = tmp_path / "in", tmp_path / "out", tmp_path / "at"
    src.mkdir()
    for part in ("a.json", "b.json"):
        write(src, part, [event(ord(part[0]), 5)])
        ingest.append_to(ingest.read_observations(spark, str(src)), str(out), str(at)).awaitTermination()
    assert spark.read.parquet(str(out)).count() == 2
    # the last batch was written, but the failure came before it was noted down: it is run again
    last = max((at / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    for f in (last, last.with_name(f".{last.name}.crc")):
        f.unlink(missing_ok=True)
    ingest.append_to(ingest.read_observations(spark, str(src)), str(out), str(at)).awaitTermination()
    assert spark.read.parquet(str(out)).count() == 2
