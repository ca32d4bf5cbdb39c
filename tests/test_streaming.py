"""Streams that run, fail and start again."""

import json

import pytest
from pyspark.sql import functions as F

from crawlgrain.operators import pacing
from crawlgrain.streaming import commands as stream

T0 = 1_704_067_200_000


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def command(k, **more):
    url = f"http://h{k % 3}.example/{k}"
    return {"url": url, "canonical_url": url, "job_id": "j", "command_id": str(k)} | more


def run(rows, state, sink):
    q = rows.writeStream.foreachBatch(sink).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_nothing_is_acknowledged_before_it_is_published(spark, tmp_path):
    """A failing publish leaves the batch unacknowledged; the next start does it all, invalid commands aside."""
    put(tmp_path / "in", "a.json", [command(k) for k in range(6)] + [command(6, job_id=" "), command(7, max_retries="x")])
    done = {"objects": [], "facts": [], "acks": [], "invalid": []}

    def into(name):
        return lambda b: done[name].extend(r["command_id"] for r in b.select("command_id").collect())

    def broken(b):
        raise RuntimeError("broker away")

    def loop(publish, paused=False):
        return stream.command_loop(stream.ordered_sink(into("objects"), publish, into("acks")), into("invalid"), lambda: paused)

    source = str(tmp_path / "in")
    with pytest.raises(Exception, match="reading is paused"):
        run(stream.command_stream(spark, source), tmp_path / "state", loop(into("facts"), paused=True))
    assert not any(done.values())
    with pytest.raises(Exception, match="broker away"):
        run(stream.command_stream(spark, source), tmp_path / "state", loop(broken))
    assert len(done["objects"]) == 6 and not done["facts"] and not done["acks"]
    run(stream.command_stream(spark, source), tmp_path / "state", loop(into("facts")))
    assert sorted(done["facts"]) == sorted(done["acks"]) == [str(k) for k in range(6)]
    assert set(done["invalid"]) == {"6", "7"}
    put(tmp_path / "in", "b.json", [command(8)])
    run(stream.command_stream(spark, source), tmp_path / "state", loop(into("facts")))
    assert done["acks"].count("8") == 1 and len(done["acks"]) == 7


def pour(rows, state, out):
    rows.writeStream.format("parquet").option("checkpointLocation", str(state)).option("path", str(out)).trigger(availableNow=True).start().awaitTermination()


def test_pacing_state_outlives_a_restart(spark, tmp_path):
    """Two runs of a stream give the schedule that one pass over all requests gives."""
    who = ["10.0.0.2", "10.0.0.3"]
    halves = [[{"event_id": k, "host": f"h{k % 2}", "arrive_ms": T0 + 10 * k} for k in range(lo, lo + 10)] for lo in (0, 10)]
    schema = "event_id long, host string, arrive_ms long"
    for number, half in enumerate(halves):
        put(tmp_path / "in", f"{number}.json", half)
        pour(stream.paced_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), who, 100), tmp_path / "state", tmp_path / "out")
    found = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("event_id", "host", "identity", "start_ms").collect()}
    whole = pacing.pace(spark.createDataFrame(halves[0] + halves[1], schema), who, 100)
    assert found == {tuple(r) for r in whole.select("event_id", "host", "identity", "start_ms").collect()}
    assert len(found) == 20


def test_delayed_commands_wait_for_their_time(spark, tmp_path):
    """A command leaves once the stream's time has reached it, and stays in state across a restart until then."""
    schema = "event_id long, host string, eligible_ms long, at_ms long"

    def feed(name, rows):
        put(tmp_path / "in", name, [dict(zip(("event_id", "host", "eligible_ms", "at_ms"), r, strict=True)) for r in rows])
        rows_in = spark.readStream.schema(schema).json(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis(F.col("at_ms") + T0))
        rows_in = rows_in.withColumn("eligible_ms", F.col("eligible_ms") + T0)
        pour(stream.delayed_stream(rows_in, "ts"), tmp_path / "state", tmp_path / "out")
        return sorted(r["event_id"] for r in spark.read.schema("event_id long").parquet(str(tmp_path / "out")).collect())

    assert feed("a.json", [(1, "x", 5_000, 1_000), (2, "x", 90_000, 1_000), (3, "y", 1_000, 10_000)]) == [1, 3]
    assert feed("b.json", [(4, "z", 200_000, 95_000), (5, "z", 0, 500)]) == [1, 2, 3, 5]
    assert feed("c.json", [(6, "x", 300, 200)]) == [1, 2, 3, 5, 6]


def test_dedupe_keeps_one_row_a_key(spark, tmp_path):
    put(tmp_path / "in", "a.json", [{"k": k % 4, "ts": f"2024-01-01T00:00:{k:02d}Z"} for k in range(20)])
    rows = spark.readStream.schema("k long, ts timestamp").json(str(tmp_path / "in"))
    assert sorted(r["k"] for r in stream.drain(stream.dedupe(rows, "k", "ts", "1 hour")).collect()) == [0, 1, 2, 3]


def test_a_table_is_a_stream_whether_a_file_or_a_folder(spark, tmp_path):
    rows = spark.range(40).withColumn("t", F.lit("x"))
    rows.repartition(4).write.parquet(str(tmp_path / "folder" / "pages.parquet"))
    rows.limit(3).write.parquet(str(tmp_path / "folder" / "events.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "file" / "pages.parquet")
    for kind in ("folder", "file"):
        out = stream.drain(stream.table_stream(spark, str(tmp_path / kind), "pages"))
        assert sorted(r["id"] for r in out.collect()) == list(range(40))
