"""A real stream's heartbeat, observed counts and shutdown."""

import time

import pytest
from pyspark.sql import functions as F

from crawlgrain.streaming import monitor


@pytest.fixture
def log(spark, tmp_path):
    made = monitor.ProgressLog(f"file://{tmp_path}/log")
    spark.streams.addListener(made)
    yield made, f"file://{tmp_path}/log"
    spark.streams.removeListener(made)


def wait(condition, seconds=25):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.2)
    assert condition()


def test_progress_heartbeat_and_a_stop_between_batches(spark, tmp_path, log):
    listener, path = log
    done = []

    def slow(batch, number):
        n = batch.count()
        time.sleep(1.5)
        done.append((number, n))

    spark.range(0, 10).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    seen = rows.observe("commands", *monitor.counts(read=F.lit(True), invalid=F.col("id") % 4 == 0))
    q = seen.writeStream.queryName("worker-1").foreachBatch(slow).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    assert monitor.alive(q) and not monitor.readiness(q)["ready"]
    wait(lambda: done)
    wait(lambda: q.lastProgress is not None)
    found = monitor.readiness(q)
    assert found["ready"] and found["initialized"] and 0 <= found["heartbeat_age_seconds"] < 30
    assert not monitor.readiness(q, now_ms=int(time.time() * 1000) + 60_000)["ready"]
    spark.range(10, 14).write.mode("append").parquet(str(tmp_path / "in"))
    wait(lambda: q.status["isTriggerActive"] and q.status["isDataAvailable"])
    assert monitor.stop_gracefully(q, listener)
    assert sum(n for _, n in done) == 14 and not monitor.alive(q)  # the batch that ran has ended
    wait(lambda: any(r["event"] == "ended" for r in monitor.events(spark, path).collect()))
    events = monitor.events(spark, path)
    assert {r["name"]: r["value"] for r in monitor.observed(events).where("query = 'worker-1'").collect()} == {"read": 14, "invalid": 4}
    beat = monitor.heartbeats(events, int(time.time() * 1000)).where("query = 'worker-1'").first()
    assert beat["age"] < 60 and beat["ready"] is False  # it has ended
    running = monitor.heartbeats(events.where("event in ('started', 'progress')"), beat["last_ms"] + 5000).where("query = 'worker-1'").first()
    assert running["ready"] is True
    assert {r["result"]: r["value"] for r in monitor.shutdown_events(events).collect()} == {"started": 1, "drained": 1}


def test_a_batch_that_takes_too_long_is_cut_off_and_a_failure_is_seen(spark, tmp_path, log):
    listener, path = log
    spark.range(3).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    began = []
    q = rows.writeStream.queryName("stuck").foreachBatch(lambda b, n: (began.append(n), time.sleep(6))).option("checkpointLocation", str(tmp_path / "s1")).start()
    wait(lambda: began)
    assert monitor.stop_gracefully(q, listener, most_seconds=0.5) is False

    def broken(batch, number):
        raise RuntimeError("no broker")

    q = rows.writeStream.queryName("broken").foreachBatch(broken).option("checkpointLocation", str(tmp_path / "s2")).start()
    with pytest.raises(Exception, match="no broker"):
        q.awaitTermination()
    assert not monitor.alive(q) and not monitor.readiness(q)["ready"]
    wait(lambda: any(r["event"] == "failed" for r in monitor.events(spark, path).collect()))
    events = monitor.events(spark, path)
    assert {r["result"] for r in monitor.shutdown_events(events).collect()} == {"started", "timeout"}
    assert "no broker" in events.where("event = 'failed'").first()["error"]
    assert monitor.events(spark, path + "/none").count() == 0
