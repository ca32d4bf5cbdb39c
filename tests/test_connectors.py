"""The command queue and the fact log: restarts, redelivery, reads that are held back, facts that aren't doubled."""

import pytest
from pyspark.sql import functions as F

from crawlgrain.operators import policy
from crawlgrain.sources import connectors


def commands(spark, start, n):
    url = F.concat(F.lit("http://h.example/"), F.col("id"))
    return spark.range(start, start + n, 1, 2).select(url.alias("url"), url.alias("canonical_url"), F.lit("j").alias("job_id"), F.col("id").cast("string").alias("command_id"))


@pytest.fixture
def place(spark, tmp_path):
    connectors.register(spark)
    return f"file://{tmp_path}/queue", f"file://{tmp_path}/log", str(tmp_path)


def enqueue(spark, queue, start, n):
    commands(spark, start, n).write.format("command_queue").mode("append").save(queue)


def queue_stream(spark, queue, **options):
    return spark.readStream.format("command_queue").options(group="w", minIdleMs=0, **options).load(queue)


def run(df, state, log, queue, **options):
    q = df.writeStream.format("fact_log").option("checkpointLocation", state).option("path", log).options(queue=queue, group="w", **options).trigger(availableNow=True).start()
    q.awaitTermination()


def as_facts(rows):
    return rows.select(F.concat(F.lit("a"), "command_id").alias("attempt_id"), F.concat_ws(":", "command_id", "deliveries", "reclaimed").alias("value"), "message_id")


def test_pending_commands_come_first_after_a_restart(spark, place):
    queue, log, tmp = place
    enqueue(spark, queue, 0, 10)
    stream = queue_stream(spark, queue, readCount=6)
    run(as_facts(stream.where("message_id % 3 <> 0")), tmp + "/state", log, queue)  # 0 and 3 are retried: no fact, no acknowledgement
    assert connectors.outstanding(queue, "w") == 2
    enqueue(spark, queue, 10, 5)
    seen = []
    stream = queue_stream(spark, queue, readCount=6)
    run(as_facts(stream), tmp + "/state", log, queue)
    got = spark.read.format("fact_log").load(log).collect()
    by = {r["message_id"]: r["value"].split(":")[1:] for r in got}
    assert by == {1: ["1", "false"], 2: ["1", "false"], 4: ["1", "false"], 5: ["1", "false"], 0: ["2", "true"], 3: ["2", "true"], **{m: ["1", "false"] for m in (6, 7, 8, 9)}}
    while connectors.outstanding(queue, "w") or len(seen) < 15:
        run(as_facts(queue_stream(spark, queue, readCount=6)), tmp + "/state", log, queue)
        seen = spark.read.format("fact_log").load(log).collect()
    assert sorted(int(r["message_id"]) for r in seen) == list(range(15))
    events = {r["result"]: r["value"] for r in connectors.queue_events(spark, queue, "w").collect()}
    assert events["read"] == 15 and events["reclaimed"] == 2


def test_a_claim_puts_pending_partitions_first(spark, place):
    queue, log, tmp = place
    enqueue(spark, queue, 0, 8)
    reader = connectors.QueueReader({"path": queue, "group": "g", "readCount": "5", "minIdleMs": "0"})
    first = reader.latestOffset()
    assert first == {"claim": 1, "next": 5}
    second = connectors.QueueReader({"path": queue, "group": "g", "readCount": "7", "minIdleMs": "0"}).latestOffset()  # nothing was acknowledged
    parts = reader.partitions(first, second)
    rows = [b.select(["message_id", "deliveries", "reclaimed"]).to_pylist() for p in parts for b in reader.read(p)]
    flat = [tuple(r.values()) for part in rows for r in part]
    assert flat == [(m, 2, True) for m in range(5)] + [(5, 1, False), (6, 1, False)]
    waiting = connectors.QueueReader({"path": queue, "group": "g", "readCount": "7", "minIdleMs": "600000"})
    assert waiting.latestOffset() == {"claim": 3, "next": 8}  # claimed ones aren't idle for long enough
    assert waiting.latestOffset() == {"claim": 3, "next": 8}
    assert reader.partitions(second, second) == []


def test_reads_are_held_back_while_the_buffer_is_full(spark, place):
    queue, log, tmp = place
    enqueue(spark, queue, 0, 20)
    options = {"path": queue, "group": "g", "readCount": "100", "minIdleMs": "600000", "capacity": "8"}
    assert connectors.QueueReader(options).latestOffset() == {"claim": 1, "next": 8}
    for _ in range(3):
        assert connectors.QueueReader(options).latestOffset() == {"claim": 1, "next": 8}
    events = {r["result"]: r["value"] for r in connectors.queue_events(spark, queue, "g").collect()}
    assert events["suppressed"] == 3 and events["read"] == 8 and connectors.outstanding(queue, "g") == 8


def test_a_task_that_fails_and_a_batch_that_repeats_leave_one_fact(spark, place, tmp_path):
    queue, log, tmp = place
    enqueue(spark, queue, 0, 12)
    flag = tmp_path / "failed"

    def once(batches):
        for b in batches:
            yield b
        if not flag.exists():
            flag.write_text("x")
            raise RuntimeError("lost")

    facts = as_facts(queue_stream(spark, queue))
    with pytest.raises(Exception, match="lost"):
        run(facts.mapInPandas(once, facts.schema), tmp + "/state", log, queue)
    assert spark.read.format("fact_log").load(log).count() == 0 and connectors.outstanding(queue, "w") == 12
    run(facts.mapInPandas(once, facts.schema), tmp + "/state", log, queue)
    assert spark.read.format("fact_log").load(log).count() == 12 and connectors.outstanding(queue, "w") == 0
    # the same batch number again, as after a crash between publishing and Spark's own commit
    writer = connectors.LogWriter({"path": log, "queue": queue, "group": "w"})
    import pyarrow as pa

    message = writer.write(iter([pa.RecordBatch.from_pydict({"attempt_id": ["a0"], "value": ["twice"], "message_id": [0]})]))
    writer.commit([message], 0)
    assert sorted(r["message_id"] for r in spark.read.format("fact_log").load(log).collect()) == list(range(12))
    stray = writer.write(iter([pa.RecordBatch.from_pydict({"attempt_id": ["a"], "value": ["v"], "message_id": [1]})]))
    writer.abort([stray, None], 7)
    assert spark.read.format("fact_log").load(log).count() == 12


def test_commands_are_retried_until_their_budget_is_spent(spark, place):
    queue, log, tmp = place
    enqueue(spark, queue, 0, 9)
    for _ in range(4):
        rows = queue_stream(spark, queue).withColumn("status", F.when(F.col("message_id") % 3 == 0, 503).otherwise(200))
        rows = rows.withColumn("outcome", policy.outcome(F.col("status"), F.lit(False), F.col("deliveries"), F.lit(2))).where("outcome <> 'retry'")
        value = F.when(F.col("message_id") != 4, F.concat_ws(":", "outcome", "deliveries"))  # 4 is invalid: acknowledged without a fact
        run(rows.select(F.col("command_id").alias("attempt_id"), value.alias("value"), "message_id"), tmp + "/state", log, queue)
    got = {r["message_id"]: r["value"] for r in spark.read.format("fact_log").load(log).collect()}
    assert got == {m: "retry_exhausted:3" if m % 3 == 0 else "fetched:1" for m in range(9) if m != 4}
    assert connectors.outstanding(queue, "w") == 0


def test_an_empty_queue(spark, place):
    queue, log, tmp = place
    run(as_facts(queue_stream(spark, queue)), tmp + "/state", log, queue)
    assert spark.read.format("fact_log").load(log).count() == 0
    enqueue(spark, queue, 0, 0)
    assert {r["result"] for r in connectors.queue_events(spark, queue, "w").collect()} == {"empty"}


def test_objects_are_published_with_their_facts(spark, place):
    queue, log, tmp = place
    enqueue(spark, queue, 0, 6)
    rows = as_facts(queue_stream(spark, queue)).withColumn("storage_key", F.when(F.col("message_id") % 2 == 0, F.concat(F.lit("pages/"), "attempt_id"))).withColumn("body", F.encode("value", "UTF-8"))
    run(rows, tmp + "/state", log, queue)
    objects = spark.read.format("fact_log").option("table", "objects").load(log)
    assert {r["storage_key"]: bytes(r["body"]).decode() for r in objects.collect()} == {f"pages/a{m}": f"{m}:1:false" for m in (0, 2, 4)}
    assert spark.read.format("fact_log").load(log).count() == 6
    writer = connectors.LogWriter({"path": log})
    import pyarrow as pa

    stray = writer.write(iter([pa.RecordBatch.from_pydict({"attempt_id": ["x"], "value": ["v"], "message_id": [1], "storage_key": ["k"], "body": [b"b"]})]))
    writer.abort([stray], 3)
    assert objects.count() == 3 and not connectors.Folder(log).names("objects")[3:]
