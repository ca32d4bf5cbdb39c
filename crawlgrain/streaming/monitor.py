"""What a running query says of itself: progress as a table, observed counts, heartbeat, readiness, a stop that lets a batch end."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from crawlgrain.functions import runtime
from crawlgrain.sources.connectors import Folder

EVENT = "event string, query string, run_id string, batch_id long, at_ms long, rows long, batch_ms long, observed map<string,map<string,long>>, error string"


def _ms(iso: str) -> int:
    return int(datetime.fromisoformat(iso.replace("Z", "+00:00")).timestamp() * 1000)


class ProgressLog(StreamingQueryListener):
    """Writes one small file for each event of the session's queries into a folder; events() reads them.

    Counts that a query observes by DataFrame.observe come along. A query is known by its name, or its id without one.
    """

    def __init__(self, path: str):
        self.folder, self.names = Folder(path), {}

    def write(self, event: str, query: str, run_id: str, at_ms: int, **more) -> None:
        self.folder.write(f"events/{at_ms:015d}-{event}-{run_id}-{more.get('batch_id', 0) or 0}.json", {"event": event, "query": query, "run_id": run_id, "at_ms": at_ms, **more})

    def settle(self, run_id: str, most_seconds: float = 60.0) -> bool:
        """Wait until the end of a run has been written: events come some time after they happen."""
        end = time.monotonic() + most_seconds
        while time.monotonic() < end:
            if any(f"-{kind}-{run_id}-" in n for n in self.folder.names("events") for kind in ("ended", "failed")):
                return True
            time.sleep(0.05)
        return False

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or str(event.id)
        self.write("started", self.names[str(event.runId)], str(event.runId), _ms(event.timestamp))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = {name: {k: int(v) for k, v in row.asDict().items() if isinstance(v, (int, bool))} for name, row in p.observedMetrics.items()}
        self.write("progress", p.name or str(p.id), str(p.runId), _ms(p.timestamp), batch_id=p.batchId, rows=p.numInputRows, batch_ms=p.batchDuration, observed=seen)

    def onQueryIdle(self, event) -> None:
        self.write("idle", self.names.get(str(event.runId), str(event.id)), str(event.runId), _ms(event.timestamp))

    def onQueryTerminated(self, event) -> None:
        self.write("failed" if event.exception else "ended", self.names.get(str(event.runId), str(event.id)), str(event.runId), int(time.time() * 1000), error=event.exception)


def counts(**conditions: Column) -> list[Column]:
    """For DataFrame.observe: how many rows of a batch fulfil each condition, by its name."""
    return [F.count_if(c).alias(name) for name, c in conditions.items()]


def events(spark: SparkSession, path: str) -> DataFrame:
    """All events (EVENT) that a ProgressLog wrote."""
    folder = Folder(path)
    if not folder.names("events"):
        return spark.createDataFrame([], EVENT)
    return spark.read.schema(EVENT).json(f"{path}/events")


def heartbeats(log: DataFrame, now_ms: int, most_seconds: int = 30) -> DataFrame:
    """(query, last_ms, age, ready): the last sign of life of each query; ready while it runs and that is recent enough."""
    last = log.groupBy("query").agg(F.max("at_ms").alias("last_ms"), F.max_by("event", F.struct("at_ms", F.col("event").isin("ended", "failed"))).alias("event"))
    age = runtime.heartbeat_age(F.col("last_ms"), now_ms)
    return last.select("query", "last_ms", age.alias("age"), runtime.ready(~F.col("event").isin("ended", "failed"), F.col("last_ms"), now_ms, most_seconds).alias("ready"))


def observed(log: DataFrame) -> DataFrame:
    """(query, name, value): sums of what batches observed; a batch that ran again counts once."""
    once = log.where("event = 'progress'").groupBy("query", "batch_id").agg(F.max_by("observed", "at_ms").alias("observed"))
    flat = once.select("query", F.explode("observed").alias("metric", "named")).select("query", F.explode("named").alias("name", "value"))
    return flat.groupBy("query", "name").agg(F.sum("value").alias("value"))


def alive(query: StreamingQuery) -> bool:
    """Liveness: the query runs and hasn't failed."""
    return query.isActive and query.exception() is None


def readiness(query: StreamingQuery, now_ms: int | None = None, most_seconds: int = 30) -> dict:
    """What a readiness check answers: ready, and the age in seconds of the last batch's start (null before the first)."""
    last = query.lastProgress
    now = int(time.time() * 1000) if now_ms is None else now_ms
    age = None if last is None else max(now - _ms(last["timestamp"]), 0) / 1000
    return {"ready": alive(query) and age is not None and age <= most_seconds, "heartbeat_age_seconds": age, "initialized": last is not None}


def stop_gracefully(query: StreamingQuery, log: ProgressLog | None = None, most_seconds: float = 60.0, look_every: float = 0.05) -> bool:
    """Stop the query between two batches, so that a batch that runs may end; False if it didn't in most_seconds and was cut off.

    Events shutdown_started, and shutdown_drained or shutdown_timeout, go to log.
    """

    def said(event: str) -> None:
        if log is not None:
            log.write(event, query.name or str(query.id), str(query.runId), int(time.time() * 1000))

    said("shutdown_started")
    end = time.monotonic() + most_seconds
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < end:
        time.sleep(look_every)
    drained = not (query.isActive and query.status["isTriggerActive"])
    query.stop()
    said("shutdown_drained" if drained else "shutdown_timeout")
    return drained


def shutdown_events(log: DataFrame) -> DataFrame:
    """(result, value) of shutdown events."""
    return log.where(F.startswith("event", F.lit("shutdown_"))).groupBy(F.substring("event", 10, 99).alias("result")).agg(F.count("*").alias("value"))
