"""Structured Streaming: command intake, identity dedupe, session counters, pacing state, ordered sinks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crawlgrain.functions import commands
from crawlgrain.operators.pacing import HostPacer
from crawlgrain.session import shared_dir
from crawlgrain.sources.commands import COMMAND_SCHEMA


def command_stream(spark: SparkSession, folder: str, files_per_batch: int = 10) -> DataFrame:
    """JSON commands as they appear in folder; files_per_batch bounds a batch as a read count would."""
    return spark.readStream.schema(COMMAND_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, one file or a folder of part files, as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # As a pattern, since a stream's plain path has to be a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def scratch(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared folder, for one run of a stream."""
    return os.path.join(shared_dir(spark), "crawlgrain", f"{label}-{uuid.uuid4().hex}")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet in the shared folder, and give the rows back."""
    spark = stream.sparkSession
    top = scratch(spark, "stream")
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", top + "/state").option("path", top + "/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(top + "/rows")


def dedupe(stream: DataFrame, key: str, time: str, horizon: str) -> DataFrame:
    """The first row of each key; state of a key is dropped once the watermark has passed it by horizon."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def session_counts(stream: DataFrame, keys: list[str], time: str, gap: str, late: str) -> DataFrame:
    """Rows and weight of each gap session once it is over."""
    counted = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("count"), F.sum("weight").alias("weight_sum"))
    return counted.select(*keys, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "count", "weight_sum")


def ordered_sink(write_objects: Callable[[DataFrame], None], publish: Callable[[DataFrame], None], ack: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: objects, then facts, then acknowledgements. A failure repeats the whole batch, so nothing is acknowledged that isn't published."""

    def run(batch: DataFrame, _: int) -> None:
        kept = batch.persist()
        try:
            write_objects(kept)
            publish(kept)
            ack(kept)
        finally:
            kept.unpersist()

    return run


def paced_stream(requests: DataFrame, identities: list[str], interval_ms: int, ttl_ms: int = 86_400_000) -> DataFrame:
    """(event_id, host, identity, start_ms) of a stream of requests (event_id, host, arrive_ms).

    A host's state is the next start of each identity; it goes once the stream is ttl_ms beyond the host's last
    request. Requests of one batch are taken in order of arrival. One that is more than ttl_ms late has outlived the
    state and is left to the engine's late rows.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pacer = HostPacer(identities, interval_ms)
        if state.exists:
            pacer.next = dict(zip(identities, state.get[0], strict=True))
        got = pd.concat(list(batches)).sort_values(["arrive_ms", "event_id"])
        taken = [pacer.take(int(a)) for a in got["arrive_ms"]]
        state.update(([pacer.next[i] for i in identities],))
        state.setTimeoutTimestamp(max(int(got["arrive_ms"].max()), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"event_id": got["event_id"].to_numpy(), "host": key[0], "identity": [t[0] for t in taken], "start_ms": [t[1] for t in taken]})

    out = "event_id long, host string, identity string, start_ms long"
    timed = requests.withColumn("_at", F.timestamp_millis("arrive_ms")).withWatermark("_at", f"{ttl_ms} milliseconds")
    return timed.groupBy("host").applyInPandasWithState(step, out, "next array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def delayed_stream(commands_df: DataFrame, time: str, late_ms: int = 86_400_000) -> DataFrame:
    """(event_id, host, eligible_ms) of commands (event_id, host, eligible_ms, and time), each given out once the stream's time, the latest seen, has reached eligible_ms.

    Commands that wait are state of their host, in order of eligible_ms, then event_id; a timer wakes the host for the
    next one. A late command is given out as soon as it is due; one that is more than late_ms late is left to the
    engine's late rows.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            waiting += [(int(at), int(e)) for b in batches for at, e in zip(b["eligible_ms"], b["event_id"], strict=True)]
        mark = state.getCurrentWatermarkMs()
        now = mark + late_ms
        due, rest = sorted(w for w in waiting if w[0] <= now), sorted(w for w in waiting if w[0] > now)
        if rest:
            state.update(([w[0] for w in rest], [w[1] for w in rest]))
            state.setTimeoutTimestamp(max(rest[0][0] - late_ms - 1, mark + 1))
        elif state.exists:
            state.remove()
        if due:
            yield pd.DataFrame({"event_id": [w[1] for w in due], "host": key[0], "eligible_ms": [w[0] for w in due]})

    rows = commands_df.withWatermark(time, f"{late_ms} milliseconds").select("event_id", "host", "eligible_ms", time)
    return rows.groupBy("host").applyInPandasWithState(step, "event_id long, host string, eligible_ms long", "eligible array<long>, event array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def ending(last: DataFrame) -> DataFrame:
    """The rows of last (the end marker of a finished input) as a stream of their own, to be united with the input's."""
    spark = last.sparkSession
    path = scratch(spark, "ending")
    last.write.parquet(path)
    return spark.readStream.schema(last.schema).parquet(path)


def split_valid(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) commands of a batch, wrapped ones unwrapped; the invalid ones with error, to be acknowledged without a fact."""
    c = {f: F.col(f) for f in commands.FIELDS}
    rows = commands.unwrap(batch) if "payload" in batch.columns else batch.withColumn("payload_error", F.lit(None).cast("string"))
    judged = rows.withColumn("error", F.coalesce("payload_error", commands.command_error(c))).drop("payload_error")
    return judged.where("error is null").drop("error"), judged.where("error is not null")


def command_loop(batch_sink: Callable[[DataFrame, int], None], invalid_sink: Callable[[DataFrame], None], paused: Callable[[], bool]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the pause flag is asked first, invalid commands go aside, valid ones to batch_sink.

    A paused batch fails with Paused, so nothing of it counts as read; the query is started again once the flag is down.
    """

    def run(batch: DataFrame, number: int) -> None:
        if paused():
            raise Paused("reading is paused")
        kept = batch.persist()
        try:
            valid, invalid = split_valid(kept)
            invalid_sink(invalid)
            batch_sink(valid, number)
        finally:
            kept.unpersist()

    return run


class Paused(Exception):
    pass
