"""Keyed state in the state store: writes with a time to live, reads that may miss, commands that wait for their time.

State is kept by transformWithState, so it is partitioned by key, checkpointed with the query, and read as a table by
the state data source. Times to live and timers follow the clock, so these queries need a processing-time trigger (or once, for
one batch): with availableNow Spark plans batch after batch and never ends.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from crawlgrain.functions import commands
from crawlgrain.operators import policy

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOST_TTL_S = 86_400
OUT_ROWS = 10_000
PACK_BYTES = 16_000_000


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that these operators need, for queries that are started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _once(writer: DataStreamWriter, spark: SparkSession, folder: str) -> None:
    with state_store(spark):
        writer.option("checkpointLocation", f"{folder}/state").trigger(once=True).start().awaitTermination()


def one_batch(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream for one batch with its checkpoint in folder/state and its rows in folder/rows; all rows so far."""
    spark = stream.sparkSession
    _once(stream.writeStream.format("parquet").option("path", f"{folder}/rows"), spark, folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def one_batch_of_state(stream: DataFrame, folder: str) -> None:
    """The same for callers that read the state in folder/state: the rows are made and not kept."""
    _once(stream.writeStream.format("noop"), stream.sparkSession, folder)


# --- state with a time to live ----------------------------------------------------------------

STATE_OUT = "key string, n long, op string, result string, fields map<string,string>, expires_ms long"


class TtlState(StatefulProcessor):
    """Fields of one key: a map of fields, a value for the time at which they end, a list of the writes that renewed
    them, as one array a batch, since the store takes a list's element in time that goes with the list's length.

    Rows are taken in order of at_ms, then n. A write replaces the fields it names and renews the time to live (1 s to 24 h); a
    read finds what is alive at its at_ms. The store itself forgets a key 24 hours after its last write. Without `enabled`, writes
    have the result disabled. A write without a number of seconds fails: failed_open, or an error unless fail_open.
    """

    def __init__(self, enabled: bool = True, fail_open: bool = True):
        self.enabled, self.fail_open = enabled, fail_open

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = MOST_TTL_S * 1000
        self.fields = handle.getMapState("fields", "field string", "value string", ttlDurationMs=ttl)
        self.expires = handle.getValueState("expires", "expires_ms long", ttlDurationMs=ttl)
        self.renewals = handle.getListState("renewed", "writes array<struct<n:bigint,at_ms:bigint>>", ttlDurationMs=ttl)

    def _ends(self, at: np.ndarray, ttl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """When writes end, and whether they say so."""
        says = np.isfinite(ttl)
        if not self.fail_open and not says.all():
            raise ValueError("a write without a number of seconds")
        return at + 1000 * np.clip(np.trunc(np.where(says, ttl, 1)), 1, MOST_TTL_S).astype("int64"), says

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        """Each call to the store is a round trip, so what is held is read once, rows are taken in memory, and what they leave is written once."""
        got = pd.concat(list(rows), ignore_index=True)
        if got[["at_ms", "n"]].isna().any(axis=None):
            raise ValueError("at_ms and n can't be null")
        order = np.lexsort((got["n"].to_numpy("int64"), got["at_ms"].to_numpy("int64")))
        at, n = (got[c].to_numpy("int64")[order] for c in ("at_ms", "n"))
        op, fields = (got[c].to_numpy(object)[order] for c in ("op", "fields"))
        held, size = self.expires.get(), len(got)
        write = (op == "write").astype(bool)
        taken = write & self.enabled
        if taken.any():
            ends, says = np.zeros(size, "int64"), np.zeros(size, bool)
            ends[taken], says[taken] = self._ends(at[taken], got["ttl"].to_numpy("float64", na_value=np.nan)[order][taken])
            taken &= says
        else:
            ends = np.zeros(size, "int64")
        # The last write before each row gives the time until which the key is alive there; a write that finds it expired begins a life.
        last = np.maximum.accumulate(np.where(taken, np.arange(size), -1))
        before = np.concatenate([[-1], last[:-1]])
        never = np.iinfo("int64").min
        till = np.where(before >= 0, ends[before], held[0] if held is not None else never)
        alive = till > at
        begins = np.flatnonzero(taken & ~alive)
        words = np.array(["miss", "hit", "failed_open" if self.enabled else "disabled", "written"], object)
        result = words[np.where(write, 2 + taken, alive)]
        until = np.where(taken, ends, till)

        found, stored, said, done = np.full(size, None, object), None, {}, 0
        for i in [*np.flatnonzero(~write & alive).tolist(), size]:
            k = np.searchsorted(begins, i)
            if k and begins[k - 1] >= done:
                stored, said, done = {}, {}, int(begins[k - 1])
            for x in fields[done:i][taken[done:i]]:
                if x:
                    said.update(x)
            done = i
            if i < size:
                if stored is None:
                    stored = {k[0]: v[0] for k, v in self.fields.iterator()}
                found[i] = {**stored, **said}

        if len(begins):
            self.fields.clear()
            self.renewals.clear()
        if taken.any():
            for k, v in said.items():
                self.fields.updateValue((k,), (v,))
            self.expires.update((int(ends[last[-1]]),))
            kept = np.flatnonzero(taken)
            kept = kept[kept >= begins[-1]] if len(begins) else kept
            for i in range(0, len(kept), OUT_ROWS):
                part = kept[i : i + OUT_ROWS]
                self.renewals.appendValue((list(zip(n[part].tolist(), at[part].tolist(), strict=True)),))
        expires = pd.arrays.IntegerArray(until, ~(taken | alive))
        for i in range(0, size, OUT_ROWS):
            part = slice(i, i + OUT_ROWS)
            yield pd.DataFrame({"key": key[0], "n": n[part], "op": op[part], "result": result[part], "fields": found[part], "expires_ms": expires[part]})

    def close(self) -> None:
        pass


PACKED = "key string, ops binary"
OPS = pa.schema([("at_ms", pa.int64()), ("n", pa.int64()), ("op", pa.string()), ("fields", pa.string()), ("ttl", pa.float64())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Operations of one key that come together, as one row of Arrow bytes: Spark shuffles, sorts and hands on row by row."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held, size = [*held, batch], size + batch.nbytes
        if size >= PACK_BYTES:
            yield _packed(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield _packed(pa.Table.from_batches(held))


def _packed(rows: pa.Table) -> pa.RecordBatch:
    keys = rows["key"].combine_chunks().dictionary_encode()
    codes = keys.indices.to_numpy()
    ops = rows.select(OPS.names).cast(OPS).combine_chunks().take(np.argsort(codes, kind="stable")).combine_chunks().to_batches()[0]
    counts = np.bincount(codes)
    parts = [ops.slice(end - n, n).serialize().to_pybytes() for n, end in zip(counts.tolist(), np.cumsum(counts).tolist(), strict=True)]
    return pa.RecordBatch.from_pydict({"key": keys.dictionary, "ops": pa.array(parts, pa.binary())})


def _unpacked(rows: pd.DataFrame) -> pd.DataFrame:
    """The operations of packed rows, fields read from JSON once for each text."""
    flat = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(x), OPS) for x in rows["ops"]], OPS)
    texts = flat["fields"].combine_chunks().dictionary_encode()
    said = np.array([*map(json.loads, texts.dictionary.to_pylist()), None], object)
    return flat.drop_columns("fields").to_pandas().assign(fields=said[texts.indices.fill_null(-1).to_numpy()])


class PackedState(TtlState):
    """TtlState over packed rows."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        return super().handleInputRows(key, map(_unpacked, rows), timerValues)


def keyed_state(operations: DataFrame, enabled: bool = True, fail_open: bool = True) -> DataFrame:
    """(key, n, op, result, fields, expires_ms) of a stream of operations (key, at_ms, n, op, fields, ttl), op write or read.

    Rows with a null key belong to no state and are left out. Start it within state_store().
    """
    said = F.to_json("fields", {"ignoreNullFields": "false"}).alias("fields")
    rows = operations.where(F.col("key").isNotNull()).select("key", F.col("at_ms").cast("long").alias("at_ms"), F.col("n").cast("long").alias("n"), "op", said, F.col("ttl").cast("double").alias("ttl"))
    return rows.mapInArrow(_pack, PACKED).groupBy("key").transformWithStateInPandas(PackedState(enabled, fail_open), STATE_OUT, "append", "processingTime")


def _stored(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()


def stored_state(spark: SparkSession, checkpoint: str, now_ms: int) -> DataFrame:
    """(key, fields, expires_ms) of what is alive at now_ms, from the checkpoint of a keyed_state query."""
    ends = _stored(spark, checkpoint, "expires").select(F.col("key.key").alias("key"), F.col("value.value.expires_ms").alias("expires_ms")).where(F.col("expires_ms") > now_ms)
    said = _stored(spark, checkpoint, "fields").select(F.col("key.key").alias("key"), F.col("user_map_key.field").alias("field"), F.col("user_map_value.value.value").alias("value"))
    pairs = said.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    return ends.join(pairs, "key", "left").select("key", F.coalesce("fields", F.expr("cast(map() as map<string,string>)")).alias("fields"), "expires_ms")


def live_keys(spark: SparkSession, checkpoint: str, now_ms: int) -> DataFrame:
    """(key, ttl) of live state, ttl in seconds left, as the key audit takes them."""
    return stored_state(spark, checkpoint, now_ms).select("key", F.ceil((F.col("expires_ms") - now_ms) / 1000).cast("long").alias("ttl"))


# --- commands that wait -----------------------------------------------------------------------

DELAY_OUT = "buffer string, event string, message_id long, eligible_ms long, read_ms long, at_ms long, body string"


class DelayBuffer(StatefulProcessor):
    """Commands that wait for their time, in a buffer of bounded capacity for each key.

    A map from time to the commands due then, so that a timer reads and removes only these; another map of times at which
    those that still wait are to be warned of; a count.
    """

    def __init__(self, capacity: int, most_wait_ms: int):
        self.capacity, self.most_wait_ms = capacity, most_wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        waiting = "items array<struct<message_id:bigint,read_ms:bigint,body:string>>"
        self.due = handle.getMapState("due", "eligible_ms long", waiting)
        self.late = handle.getMapState("late", "warn_ms long", "items array<struct<message_id:bigint,eligible_ms:bigint,read_ms:bigint>>")
        self.size = handle.getValueState("size", "n long")

    @staticmethod
    def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["buffer", "event", "message_id", "eligible_ms", "read_ms", "at_ms", "body"])

    @staticmethod
    def _items(state, at: int) -> list[tuple]:
        found = state.getValue((at,))
        return [tuple(i) for i in found[0]] if found is not None else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        n = self.size.get()[0] if self.size.exists() else 0
        got = pd.concat(list(rows)).sort_values(["eligible_ms", "message_id"])
        out, due, late = [], {}, {}
        for m, eligible, read, body in zip(got["message_id"], got["eligible_ms"], got["read_ms"], got["body"], strict=True):
            m, eligible, read = int(m), int(eligible), int(read)
            if eligible <= now:
                out.append(("due", m, eligible, read, now, body))
            elif self.capacity > 0 and n >= self.capacity:
                out.append(("delayed_buffer_full", m, eligible, read, now, body))
            else:
                n += 1
                due.setdefault(eligible, []).append((m, read, body))
                if read + self.most_wait_ms < eligible:
                    late.setdefault(max(read + self.most_wait_ms, now + 1), []).append((m, eligible, read))
                out.append(("delayed", m, eligible, read, now, None))
        for state, added in ((self.due, due), (self.late, late)):
            for at, items in added.items():
                state.updateValue((at,), (self._items(state, at) + items,))
                self.handle.registerTimer(at)
        self.size.update((n,))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentProcessingTimeInMs()
        due, late = self._items(self.due, at), self._items(self.late, at)
        out = [("max_local_delay_exceeded", m, eligible, read, now, None) for m, eligible, read in late if eligible > now]
        out += [("due", m, at, read, now, body) for m, read, body in due]
        for state, items in ((self.due, due), (self.late, late)):
            if items:
                state.removeKey((at,))
        if due:
            self.size.update((self.size.get()[0] - len(due),))
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def delay_buffer(waiting: DataFrame, capacity: int, most_wait_ms: int = 300_000) -> DataFrame:
    """What becomes of a stream of commands (buffer, message_id, eligible_ms, read_ms, body) that are to wait until eligible_ms.

    Events: due (give it out now), delayed (it waits), delayed_buffer_full (its buffer holds capacity commands, 0 for any number: the
    command stays with its source), max_local_delay_exceeded (once, most_wait_ms after it was read; it goes on waiting). Times are
    the clock's. A buffer's commands are state of one key, so callers spread consumers over buffers. Start it within state_store().
    """
    rows = waiting.where("buffer is not null and eligible_ms is not null").select("buffer", "message_id", "eligible_ms", F.coalesce("read_ms", "eligible_ms").alias("read_ms"), "body")
    return rows.groupBy("buffer").transformWithStateInPandas(DelayBuffer(capacity, most_wait_ms), DELAY_OUT, "append", "processingTime")


def rejudge(due: DataFrame, provider: policy.PolicyProvider, now_ms: int) -> DataFrame:
    """Commands that fall due (body: the command as JSON) with the policy of this moment and stopped_by; null goes on to be fetched.

    Called for each micro-batch, so a policy that was changed, or a deadline that passed while a command waited, holds for it.
    """
    document = provider.current()
    fields = ", ".join(f"{f} string" for f in commands.FIELDS)
    rows = due.where("event = 'due'").select("message_id", "eligible_ms", "at_ms", F.from_json("body", fields).alias("c")).select("message_id", "eligible_ms", "at_ms", "c.*")
    default = {**policy.BOOTSTRAP, **{k: v for k, v in document["default_policy"].items() if v is not None}}
    decided = policy.decide(rows, policy.scope_table(due.sparkSession, document), default, "message_id")
    return decided.withColumn("stopped_by", policy.gate(F.col("policy_paused"), F.col("policy_enabled"), F.col("deadline_at"), now_ms))


def buffer_sizes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(buffer, n, oldest_read_ms) of what waits, from the checkpoint of a delay_buffer query."""
    held = _stored(spark, checkpoint, "due").select(F.col("key.buffer").alias("buffer"), F.explode("user_map_value.items").alias("i"))
    return held.groupBy("buffer").agg(F.count("*").alias("n"), F.min("i.read_ms").alias("oldest_read_ms"))
