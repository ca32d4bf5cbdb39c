"""Data sources in Python: a queue of commands that is read as a stream, and a log of facts with a commit protocol.

    register(spark)
    commands.write.format("command_queue").mode("append").save(folder)
    spark.readStream.format("command_queue").option("group", "workers").load(folder)
    facts.writeStream.format("fact_log").option("queue", folder).option("group", "workers").start(log)

A queue is a folder of Parquet segments, named by the number of their first message. A group's offset has two parts:
its claims, and the next message that nobody was given. A claim takes messages that were given out at least
minIdleMs ago and never acknowledged, then new ones, readCount together at most; while `capacity` messages are out, it
takes no new ones. What a claim took is written down before Spark sees its offset, so a repeated batch has the same
rows, and a claim that was never read comes with the next one.

A fact, and an object that goes with it (storage_key, body), is published when its file is in a manifest, one for each batch number. Manifests are written on the driver after all
tasks have finished, and acknowledgements after the manifest: a task or batch that runs twice leaves one copy of its facts,
and nothing is acknowledged that isn't published.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from crawlgrain.functions import commands
from crawlgrain.session import ship

FIELDS = [*commands.FIELDS, "payload"]
QUEUE_SCHEMA = "message_id long, deliveries int, reclaimed boolean, claimed_ms long, " + ", ".join(f"{f} string" for f in FIELDS)
LOG_SCHEMA = "attempt_id string, value string, message_id long"
OBJECT_SCHEMA = "storage_key string, body binary"
ROWS_OF_A_TASK = 10_000


class Folder:
    """Files below a path of any file system that pyarrow knows."""

    def __init__(self, path: str):
        self.fs, self.top = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def names(self, below: str) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.top}/{below}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith((".", "_")))

    def read(self, name: str) -> dict:
        with self.fs.open_input_stream(f"{self.top}/{name}") as f:
            return json.loads(f.read())

    def write(self, name: str, value: dict) -> None:
        """The whole file appears at once."""
        folder, _, base = f"{self.top}/{name}".rpartition("/")
        self.fs.create_dir(folder, recursive=True)
        staged = f"{folder}/_{base}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(staged) as f:
            f.write(json.dumps(value).encode())
        self.fs.move(staged, f"{folder}/{base}")

    def table(self, name: str, columns: list[str] | None = None) -> pa.Table:
        return pq.read_table(f"{self.top}/{name}", columns=columns, filesystem=self.fs)

    def save(self, name: str, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> int:
        self.fs.create_dir(f"{self.top}/{name}".rpartition("/")[0], recursive=True)
        rows = 0
        with pq.ParquetWriter(f"{self.top}/{name}", schema, filesystem=self.fs) as out:
            for b in batches:
                out.write_batch(b)
                rows += b.num_rows
        return rows

    def drop(self, name: str) -> None:
        if self.fs.get_file_info(f"{self.top}/{name}").type != fs.FileType.NotFound:
            self.fs.delete_file(f"{self.top}/{name}")

    def drop_tree(self, name: str) -> None:
        if self.fs.get_file_info(f"{self.top}/{name}").type != fs.FileType.NotFound:
            self.fs.delete_dir(f"{self.top}/{name}")

    def move(self, name: str, to: str) -> None:
        self.fs.create_dir(f"{self.top}/{to}".rpartition("/")[0], recursive=True)
        self.fs.move(f"{self.top}/{name}", f"{self.top}/{to}")


def _numbered(n: int) -> str:
    return f"{n:020d}"


@dataclass
class Written(WriterCommitMessage):
    """A file that a task has written and how many rows it has, and the file of its objects."""

    file: str
    rows: int
    objects: str = ""


# --- the queue --------------------------------------------------------------------------------


class Group:
    """A consumer group: its claims, newest last, what is out, and the acknowledgements it hasn't counted yet."""

    def __init__(self, folder: Folder, name: str):
        self.folder, self.at = folder, f"groups/{name}"

    def segments(self) -> list[tuple[int, int, str]]:
        """(first message, messages, file)."""
        return [(int(n[:20]), int(n[21:-8]), f"log/{n}") for n in self.folder.names("log")]

    def last(self) -> dict:
        names = self.folder.names(f"{self.at}/claims")
        return self.folder.read(f"{self.at}/claims/{names[-1]}") if names else {"claim": 0, "to": 0, "out": {}, "acks": {}}

    def claim(self, number: int) -> dict:
        return self.folder.read(f"{self.at}/claims/{_numbered(number)}.json")

    def outstanding(self, last: dict) -> tuple[dict[int, list[int]], dict[str, str]]:
        """(message: [deliveries, given out at]) of what isn't acknowledged, and the newest acknowledgement of each query."""
        out, seen = {int(k): v for k, v in last["out"].items()}, dict(last["acks"])
        for name in self.folder.names(f"{self.at}/acks"):
            query, _, number = name[:-5].rpartition(".")
            if number > seen.get(query, ""):
                for file in self.folder.read(f"{self.at}/acks/{name}")["files"]:
                    for m in pq.read_table(file["path"], columns=["message_id"], filesystem=fs.FileSystem.from_uri(file["uri"])[0]).column(0).to_pylist():
                        out.pop(m, None)
                seen[query] = number
        return out, seen

    def count(self, event: str, n: int = 1) -> None:
        names = self.folder.names(f"{self.at}/events")
        counts = self.folder.read(f"{self.at}/events/counts.json") if names else {}
        self.folder.write(f"{self.at}/events/counts.json", counts | {event: counts.get(event, 0) + n})


@dataclass
class Share(InputPartition):
    """Rows of one segment: places in it, with their numbers and deliveries."""

    file: str
    first: int
    places: list[int]
    deliveries: list[int]
    reclaimed: bool
    at_ms: int


class QueueReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.group = options["path"], options.get("group", "default")
        self.count, self.idle_ms, self.capacity = (int(options.get(k, d)) for k, d in (("readCount", 100_000), ("minIdleMs", 600_000), ("capacity", 1_000_000)))

    def _group(self) -> Group:
        return Group(Folder(self.path), self.group)

    def initialOffset(self) -> dict:
        return {"claim": 0, "next": 0}

    def latestOffset(self) -> dict:
        """Claim what there is to read; the offset stays where it is if that is nothing."""
        group = self._group()
        last = group.last()
        out, acks = group.outstanding(last)
        now = int(time.time() * 1000)
        idle = sorted(m for m, (_, at) in out.items() if at + self.idle_ms <= now)[: self.count]
        end = max((first + n for first, n, _ in group.segments()), default=0)
        room = max(self.capacity - len(out), 0) if self.capacity > 0 else self.count
        fresh = min(self.count - len(idle), room, end - last["to"])
        if self.capacity > 0 and not room and end > last["to"]:
            group.count("suppressed")
        if not idle and fresh <= 0:
            if end == last["to"]:
                group.count("empty")
            return {"claim": last["claim"], "next": last["to"]}
        again = [[m, out[m][0] + 1] for m in idle]
        to = last["to"] + max(fresh, 0)
        given = {m: [1, now] for m in range(last["to"], to)} | {m: [n, now] for m, n in again}
        number = last["claim"] + 1
        group.folder.write(
            f"{group.at}/claims/{_numbered(number)}.json",
            {"claim": number, "from": last["to"], "to": to, "reclaimed": again, "at_ms": now, "out": out | given, "acks": acks},
        )
        group.count("read", to - last["to"])
        group.count("reclaimed", len(again))
        return {"claim": number, "next": to}

    def partitions(self, start: dict, end: dict) -> Sequence[Share]:
        """Claimed rows first, then new ones."""
        group = self._group()
        segments = group.segments()
        old, new = [], []
        for number in range(start["claim"] + 1, end["claim"] + 1):
            claim = group.claim(number)
            for first, n, file in segments:
                mine = [(m, d) for m, d in claim["reclaimed"] if first <= m < first + n]
                for at in range(0, len(mine), ROWS_OF_A_TASK):
                    part = mine[at : at + ROWS_OF_A_TASK]
                    old.append(Share(file, first, [m - first for m, _ in part], [d for _, d in part], True, claim["at_ms"]))
                low, high = max(first, claim["from"]), min(first + n, claim["to"])
                for at in range(low, high, ROWS_OF_A_TASK):
                    places = list(range(at - first, min(at + ROWS_OF_A_TASK, high) - first))
                    new.append(Share(file, first, places, [1] * len(places), False, claim["at_ms"]))
        return old + new

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        rows = Folder(self.path).table(partition.file).take(pa.array(partition.places, pa.int64()))
        n = len(partition.places)
        own = {
            "message_id": pa.array([partition.first + p for p in partition.places], pa.int64()),
            "deliveries": pa.array(partition.deliveries, pa.int32()),
            "reclaimed": pa.array([partition.reclaimed] * n, pa.bool_()),
            "claimed_ms": pa.array([partition.at_ms] * n, pa.int64()),
        }
        yield from pa.table(own | {f: rows.column(f).combine_chunks() for f in FIELDS}).to_batches()

    def commit(self, end: dict) -> None:
        """Claims before the last one are never asked for again."""
        group = self._group()
        for name in group.folder.names(f"{group.at}/claims"):
            if int(name[:20]) < end["claim"]:
                group.folder.drop(f"{group.at}/claims/{name}")


class QueueWriter(DataSourceArrowWriter):
    """Appends commands: tasks write files, the driver numbers them once all are there."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        schema = pa.schema([(f, pa.string()) for f in FIELDS])
        name = f"staged/{uuid.uuid4().hex}.parquet"
        rows = (pa.RecordBatch.from_arrays([b.column(f).cast(pa.string()) if f in b.schema.names else pa.nulls(b.num_rows, pa.string()) for f in FIELDS], schema=schema) for b in iterator)
        return Written(name, Folder(self.path).save(name, rows, schema))

    def commit(self, messages: list) -> None:
        folder = Folder(self.path)
        end = max((first + n for first, n, _ in Group(folder, "").segments()), default=0)
        for m in messages:
            if m is not None and m.rows:
                folder.move(m.file, f"log/{_numbered(end)}-{m.rows}.parquet")
                end += m.rows
            elif m is not None:
                folder.drop(m.file)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                Folder(self.path).drop(m.file)


class CommandQueue(DataSource):
    """Options: path; to read: group, readCount, minIdleMs, capacity (0: no bound; what is out is listed on the driver, so it should have one)."""

    @classmethod
    def name(cls) -> str:
        return "command_queue"

    def schema(self) -> str:
        return QUEUE_SCHEMA

    def streamReader(self, schema: T.StructType) -> QueueReader:
        return QueueReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> QueueWriter:
        if overwrite:
            raise ValueError("a queue is only appended to")
        return QueueWriter(self.options["path"])


# --- the log of facts -------------------------------------------------------------------------


class LogWriter(DataSourceStreamArrowWriter):
    """Tasks write files; commit publishes them by a manifest of the batch, then acknowledges their messages."""

    def __init__(self, options: dict):
        self.path, self.query = options["path"], options.get("query", "facts")
        self.queue, self.group = options.get("queue"), options.get("group", "default")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        facts = pa.schema([("attempt_id", pa.string()), ("value", pa.string()), ("message_id", pa.int64())])
        bodies = pa.schema([("storage_key", pa.string()), ("body", pa.binary())])
        folder, name = Folder(self.path), uuid.uuid4().hex
        objects = ""
        data = f"{folder.top}/data/{name}.parquet"
        folder.fs.create_dir(f"{folder.top}/data", recursive=True)
        rows, out, kept = 0, pq.ParquetWriter(data, facts, filesystem=folder.fs), None
        try:
            for b in iterator:
                out.write_batch(pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) if f.name in b.schema.names else pa.nulls(b.num_rows, f.type) for f in facts], schema=facts))
                rows += b.num_rows
                if "body" in b.schema.names:
                    some = b.select(["storage_key", "body"]).filter(pc.is_valid(b.column("storage_key")))
                    if kept is None:
                        objects = f"objects/{name}.parquet"
                        folder.fs.create_dir(f"{folder.top}/objects", recursive=True)
                        kept = pq.ParquetWriter(f"{folder.top}/{objects}", bodies, filesystem=folder.fs)
                    kept.write_batch(pa.RecordBatch.from_arrays([some.column(0).cast(pa.string()), some.column(1).cast(pa.binary())], schema=bodies))
        finally:
            out.close()
            if kept is not None:
                kept.close()
        return Written(f"data/{name}.parquet", rows, objects)

    def commit(self, messages: list, batchId: int) -> None:
        folder, name = Folder(self.path), f"manifests/{self.query}.{_numbered(batchId)}.json"
        written = [m.file for m in messages if m is not None]
        if name.rpartition("/")[2] in folder.names("manifests"):
            self.abort(messages, batchId)  # the batch was published before: what was written again goes
            written = folder.read(name)["files"]
        else:
            folder.write(name, {"files": written, "objects": [m.objects for m in messages if m is not None and m.objects]})
        if self.queue:
            uri = self.path if "://" in self.path else "file://" + self.path
            files = [{"path": f"{folder.top}/{f}", "uri": uri} for f in written]
            Folder(self.queue).write(f"groups/{self.group}/acks/{self.query}.{_numbered(batchId)}.json", {"files": files})

    def abort(self, messages: list, batchId: int) -> None:
        for m in messages:
            if m is not None:
                for file in (m.file, m.objects) if m.objects else (m.file,):
                    Folder(self.path).drop(file)


@dataclass
class LogFile(InputPartition):
    file: str


class LogReader(DataSourceReader):
    """Published facts, or objects, one task for each file; rows without a value are acknowledgements only."""

    def __init__(self, path: str, objects: bool):
        self.path, self.objects = path, objects

    def partitions(self) -> Sequence[LogFile]:
        folder = Folder(self.path)
        kind = "objects" if self.objects else "files"
        return [LogFile(f) for name in folder.names("manifests") for f in folder.read(f"manifests/{name}")[kind]] or [LogFile("")]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        if partition.file:
            rows = Folder(self.path).table(partition.file)
            yield from (rows if self.objects else rows.filter(pc.is_valid(rows.column("value")))).to_batches()


class FactLog(DataSource):
    """Options: path; to write: query (a name of its own for each checkpoint), queue and group whose messages are acknowledged; to read: table, facts or objects.

    Columns to write: attempt_id, value (the fact as JSON; null: nothing but an acknowledgement), message_id, and, where there is an object, storage_key and body.
    """

    @classmethod
    def name(cls) -> str:
        return "fact_log"

    def schema(self) -> str:
        return OBJECT_SCHEMA if self.options.get("table") == "objects" else LOG_SCHEMA

    def reader(self, schema: T.StructType) -> LogReader:
        return LogReader(self.options["path"], self.options.get("table") == "objects")

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> LogWriter:
        return LogWriter(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(CommandQueue)
    spark.dataSource.register(FactLog)


def queue_events(spark: SparkSession, path: str, group: str) -> DataFrame:
    """(result, value) of a group's reads: messages read and reclaimed, looks that found nothing, reads held back by a full buffer."""
    found = Group(Folder(path), group)
    counts = found.folder.read(f"{found.at}/events/counts.json") if found.folder.names(f"{found.at}/events") else {}
    return spark.createDataFrame(sorted(counts.items()), "result string, value long")


def outstanding(path: str, group: str) -> int:
    """Messages that are out and not acknowledged."""
    found = Group(Folder(path), group)
    return len(found.outstanding(found.last())[0])
