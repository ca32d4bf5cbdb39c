"""Pacing with several identities per host: a recurrence, so one pass per host in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


class HostPacer:
    """State of one host: when each identity may start next. The first in rank order that is free is taken, else the first to be free."""

    def __init__(self, identities: list[str], interval_ms: int):
        self.interval = interval_ms
        self.next = dict.fromkeys(identities, 0)
        self.order = identities

    def take(self, arrive_ms: int) -> tuple[str, int]:
        free = next((i for i in self.order if self.next[i] <= arrive_ms), None)
        chosen = free if free is not None else min(self.order, key=lambda i: (self.next[i], self.order.index(i)))
        start = max(arrive_ms, self.next[chosen])
        self.next[chosen] = start + self.interval
        return chosen, start


def pace(requests: DataFrame, identities: list[str], interval_ms: int) -> DataFrame:
    """(event_id, host, identity, start_ms) of requests (event_id, host, arrive_ms).

    Rows are dealt out by host and sorted there, then read as a stream: a worker keeps the state of one host
    only, never its rows. A host's own requests depend on each other, so they stay in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, state = None, HostPacer(identities, interval_ms)
        for batch in batches:
            who, start = [], []
            for h, arrive in zip(batch.column("host").to_pylist(), batch.column("arrive_ms").to_pylist(), strict=True):
                if h != host:
                    host, state = h, HostPacer(identities, interval_ms)
                i, s = state.take(arrive)
                who.append(i)
                start.append(s)
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("host"), pa.array(who, pa.string()), pa.array(start, pa.int64())], names=["event_id", "host", "identity", "start_ms"])

    rows = requests.select("event_id", "host", "arrive_ms").repartition("host").sortWithinPartitions("host", "arrive_ms", "event_id")
    return rows.mapInArrow(run, "event_id long, host string, identity string, start_ms long")
