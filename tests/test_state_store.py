"""Keyed state and waiting commands in the state store."""

import glob
import json
import random
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crawlgrain.operators import audit, policy, state
from crawlgrain.streaming import state as stored

OPS = "key string, at_ms long, n long, op string, fields map<string,string>, ttl long"


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(df, folder):
    return stored.one_batch(df, str(folder))


def test_state_equals_the_batch_replay_over_restarts(spark, tmp_path):
    dealt = random.Random(7)
    prefix = audit.PREFIX + ":host:"
    writes = [(f"{prefix}k{dealt.randrange(8)}", 1000 * t, t, "write", {dealt.choice("abc"): str(t)}, dealt.randrange(-3, 90)) for t in range(300)]
    reads = [(f"{prefix}k{dealt.randrange(9)}", 1000 * dealt.randrange(300), 1000 + t, "read", None, None) for t in range(100)]
    rows = sorted(writes + reads, key=lambda r: (r[1], r[2]))
    for part in (rows[:150], rows[150:170], rows[170:]):  # three runs of the query over the same checkpoint
        put(spark, part, OPS, tmp_path / "in")
        stream = spark.readStream.schema(OPS).parquet(str(tmp_path / "in"))
        found = run(stored.keyed_state(stream), tmp_path)
    got = {r["n"]: r for r in found.collect()}
    assert len(got) == 400 and {got[r[2]]["result"] for r in writes} == {"written"}
    batch = spark.createDataFrame([(k, at, n, f, ttl) for k, at, n, _, f, ttl in writes], "key string, at_ms long, n long, fields map<string,string>, ttl long")
    for k, at, n, *_ in reads[:12]:
        alive = {r["key"]: r["fields"] for r in state.alive(batch.where(f"at_ms < {at} or at_ms = {at} and n < {n}"), at).collect()}
        assert (got[n]["result"], got[n]["fields"]) == (("hit", alive[k]) if k in alive else ("miss", None))
    now = 299_000
    kept = {r["key"]: (r["fields"], r["expires_ms"]) for r in state.alive(batch, now).collect()}
    assert {r["key"]: (r["fields"], r["expires_ms"]) for r in stored.stored_state(spark, str(tmp_path / "state"), now).collect()} == kept
    keys = stored.live_keys(spark, str(tmp_path / "state"), now)
    assert state.count_prefix(keys, prefix).first()["n"] == len(kept)
    assert audit.audit(keys.limit(0), keys).first().asDict() == {"new_keys": len(kept), "out_of_prefix": 0, "forbidden": 0, "missing_ttl": 0, "passed": True}


def test_writes_that_fail_and_writing_switched_off(spark, tmp_path):
    put(spark, [("a", 0, 1, "write", {"x": "1"}, None), ("a", 1, 2, "read", None, None), (None, 2, 3, "write", {}, 5), ("b", 3, 4, "write", None, 5), ("b", 4, 5, "read", None, None)], OPS, tmp_path / "in")
    stream = spark.readStream.schema(OPS).parquet(str(tmp_path / "in"))
    got = {r["n"]: (r["result"], r["fields"]) for r in run(stored.keyed_state(stream), tmp_path / "s1").collect()}
    assert got == {1: ("failed_open", None), 2: ("miss", None), 4: ("written", None), 5: ("hit", {})}
    assert {r["result"] for r in run(stored.keyed_state(stream, enabled=False), tmp_path / "s2").where("op = 'write'").collect()} == {"disabled"}
    with pytest.raises(Exception, match="ValueError|TypeError|cannot convert"):
        run(stored.keyed_state(stream, fail_open=False), tmp_path / "s3")


def test_commands_wait_and_are_judged_again(spark, tmp_path):
    schema = "buffer string, message_id long, eligible_ms long, read_ms long, body string"
    document = {"schema_version": "1.0", "version": "v1", "generated_at": "2024-01-31T00:00:00Z", "default_policy": {}, "scope_policies": []}
    path = tmp_path / "policy.json"
    path.write_text(json.dumps(document))
    provider = policy.PolicyProvider(str(path))

    def body(m, **more):
        return json.dumps({"url": f"http://h/{m}", "canonical_url": f"http://h/{m}", "job_id": "j", "command_id": str(m)} | more)

    now = int(time.time() * 1000)
    soon, later = now + 6_000, now + 3_600_000
    rows = [("c1", 1, now - 5, now - 9, body(1)), ("c1", 2, soon, now - 1000, body(2, tier="gold")), ("c1", 3, soon, now, body(3)), ("c1", 4, soon + 1, now, body(4, deadline_at="2024-01-01T00:00:00Z")), ("c1", 5, later, now, body(5)), ("c2", 6, soon, now, body(6)), ("c2", 7, later, now - 295_000, body(7))]
    put(spark, rows, schema, tmp_path / "in")

    def go():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        return run(stored.delay_buffer(stream, capacity=3), tmp_path)

    first = {r["message_id"]: r["event"] for r in go().collect()}
    assert first == {1: "due", 2: "delayed", 3: "delayed", 4: "delayed", 5: "delayed_buffer_full", 6: "delayed", 7: "delayed"}
    sizes = {r["buffer"]: (r["n"], r["oldest_read_ms"]) for r in stored.buffer_sizes(spark, str(tmp_path / "state")).collect()}
    assert sizes == {"c1": (3, now - 1000), "c2": (2, now - 295_000)}
    path.write_text(json.dumps({**document, "version": "v2", "scope_policies": [{"scope_type": "tier", "scope_id": "gold", "policy": {"paused": True, "pause_reason": "meanwhile"}}]}))
    time.sleep(max(0, soon + 1500 - int(time.time() * 1000)) / 1000)
    put(spark, [("c9", 9, now, now, body(9))], schema, tmp_path / "in")  # a restart; a batch is what lets the timers go off
    out = go()
    events = sorted((r["message_id"], r["event"]) for r in out.where("event not in ('delayed', 'delayed_buffer_full')").collect())
    assert events == [(1, "due"), (2, "due"), (3, "due"), (4, "due"), (6, "due"), (7, "max_local_delay_exceeded"), (9, "due")]
    assert {r["buffer"]: r["n"] for r in stored.buffer_sizes(spark, str(tmp_path / "state")).collect()} == {"c2": 1}
    judged = stored.rejudge(out, provider, now)
    assert {r["message_id"]: (r["stopped_by"], r["policy_pause_reason"]) for r in judged.collect()} == {
        1: (None, None), 2: ("paused", "meanwhile"), 3: (None, None), 4: ("deadline_expired", None), 6: (None, None), 9: (None, None)
    }
    from crawlgrain.plans import attempts

    facts = attempts.terminal_attempts(judged.where("stopped_by is not null"), now, document["version"])
    assert {(r["command_id"], r["error_type"], r["error_message"]) for r in facts.collect()} == {("2", "paused", "meanwhile"), ("4", "deadline_expired", "Fetch command deadline expired before request start")}


class Counted:
    """A state variable that counts the calls to the store."""

    def __init__(self, calls):
        self.calls, self.value, self.map, self.list = calls, None, {}, []

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "updateValue", "iterator", "clear", "appendValue"):
            self.calls.append(name)
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):
        self.map[key] = value

    def iterator(self):
        return iter(self.map.items())

    def clear(self):
        self.value, self.map, self.list = None, {}, []

    def appendValue(self, value):
        self.list.append(value)


def test_store_calls_of_a_batch_do_not_grow_with_its_rows():
    calls = []
    step = stored.TtlState()
    step.fields, step.expires, step.renewals = (Counted(calls) for _ in range(3))

    def batch(first, n):
        rows = [(1000 * t, t, "write", {"abc"[t % 3]: str(t)}, 90.0) for t in range(first, first + n)] + [(1000 * (first + n), first + n, "read", None, None)]
        frame = pd.DataFrame(rows, columns=["at_ms", "n", "op", "fields", "ttl"])
        return pd.concat(list(step.handleInputRows(("k",), iter([frame[: n // 2], frame[n // 2 :]]), None)))

    out = batch(0, 25_000)
    assert out["result"].tolist() == ["written"] * 25_000 + ["hit"] and len(calls) < 20
    assert out["fields"].tolist()[-1] == {"a": "24999", "b": "24997", "c": "24998"} and out["expires_ms"].tolist()[-1] == 24_999_000 + 90_000
    out = batch(25_001, 3)  # the key is alive, so fields and renewals of the batch before stay
    assert out["result"].tolist()[-1] == "hit" and len(calls) < 40 and step.fields.map == {("a",): ("25002",), ("b",): ("25003",), ("c",): ("25001",)}
    assert [w for part in step.renewals.list for w in part[0]] == [(t, 1000 * t) for t in (*range(25_000), *range(25_001, 25_004))]
    batch(30_000, 1)  # it has expired
    assert step.fields.map == {("a",): ("30000",)} and step.renewals.list == [([(30_000, 30_000_000)],)] and step.expires.value == (30_090_000,)


def test_renewals_of_a_batch_are_one_element_of_the_stored_list(spark, tmp_path):
    for first, n in ((0, 3000), (3000, 200)):
        put(spark, [("k", 1000 * t, t, "write", {"x": str(t)}, 90) for t in range(first, first + n)], OPS, tmp_path / "in")
        run(stored.keyed_state(spark.readStream.schema(OPS).parquet(str(tmp_path / "in"))), tmp_path)
    found = [r[0] for r in stored._stored(spark, str(tmp_path / "state"), "renewed").select("list_element.value.writes").collect()]
    assert [len(w) for w in found] == [3000, 200] and [(r["n"], r["at_ms"]) for w in found for r in w] == [(t, 1000 * t) for t in range(3200)]
    assert [tuple(r) for r in stored.stored_state(spark, str(tmp_path / "state"), 3_199_000).select("key", "fields.x", "expires_ms").collect()] == [("k", "3199", 3_289_000)]


def test_operations_of_a_key_reach_the_state_as_few_rows():
    rows = [("abc"[t % 3], 1000 * t, 2**53 + t, None if t % 5 == 0 else "write", None if t % 7 == 0 else json.dumps({"x": str(t % 4), "": None}), None if t % 11 == 0 else t / 2) for t in range(20_000)]
    schema = pa.schema([("key", pa.string()), *stored.OPS])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[i : i + 5000]], schema) for i in range(0, 20_000, 5000)]
    out = pd.concat([b.to_pandas() for b in stored._pack(iter([*batches, batches[0].slice(0, 0)]))])
    assert len(out) == 3
    for key, part in out.groupby("key"):
        flat = stored._unpacked(part).astype(object)
        found = list(zip(*(flat[c].where(flat[c].notna(), None) for c in ("at_ms", "n", "op", "fields", "ttl")), strict=True))
        assert found == [(at, n, op, json.loads(f) if f else None, ttl) for k, at, n, op, f, ttl in rows if k == key]


def test_fields_and_nulls_come_back_as_they_were(spark, tmp_path):
    said = {'a"\n\u00e9\U0001f600': "\\x", "": "", "b" * 60_000: "long name", "none": None}
    rows = [("k", 0, 2**53 + 1, "write", said, 90), ("k", 1000, 2**53 + 2, "read", None, None), ("k", 2000, 2**53 + 3, None, {"z": "1"}, 5), ("k", 3000, 2**53 + 4, "write", {"z": "1"}, None), ("k", 90_000, 1, "read", None, None)]
    put(spark, rows, OPS, tmp_path / "in")
    got = run(stored.keyed_state(spark.readStream.schema(OPS).parquet(str(tmp_path / "in"))), tmp_path).orderBy("n").collect()
    assert [tuple(r) for r in got] == [
        ("k", 1, "read", "miss", None, None), ("k", 2**53 + 1, "write", "written", None, 90_000), ("k", 2**53 + 2, "read", "hit", said, 90_000),
        ("k", 2**53 + 3, None, "hit", said, 90_000), ("k", 2**53 + 4, "write", "failed_open", None, 90_000),
    ]


def test_state_store_keeps_its_state_and_no_rows(spark, sf):
    from crawlgrain.plans.queries import QUERIES
    from crawlgrain.session import shared_dir

    found = lambda: set(glob.glob(shared_dir(spark).removeprefix("file://") + "/crawlgrain/state-store-*/*"))
    before = found()
    assert QUERIES["state_store"](spark, sf).count() > 0
    assert [f.rsplit("/", 1)[1] for f in found() - before] == ["state"]
