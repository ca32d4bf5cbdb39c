"""Decoding, names and state against plain Python."""

import random

from pyspark.sql import functions as F

from crawlgrain.functions import runtime
from crawlgrain.operators import state


def test_bytes_as_text(spark):
    dealt = random.Random(3)
    raw = [b"", b"\xef\xbf\xbd", b"caf\xc3\xa9\xff", b"\xe2\x28\xa1", b"\xf0\x9f\x98", b"\xed\xa0\x80x"]
    raw += [bytes(dealt.choice(b"a\xc3\xa9\xe2\x82\xac\xf0\x9f\x98\x80\xff\n") for _ in range(dealt.randrange(12))) for _ in range(300)]
    rows = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raw)], "i long, r binary")
    found = rows.select("i", runtime.readable(F.col("r")).alias("a"), runtime.replaced(F.col("r")).alias("b")).collect()
    assert {r["i"]: r["a"] for r in found} == {i: r.decode("utf-8", "ignore") for i, r in enumerate(raw)}
    assert {r["i"]: r["b"] for r in found} == {i: r.decode("utf-8", "replace") for i, r in enumerate(raw)}


def test_request_context(spark):
    got = spark.range(1).select(runtime.request_context({"job_id": F.lit("j"), "deliveries": F.lit(0)}).alias("c")).first()["c"].asDict()
    assert len(got) == 16 and got["candidate"] is True and got["job_id"] == "j" and got["deliveries"] == 0 + 1 and got["tier"] is None


def test_state_against_a_loop(spark):
    """Writes that renew, merge and come after the end of a key's life."""
    dealt = random.Random(5)
    writes = [(f"k{dealt.randrange(6)}", 1000 * dealt.randrange(400), n, {dealt.choice("abc"): str(n)} if n % 9 else {}, dealt.randrange(-5, 60)) for n in range(200)]
    rows = spark.createDataFrame(writes, "key string, at_ms long, n long, fields map<string,string>, ttl long")
    now, held = 380_000, {}
    for key, at, _, fields, ttl in sorted(writes, key=lambda w: w[1:3]):
        if at <= now:
            old = held.get(key, ({}, 0))
            held[key] = ((old[0] if old[1] > at else {}) | fields, at + 1000 * max(1, min(ttl, 86_400)))
    found = {r["key"]: (r["fields"], r["expires_ms"]) for r in state.alive(rows, now).collect()}
    assert found == {k: v for k, v in held.items() if v[1] > now}
