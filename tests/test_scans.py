"""Scans by spans, interval and as-of joins, and the versioned upsert, against windows over whole keys and loops."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from crawlgrain.operators import ranges, scans, windows
from crawlgrain.streaming import upsert

ROWS = "event_id long, host string, ts_us long, arrive_ms long, bad boolean, good boolean, w int"


def events(spark, seed, n=500):
    dealt = random.Random(seed)
    rows = []
    for e in range(n):
        host = None if dealt.random() < 0.05 else "hot" if dealt.random() < 0.6 else f"h{dealt.randrange(5)}"
        ts = dealt.randrange(0, 4000) * 7
        bad = dealt.random() < 0.5
        rows.append((e, host, ts, ts, bad, not bad and dealt.random() < 0.2, dealt.choice([1, 2, None])))
    return spark.createDataFrame(rows, ROWS).repartition(5)


def same(a, b, columns):
    return sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.select(*columns).collect()))


@pytest.mark.parametrize("span", [50, 1000, 10**9])
def test_scans_equal_windows_over_whole_keys(spark, span):
    rows = events(spark, span % 97)
    assert same(scans.sessions(rows, ["host"], 60, span), windows.sessions(rows, ["host"], 60), ["event_id", "session"])
    got, want = (f.select("event_id", "count", F.coalesce("weight_sum", F.lit(0)).alias("w")) for f in (scans.gap_counter(rows, ["host"], 60, F.col("w"), span), windows.gap_counter(rows, ["host"], 60, F.col("w"))))
    assert same(got, want, ["event_id", "count", "w"])
    assert same(scans.pacer_schedule(rows, ["host"], 40, span), windows.pacer_schedule(rows, ["host"], 40), ["event_id", "start_ms", "wait_ms"])


@pytest.mark.parametrize("span", [100, 10**9])
def test_escalation_by_spans(spark, span):
    rows = events(spark, 31).select("event_id", "host", "ts_us", F.concat(F.lit("ip"), (F.col("event_id") % 6).cast("string")).alias("ip"), F.when(F.col("bad"), "captcha_challenge").otherwise("http_429").alias("signal_type"), F.when(F.col("good"), "AS1").otherwise("AS2").alias("asn"))
    got, want = scans.soft_ban(rows, 300, span), windows.soft_ban(rows, 300)
    assert same(got, want, ["event_id", "host_ip_count", "hosts_of_ip", "ips_of_host", "ips_of_host_asn", "backoff", "cooldown", "slowdown", "soft_limit"])


@pytest.mark.parametrize("width", [30, 500, 5000])
def test_reset_windows_by_spans(spark, width):
    rows = events(spark, width)
    at_once = F.col("w") == 2
    got = scans.failure_window(rows, ["host"], F.col("bad"), F.col("good"), width, threshold=3, at_once=at_once)
    want = windows.failure_window(rows, ["host"], F.col("bad"), F.col("good"), width, threshold=3, at_once=at_once)
    assert same(got, want, ["event_id", "failures", "triggered"])


def test_a_hot_key_is_dealt_to_several_tasks(spark):
    rows = spark.range(20000).select(F.col("id").alias("event_id"), F.lit("hot").alias("host"), (F.col("id") * 10).alias("arrive_ms"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = scans.pacer_schedule(rows, ["host"], 15, 10_000)
        sizes = sorted(r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 4 and sizes[-1] < 2 * sizes[0] and sum(sizes) == 20000
    assert done.agg(F.max("start_ms")).first()[0] == 19999 * 15


@pytest.mark.parametrize("inclusive", [True, False])
def test_as_of_join(spark, inclusive):
    dealt = random.Random(3)
    states = [(dealt.choice(["a", "b", None]), dealt.randrange(300), n, f"s{n}") for n in range(60)]
    rows = [(dealt.choice(["a", "b", "c", None]), dealt.randrange(320), e) for e in range(300)]
    got = scans.as_of(spark.createDataFrame(rows, "k string, t long, e long"), spark.createDataFrame(states, "k string, t long, n long, said string"), ["k"], "t", 25, inclusive=inclusive).collect()
    for r in got:
        before = [s for s in states if s[0] == r["k"] and (s[1] <= r["t"] if inclusive else s[1] < r["t"])]
        assert (r["state"]["said"] if r["state"] else None) == (max(before, key=lambda s: (s[1], s[2]))[3] if before else None)
    assert len(got) == 300


@pytest.mark.parametrize("small", [ranges.SMALL, 0])
def test_longest_prefix(spark, monkeypatch, small):
    monkeypatch.setattr(ranges, "SMALL", small)
    dealt = random.Random(9)
    nets = {"0.0.0.0/1", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.3", "255.255.255.255/32"}
    nets |= {f"{dealt.choice([10, 11, 200])}.{dealt.randrange(4)}.{dealt.randrange(256)}.{dealt.randrange(256)}/{dealt.randrange(9, 33)}" for _ in range(150)}
    table = spark.createDataFrame([(n,) for n in nets] + [("fe80::/10",), ("10.0.0.0/40",), (None,), ("nonsense",)], "cidr string")
    ips = [f"{dealt.choice([10, 11, 200, 90])}.{dealt.randrange(4)}.{dealt.randrange(256)}.{dealt.randrange(256)}" for _ in range(400)] + ["255.255.255.255", "0.0.0.0", "10.1.2.3", "::1", None, "300.1.1.1"]
    got = ranges.longest_prefix(spark.createDataFrame(list(enumerate(ips)), "i int, ip string"), "ip", table).collect()
    known = [(ipaddress.ip_network(n, strict=False), n) for n in nets]
    for r in got:
        try:
            at = ipaddress.IPv4Address(r["ip"] or "")
        except ValueError:
            assert r["cidr"] is None
            continue
        held = sorted((-k.prefixlen, n) for k, n in known if at in k)
        assert r["cidr"] == (held[0][1] if held else None), r
    assert len(got) == len(ips)


def test_upsert_by_batches(spark, tmp_path):
    dealt = random.Random(1)
    schema = "k string, at long, v string"
    put = upsert.upsert(f"file://{tmp_path}/t", "k", ["at"], buckets=4)
    assert upsert.read_latest(spark, f"file://{tmp_path}/t", schema).count() == 0
    every = []
    for number in range(5):
        rows = [(f"k{dealt.randrange(30)}", dealt.randrange(100), f"{number}-{i}") for i in range(20 if number else 1)]
        every += rows
        batch = spark.createDataFrame(rows, schema)
        put(batch, number)
        put(spark.createDataFrame([("k1", 999, "again")], schema), number)  # the same number again
        best = {}
        for r in every:
            best[r[0]] = max(best.get(r[0], r), r, key=lambda x: (x[1], x[1], x[0], x[2]))
        assert {tuple(r) for r in upsert.read_latest(spark, f"file://{tmp_path}/t", schema).collect()} == set(best.values())


def test_profiles_of_days_add_up(spark):
    from crawlgrain.plans import metrics

    rows = spark.range(60_000).select(
        F.concat(F.lit("h"), (F.col("id") % 2).cast("string")).alias("host"), (F.col("id") * 20_000).alias("attempted_at_ms"), F.lit("failed").alias("fetch_result"), F.lit("skipped").alias("storage_result"),
        F.sha2((F.col("id") % 7001).cast("string"), 256).alias("url_hash"), (F.col("id") * 20_000 + (F.col("id") * 7919) % 10_007).alias("finished_at_ms"),
    )
    days = metrics.daily_profiles(rows)
    assert days.count() == 28
    got = metrics.profile_estimates(metrics.merge_profiles(days)).collect()
    assert {r["host"]: (r["attempts"], r["failed"], r["stored"]) for r in got} == {"h0": (30000, 30000, 0), "h1": (30000, 30000, 0)}
    for r in got:
        latency = sorted((i * 7919) % 10_007 for i in range(60_000) if i % 2 == int(r["host"][1]))
        for name, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
            import bisect

            assert abs(bisect.bisect_left(latency, r[name]) / len(latency) - q) < 0.03
        assert abs(r["urls"] - 7001) < 0.05 * 7001
    whole = metrics.profile_estimates(metrics.merge_profiles(days.withColumn("all", F.lit(1)), "all")).first()
    assert whole["attempts"] == 60_000 and abs(whole["urls"] - 7001) < 0.05 * 7001
