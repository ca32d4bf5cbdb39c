import json
import random

import pytest
from pyspark.sql import functions as F

from crawlgrain.functions import commands, content, ids, net, signals, urls
from crawlgrain.operators import audit, pacing, policy, windows
from crawlgrain.plans import attempts
from crawlgrain.plans.queries import QUERIES
from crawlgrain.sources import commands as scans


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "canonical"),
    [
        ("HTTP://Example.COM:80/a/b/?b=2&a=1#x", "http://example.com/a/b?a=1&b=2"),
        ("https://example.com:443", "https://example.com"),
        ("https://example.com:8443/", "https://example.com:8443"),
        ("https://u:p@example.com/A", "https://example.com/A"),
        ("https://example.com/?q=a%20b&q=a+a&e", "https://example.com?e=&q=a+a&q=a+b"),
        ("https://example.com/?x=~*", "https://example.com?x=~%2A"),
        ("http://[::1]:80/x", "http://::1/x"),
        ("https://example.com:70000/", None),
        ("example.com/x", None),
        ("   ", None),
        (None, None),
    ],
)
def test_canonical_url(spark, raw, canonical):
    row = spark.createDataFrame([(raw,)], "u string").select(urls.canonical_url(F.col("u")).alias("c"), urls.url_error(F.col("u")).alias("e")).first()
    assert row["c"] == canonical
    assert (row["e"] is None) == (canonical is not None)


def test_attempt_id_ignores_outer_space_and_needs_both(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, ids.command_attempt_id(a, b), a=" j ", b="http://x") == one(spark, ids.command_attempt_id(a, b), a="j", b="http://x")
    assert one(spark, ids.command_attempt_id(a, b), a="  ", b="http://x") is None


def test_bounded_int(spark):
    for text, value in (("3", 3), (" +5 ", 5), ("-1", None), ("101", None), ("x", None), ("", None)):
        assert one(spark, commands.bounded_int(F.col("a")), a=text) == value


def test_signal_order(spark):
    rule = signals.response_signal(F.col("s"), F.col("b"), [("c", "human")], [("bot", "denied")])
    for status, body, said in ((429, "human", "http_429"), (200, "HUMAN", "captcha_challenge"), (200, "denied", "anti_bot_200"), (503, "x", "http_5xx"), (404, "x", "success")):
        assert one(spark, rule, s=status, b=body) == said


def test_normalize_ip(spark):
    for text, value in (("::0001", "::1"), (" 10.0.0.1 ", "10.0.0.1"), ("x", None)):
        assert one(spark, net.normalize_ip(F.col("a")), a=text) == value


def test_gzip_round_trip(spark):
    assert bytes(one(spark, content.gunzip_bytes(content.gzip_bytes(F.col("a").cast("binary"))), a="héllo")) == "héllo".encode()


def test_pacer_and_backoff(spark):
    rows = spark.createDataFrame([(1, "h", 0), (2, "h", 100), (3, "h", 9000), (4, "h", 9000)], "event_id long, host string, arrive_ms long")
    assert [r["start_ms"] for r in windows.pacer_schedule(rows, ["host"], 2000).orderBy("event_id").collect()] == [0, 2000, 9000, 11000]
    delays = spark.range(1, 5).select(windows.backoff_delay(F.col("id"), 6000, 2.0, 15000).alias("d"))
    assert [r["d"] for r in delays.collect()] == [6000, 12000, 15000, 15000]


def test_failure_window_against_a_loop(spark):
    import random

    random.seed(5)
    data, t = [], 0
    for i in range(300):
        t += random.randint(0, 40)
        data.append((i, t, random.choice("ab"), random.random() < 0.2))
    rows = spark.createDataFrame(data, "event_id long, ts_us long, k string, ok boolean")
    # ties: peers of one instant count together, so the loop looks at the whole instant
    found = {r["event_id"]: r["failures"] for r in windows.failure_window(rows, ["k"], ~F.col("ok"), F.col("ok"), 100).collect()}
    for i, ts, k, ok in data:
        mine = [x for x in data if x[2] == k]
        epoch = {x[0]: sum(y[3] for y in mine if (y[1], y[0]) <= (x[1], x[0])) for x in mine}
        assert found[i] == sum(1 for x in mine if epoch[x[0]] == epoch[i] and ts - 100 < x[1] <= ts and not x[3])


def test_policy_provider_keeps_the_last_good(tmp_path):
    path = tmp_path / "p.json"
    provider = policy.PolicyProvider(str(path))
    assert provider.current()["version"] == "bootstrap" and provider.result == "read_error" and not provider.last_known_good_active
    good = {"schema_version": "1.0", "version": "v1", "generated_at": "2024-01-31T00:00:00Z", "default_policy": {"max_retries": 1}, "scope_policies": []}
    path.write_text(json.dumps(good))
    assert provider.current()["version"] == "v1" and provider.result == "success"
    assert provider.current()["version"] == "v1" and provider.result == "not_modified"
    path.write_text(json.dumps({**good, "version": "v2", "default_policy": {"max_retries": True}}))
    import os

    os.utime(path, ns=(1, 1))
    for _ in range(3):  # as long as the broken document lies there, each look finds it
        assert provider.current()["version"] == "v1" and provider.result == "validation_error" and provider.last_known_good_active
    path.write_text("{no json")
    for _ in range(2):
        assert provider.current()["version"] == "v1" and provider.result == "validation_error" and provider.last_known_good_active
    path.write_text(json.dumps({**good, "version": "v3"}))
    assert provider.current()["version"] == "v3" and provider.result == "success" and not provider.last_known_good_active
    path.write_text(json.dumps(good))
    os.utime(path, ns=(5, 5))
    assert provider.current()["version"] == "v1"
    path.unlink()
    assert provider.current()["version"] == "v1" and provider.result == "read_error"


def test_policy_errors():
    bad = {"schema_version": "2", "version": " ", "default_policy": {"x": 1, "max_retries": 101}, "scope_policies": [{"scope_type": "tier", "scope_id": "a", "policy": {}}] * 2}
    assert policy.document_errors(bad) == sorted(["schema_version", "version", "generated_at", "default_policy.x", "default_policy.max_retries", "scope_policies[1] repeats ('tier', 'a')"])


def test_identity_maps(spark, tmp_path):
    (tmp_path / "a.csv").write_text("private_ip,public_ip\n10.0.0.1,1.1.1.1\n")
    (tmp_path / "b.csv").write_text("10.0.0.1,1.1.1.1\n")
    (tmp_path / "c.json").write_text('[{"bind_ip": "10.0.0.1", "public_ip": "1.1.1.1"}]')
    (tmp_path / "d.json").write_text('{"10.0.0.1": "1.1.1.1"}')
    for name, kind in (("a.csv", "csv"), ("b.csv", "csv-plain"), ("c.json", "json"), ("d.json", "json")):
        assert [tuple(r) for r in scans.read_identity_map(spark, str(tmp_path / name), kind).collect()] == [("10.0.0.1", "1.1.1.1")]


def test_seeds_and_objects(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# no\n\n http://a \nhttp://b\n")
    assert [r["url"] for r in scans.read_seeds(spark, str(tmp_path / "s.txt")).collect()] == ["http://a", "http://b"]
    assert [r["url"] for r in scans.inline_seeds(spark, "x, ,y").collect()] == ["x", "y"]
    rows = spark.createDataFrame([("k1", "body"), ("k2", "")], "storage_key string, body string")
    scans.write_objects(rows, str(tmp_path / "o"))
    assert all(r["ok"] for r in scans.verify_objects(spark, str(tmp_path / "o")).collect())


def test_repeat_seeds_replays_every_page(spark, tmp_path):
    spark.range(45).select((F.col("id") * 7 % 90).alias("page_id"), F.lit("http://a").alias("url"), F.lit("").alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    ids_there = sorted(k * 7 % 90 for k in range(45))
    got = [tuple(r) for r in QUERIES["repeat_seeds"](spark, str(tmp_path)).collect()]
    assert got == [(r, k) for r in range(3) for k in ids_there][:100]


def test_escapes_are_decoded_one_by_one(spark):
    rows = [("http://e.org/?a=%20%zz", "http://e.org?a=+%25zz"), ("http://e.org/?b=%41%4&a=%", "http://e.org?a=%25&b=A%254")]
    df = spark.createDataFrame(rows, "url string, there string").select(urls.canonical_url(F.col("url")).alias("found"), "there")
    assert all(r["found"] == r["there"] for r in df.collect())


def test_captcha_marks_count_in_bytes(spark):
    rows = [("é" * 60000 + "captcha", True), ("é" * 70000 + "captcha", False), ("x" * 131000 + "hcaptcha", True)]
    df = spark.createDataFrame(rows, "body string, there boolean").select(content.contains_captcha(F.lit("text/html"), F.col("body")).alias("found"), "there")
    assert all(r["found"] == r["there"] for r in df.collect())


def test_soft_ban_against_a_loop(spark):
    """Counters by signal type with sliding expiry; cross-dimension ones for challenge pages only."""
    random.seed(4)
    gap = 1000
    rows, at = [], 0
    for i in range(400):
        at += random.choice([1, 50, 200, 900, 1500])
        rows.append((i, at, f"h{random.randint(0, 2)}", f"i{random.randint(0, 4)}", random.choice(["http_429", "captcha_challenge", "anti_bot_200"]), f"AS{random.randint(1, 2)}"))
    state, there = {}, {}

    def counter(key, member, now):
        members, last = state.get(key, ([], None))
        members = [] if last is None or now - last > gap else members
        members = [*members, member]
        state[key] = (members, now)
        return members

    for i, now, host, ip, kind, asn in rows:
        backoff = len(counter(("own", host, ip, kind), i, now)) >= 2
        said = [False] * 3
        if kind != "http_429":
            said = [len(set(counter(k, m, now))) >= 3 for k, m in ((("ip", ip, kind), host), (("host", host, kind), ip), (("asn", host, asn, kind), ip))]
        there[i] = (backoff, *said)
    df = spark.createDataFrame(rows, "event_id long, ts_us long, host string, ip string, signal_type string, asn string")
    found = {r["event_id"]: (r["backoff"], r["cooldown"], r["slowdown"], r["soft_limit"]) for r in windows.soft_ban(df, gap).collect()}
    assert found == there


def test_blacklist_is_armed_anew(spark):
    rows = [(1, 0, True), (2, 1000, False), (3, 1700, True), (4, 1900, False), (5, 3400, False), (6, 3600, False)]
    df = spark.createDataFrame(rows, "event_id long, ts_us long, triggered boolean").withColumn("host", F.lit("h"))
    found = [r["blacklisted"] for r in windows.blacklist(df, ["host"], 1800).orderBy("event_id").collect()]
    assert found == [True, True, True, True, True, False]


def test_audit_of_keys(spark):
    p = audit.PREFIX
    after = spark.createDataFrame([(f"{p}:host_ip:1", 5), (f"{p}:host_ip:2", None), (f"{p}:profile:1", None), ("other:x", None), ("extra:y", 3), ("old", 1)], "key string, ttl long")
    before = spark.createDataFrame([("old",)], "key string")
    row = audit.audit(before, after, extra_prefixes=("extra:",)).first()
    assert tuple(row) == (5, 2, 1, 1, False)


def test_fact_rules(spark):
    base = dict.fromkeys(attempts.COLUMNS)
    good = base | {"schema_version": "1.0", "attempt_id": "a", "url_hash": "0" * 64, "canonical_url": "c", "original_url": "o", "host": "h", "attempted_at": "t", "finished_at": "t",
                   "fetch_result": "succeeded", "content_result": "html_snapshot_candidate", "storage_result": "stored", "snapshot_id": "s", "storage_provider": "oci", "bucket": "b",
                   "storage_key": "k", "compression": "gzip", "content_sha256": "a" * 64}
    wrong = [{}, {"schema_version": "9"}, {"content_sha256": "XYZ"}, {"snapshot_id": ""}, {"content_sha256": None}, {"storage_provider": "s3"}]
    schema = ", ".join(f"{c} {'int' if c == 'status_code' else 'string'}" for c in attempts.COLUMNS)
    df = spark.createDataFrame([tuple((good | w)[c] for c in attempts.COLUMNS) for w in wrong], schema)
    found = [r[0] for r in df.select(attempts.violations(df)).collect()]
    assert found == [[], ["bad schema_version"], ["bad content_sha256"], ["stored without snapshot_id"], ["stored without content_sha256"], ["bad storage_provider"]]


def test_policy_documents_as_they_come():
    good = {"schema_version": "1.0", "version": "v", "generated_at": "2026-01-01T00:00:00Z", "default_policy": {"pause_reason": "maintenance", "egress_selection_strategy": "sticky_pool"}, "scope_policies": None}
    assert policy.document_errors(good) == []
    assert policy.document_errors({k: v for k, v in good.items() if k != "generated_at"}) == ["generated_at"]
    assert policy.document_errors(good | {"default_policy": {"pause_reason": " "}}) == ["default_policy.pause_reason"]
    assert policy.document_errors(good | {"scope_policies": {}}) == []
    assert policy.document_errors(good | {"scope_policies": {"a": 1}}) == ["scope_policies"]


def test_policy_lookups_agree(spark, monkeypatch):
    """Broadcast lookups and the joined form decide the same."""
    document = {"scope_policies": [{"scope_type": "tier", "scope_id": "gold", "policy": {"max_retries": 1}}, {"scope_type": "host_id", "scope_id": "h1", "policy": {"paused": True}}]}
    rows = spark.createDataFrame([(1, "gold", None), (2, "gold", "h1"), (3, " ", "h2"), (4, None, "h1")], "k long, tier string, host_id string")
    some = sorted(map(tuple, policy.decide(rows, policy.scope_table(spark, document), policy.BOOTSTRAP, "k").collect()), key=lambda r: r[0])
    monkeypatch.setattr(policy, "SMALL", 0)
    assert sorted(map(tuple, policy.decide(rows, policy.scope_table(spark, document), policy.BOOTSTRAP, "k").collect()), key=lambda r: r[0]) == some
    assert [r[-2] for r in some] == ["tier", "host_id", "default", "host_id"]


def test_pacing_of_several_identities_against_a_loop(spark):
    random.seed(3)
    who, rows, at = ["a", "b", "c"], [], 0
    for i in range(200):
        at += random.choice([0, 10, 500, 3000])
        rows.append((i, f"h{i % 3}", at))
    free, there = {}, {}
    for i, host, arrive in rows:
        starts = [max(arrive, free.get((host, w), arrive)) for w in who]
        there[i] = min(starts)
        free[host, who[starts.index(min(starts))]] = min(starts) + 1000
    found = {r["event_id"]: r["start_ms"] for r in pacing.pace(spark.createDataFrame(rows, "event_id long, host string, arrive_ms long"), who, 1000).collect()}
    assert found == there


def test_wrapped_commands_and_generation(spark):
    lines = [
        '{"url": "http://a/", "job_id": "outer", "payload": "{\\"url\\": \\"http://b/\\", \\"job_id\\": \\"inner\\", \\"canonical_url\\": \\"http://b\\", \\"max_retries\\": 3}"}',
        '{"url": "http://a/", "payload": {"url": "http://c/", "job_id": "j"}}',
        '{"url": "http://a/", "payload": "[1]"}',
        '{"url": "http://a/", "payload": "{broken"}',
        '{"url": "http://d/", "job_id": "plain"}',
    ]
    got = scans.parse_jsonl(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["url"], r["job_id"], r["max_retries"], r["error"]) for r in got] == [
        ("http://b/", "inner", "3", None), ("http://c/", "j", None, None), (None, None, None, "payload must be a JSON object"), (None, None, None, "invalid payload json"), ("http://d/", "plain", None, None)
    ]
    seeds = spark.createDataFrame([(i, u) for i, u in enumerate(["HTTP://A-b.example:80/x/", "nonsense"])], "n int, url string")
    made = scans.generate_commands(seeds, F.col("n"), "j", "p", politeness_prefix="host:", host_id_prefix="h_", deadline_at="2030-01-01T00:00:00Z", max_retries=4).orderBy("command_id").collect()
    assert tuple(made[0]) == ("p:00000001", "j", "HTTP://A-b.example:80/x/", "http://a-b.example/x", "h_a_b_example", "host:a-b.example", "2030-01-01T00:00:00Z", 4)
    assert made[1]["canonical_url"] is None and made[1]["politeness_key"] is None
    wire = scans.wire_fields(spark.createDataFrame([(1, None, {"a": None}, [1, None], (True, "x"))], "i int, n string, m map<string,int>, l array<int>, s struct<b:boolean,t:string>")).first()["fields"]
    assert wire == {"i": "1", "n": "", "m": '{"a":null}', "l": "[1,null]", "s": '{"b":true,"t":"x"}'}
    twice = spark.createDataFrame([("j", "u"), ("j", "u"), ("j", "v"), (" ", "u"), (" ", "u"), ("j", None), ("j", None)], "job_id string, canonical_url string")
    assert [tuple(r) for r in scans.duplicates(twice).collect()] == [("j", "u", 2)]


def test_commands_are_numbered_whatever_the_size_of_their_ranges(spark):
    """Ranges of url rows are joined to others than ranges of order alone: 1 KB and 8 bytes a row."""
    n = 20_000
    seeds = spark.range(n).repartition(4).select("id", F.concat(F.lit("http://h/"), "id", F.lit("?x="), *[F.sha2(F.concat("id", F.lit(f"/{i}")), 256) for i in range(16)]).alias("url"))
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        made = scans.generate_commands(seeds, F.col("id"), "j", "p").select("command_id", F.regexp_extract("url", r"h/([0-9]+)", 1).cast("long").alias("id")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["id"], r["command_id"]) for r in made) == [(i, f"p:{i + 1:08d}") for i in range(n)]


def test_backoff_goes_back_after_a_success(spark):
    rng = random.Random(4)
    rows = [(n, rng.randrange(3), rng.randrange(0, 400_000_000_000, 1_000_000), rng.random() < 0.3) for n in range(400)]
    got = windows.backoff_schedule(spark.createDataFrame(rows, "event_id int, host int, ts_us long, ok boolean"), ["host"], success=F.col("ok")).collect()
    state = {}
    wanted = {}
    for n, host, us, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        last, level, until = state.get(host, (None, 0, None))
        if last is not None and us - last > 86_400_000_000:
            level, until = 0, None
        if ok:
            level, delay = 0, None
        else:
            level += 1
            delay = min(int(5000 * 2.0 ** (level - 1)), 300_000)
            until = us // 1000 + delay
        state[host] = (us, level, until)
        wanted[n] = (level, delay, until)
    assert {r["event_id"]: (r["level"], r["delay_ms"], r["next_allowed_ms"]) for r in got} == wanted
    waits = spark.range(2000).select(windows.jitter(500, F.col("id")).alias("a"), windows.jitter(500, F.col("id")).alias("b"), windows.jitter(0).alias("c"), windows.jitter(9).alias("d")).collect()
    assert all(r["a"] == r["b"] and 0 <= r["a"] <= 500 and r["c"] == 0 and 0 <= r["d"] <= 9 for r in waits) and len({r["a"] for r in waits}) > 400


def test_gates_in_order(spark):
    rows = [(True, True, None, "STICKY_POOL", None), (False, False, None, None, "x"), (False, True, "2024-01-01T00:00:00Z", None, None), (False, True, None, "STICKY_POOL", None), (False, True, None, "ROUND_ROBIN", None), (False, True, None, None, "x")]
    df = spark.createDataFrame(rows, "p boolean, e boolean, d string, s string, i string").withColumn("n", F.monotonically_increasing_id())
    got = df.orderBy("n").select(policy.gate(F.col("p"), F.col("e"), F.col("d"), 1_706_659_200_000, F.col("s"), F.col("i")).alias("x")).collect()
    assert [r["x"] for r in got] == ["paused", "paused", "deadline_expired", "egress_unavailable", None, None]


def test_compressed_size_of_facts(spark, sf):
    from crawlgrain.plans import attempts
    from crawlgrain.sources import fixtures

    facts = attempts.crawl_attempts(fixtures.fetch_results(spark, sf), compress=True)
    rows = facts.select("content_result", "compressed_size", "uncompressed_size").collect()
    assert all((r["compressed_size"] is None) == (r["content_result"] != "html_snapshot_candidate") for r in rows)
    assert all(0 < r["compressed_size"] < r["uncompressed_size"] for r in rows if r["compressed_size"])


def test_settings(tmp_path):
    from crawlgrain import settings

    given = {"A": " x, ,y ,", "N": "7", "E": "", "T": "Yes", "F": "no"}
    assert settings.listed(given, "A") == ["x", "y"] and settings.listed(given, "none", "a,b") == ["a", "b"] and settings.listed(given, "E") == []
    assert settings.whole(given, "N", 1) == 7 and settings.whole(given, "E", 3) == 3 and settings.whole(given, "none", 4) == 4
    with pytest.raises(ValueError):
        settings.whole(given, "T", 1)
    assert settings.switch(given, "T", False) and not settings.switch(given, "F", True) and settings.switch(given, "none", True) and not settings.switch(given, "E", True) and settings.switch({"B": True}, "B", False)
    assert settings.flush_seconds(0, 30_000) == 30.0 and settings.flush_seconds(200, 30_000) == 1.0 and settings.flush_seconds(2500, 1) == 2.5
    (tmp_path / "ca").write_text("")
    assert settings.certificates(str(tmp_path / "ca"), ["/none"]) == str(tmp_path / "ca")
    assert settings.certificates("/gone", ["/none", str(tmp_path / "ca")]) == str(tmp_path / "ca")
    assert settings.certificates("/gone", ["/none"]) == "/gone" and settings.certificates("", ["/none"]) == "/none"
    assert settings.password_in_address("p@ss/w:rd é~") == "p%40ss%2Fw%3Ard%20%C3%A9~"


def test_fingerprints_and_exposition(spark):
    from crawlgrain.plans import metrics

    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "n int, t string")
    assert audit.unchanged(rows, rows.orderBy(F.desc("n")).repartition(3)).first().asDict() == {"n_before": 3, "n_after": 3, "same_length": True, "same_rows": True}
    assert audit.unchanged(rows, spark.createDataFrame([(1, "a"), (2, None), (2, None)], "n int, t string")).first()["same_rows"] is False
    assert audit.fingerprint(rows.limit(0)).first().asDict() == {"n": 0, "digest": "0"}
    lines = metrics.exposition(spark.createDataFrame([('q"uo\\te\nx', None, 3), ("a", "b", 1)], "k string, l string, value long"), "m_total", "counter", "text").orderBy("line_no").collect()
    assert [r["line"] for r in lines] == ["# HELP m_total text", "# TYPE m_total counter", 'm_total{k="a",l="b"} 1', 'm_total{k="q\\"uo\\\\te\\nx",l=""} 3']
