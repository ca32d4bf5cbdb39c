"""The library's own queries over the driver's tables; each has its DuckDB twin in oracles.py."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgrain.functions import commands, content, ids, net, runtime, signals, sql, urls
from crawlgrain.operators import audit, egress, pacing, policy, ranges, state, windows
from crawlgrain.operators import scans as scans_by_span
from crawlgrain.plans import attempts, metrics
from crawlgrain.session import written
from crawlgrain.sources import commands as scans
from crawlgrain.sources import connectors, fixtures
from crawlgrain.streaming import commands as stream
from crawlgrain.streaming import monitor
from crawlgrain.streaming import state as stored
from crawlgrain.streaming import upsert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHALLENGES, BOTS = signals.parse_patterns("challenge:verify you are human"), signals.parse_patterns("bot:bot filter")
W = windows.WINDOW_US
POLICY = {
    "schema_version": "1.0", "version": "v1", "generated_at": "2024-01-31T00:00:00Z", "default_policy": {**policy.BOOTSTRAP, "host_ip_jitter_ms": 0},
    "scope_policies": [
        {"scope_type": "policy_scope_id", "scope_id": "scope-paused", "policy": {"paused": True, "pause_reason": "maintenance"}},
        {"scope_type": "tier", "scope_id": "gold", "policy": {"max_retries": 1}},
        {"scope_type": "tier", "scope_id": "bulk", "policy": {"sticky_pool_size": 2}},
    ],
}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.table(spark, d, "pages")


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).withColumn("canonical_url", urls.canonical_url(F.col("url")))
    return rows.withColumn("host", urls.host(F.col("canonical_url"))).withColumn("url_hash", urls.url_hash(F.col("canonical_url")))


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    return attempts.crawl_attempts(fixtures.fetch_results(spark, d))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.signals(spark, d)
    return rows.withColumn("signal_type", signals.response_signal(F.col("status_code"), F.col("body"), CHALLENGES, BOTS))


def _challenges(spark: SparkSession, d: str) -> DataFrame:
    rows = _signals(spark, d).where(F.col("signal_type").isin(signals.CHALLENGES)).select("event_id", "ts_us", "host", "ip", "signal_type")
    return rows.join(F.broadcast(fixtures.identities(spark).select(F.col("bind_ip").alias("ip"), "asn")), "ip")  # eight rows


def _identities(spark: SparkSession) -> DataFrame:
    rows = fixtures.identities(spark)
    return rows.withColumn("identity", F.coalesce("public_ip", "bind_ip"))


# --- identities of URLs and attempts ----------------------------------------------------------


@query
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).select("page_id", "canonical_url", "url_hash", "host", urls.request_host(F.col("url")).alias("request_host"), urls.url_error(F.col("url")).alias("error"))


@query
def canonical_url_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Page URLs made awkward: upper case, default ports, user information, unsorted queries."""
    c = F.concat
    rows = _pages(spark, d).select("page_id", F.regexp_replace("url", r"^[a-z]+://", "").alias("rest"))
    variant = (
        F.when(F.col("page_id") % 4 == 0, c(F.lit("  HTTP://user:pw@"), F.regexp_replace("rest", r"^([^/]*)", "$1:80"), F.lit("  ")))
        .when(F.col("page_id") % 4 == 1, c(F.lit("https://"), F.upper(F.substring_index("rest", "/", 1)), F.lit(":8443/A//?b=2&a=1&&c#frag")))
        .when(F.col("page_id") % 4 == 2, c(F.lit("https://"), F.substring_index("rest", "/", 1), F.lit(":70000/")))
        .otherwise(c(F.lit("//"), F.col("rest")))
    )
    return rows.select("page_id", urls.canonical_url(variant).alias("canonical_url"), urls.url_error(variant).alias("error"))


@query
def url_identity(spark: SparkSession, d: str) -> DataFrame:
    rows = _canonical(spark, d)
    return rows.select(
        "page_id", F.col("url_hash").alias("dedupe_key"), ids.attempt_id(F.col("url_hash"), F.lit(fixtures.NOW_MS)).alias("attempt_id"),
        ids.command_attempt_id(F.lit(" job_1 "), F.col("canonical_url")).alias("command_attempt_id"), ids.stable_hash(F.col("host"), "salt").alias("host_hash"),
        ids.pair_hash(F.col("host"), F.lit("10.0.0.2")).alias("host_ip_hash"), ids.host_key(F.col("host")).alias("host_key"), ids.host_token(F.col("host")).alias("host_token"),
        ids.download_slot(F.col("host"), F.lit("10.0.0.2")).alias("slot"),
    )


@query
def url_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.fetch_results(spark, d).select("result_id", "page_id", "url")
    return attempts.url_dedupe(rows, urls.url_hash(urls.canonical_url(F.col("url"))), "result_id").select("page_id", "result_id")


@query
def storage_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = _canonical(spark, d).withColumn("ms", F.lit(1704067200000) + F.col("page_id") * 86_400_123)
    snapshot = ids.snapshot_id(F.col("url_hash"), F.col("ms"))
    return rows.select("page_id", snapshot.alias("snapshot_id"), ids.storage_key(F.col("url_hash"), F.col("host"), snapshot, F.col("ms")).alias("storage_key"), ids.iso_z(F.col("ms")).alias("fetched_at"))


# --- content ----------------------------------------------------------------------------------


@query
def content_artifact(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("html").cast("binary")
    return _pages(spark, d).select("page_id", F.sha2(body, 256).alias("content_sha256"), F.octet_length(body).cast("long").alias("uncompressed_size"))


@query
def content_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.fetch_results(spark, d)
    body = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("<p>Please VERIFY you are human</p>"), "html")).otherwise(F.col("html"))
    return rows.select(
        "result_id", content.is_html(F.col("content_type")).alias("is_html"), content.contains_captcha(F.col("content_type"), body).alias("captcha"), content.failure_reason(F.col("status_code")).alias("failure_reason"),
    )


def _links(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    extra = F.array(F.when(p % 4 == 0, "https://ext.example.net/x"), F.when(p % 5 == 0, "mailto:a@b"), F.when(p % 7 == 0, "//cdn.example.org/y"))
    return _pages(spark, d).select("page_id", "url", F.concat(content.hrefs(F.col("html")), F.filter(extra, lambda x: x.isNotNull())).alias("links"))


@query
def outlink_records(spark: SparkSession, d: str) -> DataFrame:
    return attempts.outlink_records(_links(spark, d))


@query
def outlink_counts(spark: SparkSession, d: str) -> DataFrame:
    return outlink_records(spark, d).groupBy("page_id").agg(F.count("*").alias("links"), F.count_if("external").alias("external"))


@query
def response_headers(spark: SparkSession, d: str) -> DataFrame:
    given = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("X-Other"), F.lit("1"), F.lit("SERVER"), F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")))
    kept = content.kept_headers(given)
    return _pages(spark, d).select("page_id", F.element_at(kept, "content-type").alias("content_type"), F.try_element_at(kept, F.lit("server")).alias("server"), F.size(kept).cast("long").alias("n"))


#: Before each page: a link in a comment and one in a script, which are none, then one without quotes, one with references, one elsewhere.
AWKWARD = "concat('<!-- <a href=\"/no\"> --><script>\"<a href=/no>\"</script><A class=a HREF=/u', page_id, '?a=1&amp;b=2>x</A><a title=\"href=/no\" href=\\'../r&#x41;\\'><a href=\"//CDN.example.org/y\"><a href=mailto:a@b>', html)"


@query
def link_targets(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages as a browser reads them, in SQL functions."""
    return _pages(spark, d).select("page_id", F.posexplode(content.hrefs(F.expr(AWKWARD))).alias("pos", "href"))


@query
def sql_outlinks(spark: SparkSession, d: str) -> DataFrame:
    """The table function in plain SQL: links resolved against their page."""
    sql.register(spark)
    return spark.sql(f"select p.page_id, l.* from {{pages}} p, lateral crawl_outlinks({AWKWARD}, p.url) l", pages=_pages(spark, d))


@query
def sql_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules under their SQL names in plain SQL."""
    sql.register(spark)
    return spark.sql(
        """select page_id, crawl_canonical_url(url) as canonical_url, crawl_url_hash(url) as url_hash, crawl_url_host(url) as host, crawl_host_bucket(crawl_url_host(url), 8) as bucket,
         crawl_attempt_id('job_1', crawl_canonical_url(url)) as attempt_id, crawl_outcome(cast(400 + page_id % 60 as int), false, 1, 0) as outcome, size(crawl_hrefs(html)) as links from {pages}""",
        pages=_pages(spark, d),
    )


# --- commands ---------------------------------------------------------------------------------


@query
def command_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.commands(spark, d)
    c = {f: F.col(f) if f in rows.columns else F.lit(None).cast("string") for f in commands.FIELDS}
    return rows.select("command_no", commands.command_error(c).alias("error"), commands.has_context(c).alias("has_context"))


@query
def command_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Commands of one job and canonical URL, named more than once: deliveries, and links to a page under another scheme's default port."""
    rows = fixtures.commands(spark, d).where("url is not null").select(F.trim("job_id").alias("job_id"), urls.canonical_url(F.regexp_replace("url", r"^(https?://[^/?#:]+)/", "$1:443/")).alias("with_port"), urls.canonical_url(F.col("url")).alias("plain"))
    rows = rows.select("job_id", F.explode(F.array("with_port", "plain")).alias("canonical_url"))
    return scans.duplicates(rows)


@query
def stream_responses(spark: SparkSession, d: str) -> DataFrame:
    """Commands in the nested form of a stream's answers, taken apart and judged; every third one is wrapped."""
    rows = fixtures.commands(spark, d)
    n = F.col("command_no")
    own = F.map_filter(F.create_map(F.lit("url"), F.col("url"), F.lit("job_id"), F.col("job_id"), F.lit("canonical_url"), F.col("canonical_url"), F.lit("deadline_at"), F.col("deadline_at"), F.lit("max_retries"), F.col("max_retries")), lambda _, v: v.isNotNull())
    fields = F.when(n % 3 == 0, F.create_map(F.lit("url"), F.lit("outer"), F.lit("payload"), F.to_json(own))).otherwise(own)
    message = F.struct(n.cast("string").alias("id"), F.when(n % 2 == 0, n % 5).alias("deliveries"), fields.alias("fields"))
    nested = rows.groupBy(F.pmod(n, F.lit(16)).alias("b"), F.concat(F.lit("commands-"), (n % 2).cast("string")).alias("stream")).agg(F.collect_list(message).alias("messages"))
    answers = nested.groupBy("b").agg(F.collect_list(F.struct("stream", "messages")).alias("responses"))
    return scans.flatten_responses(answers).select("stream", "message_id", "deliveries", "error")


@query
def read_only_audit(spark: SparkSession, d: str) -> DataFrame:
    """Commands before and after a run that must not change them: in another order, and with one row altered by another."""
    rows = fixtures.commands(spark, d)
    again = rows.repartition(7, "tier").select(*reversed(rows.columns))
    altered = rows.withColumn("tier", F.when(F.col("command_no") == 10, "x").otherwise(F.col("tier")))
    kinds = [("same", again), ("altered", altered), ("grown", rows.unionByName(rows.where("command_no < 100")))]
    return reduce(DataFrame.unionByName, (audit.unchanged(rows, f).withColumn("kind", F.lit(k)) for k, f in kinds))


@query
def metric_lines(spark: SparkSession, d: str) -> DataFrame:
    """A counter as a scraper reads it."""
    return metrics.exposition(metric_requests(spark, d), "requests_total", "counter", "Requests by host, status and egress address")


@query
def command_generation(spark: SparkSession, d: str) -> DataFrame:
    return scans.generate_commands(_pages(spark, d), F.col("page_id"), "job_1", "seed").select("command_id", "job_id", "url")


@query
def command_wire_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.commands(spark, d).select("command_no", "url", "deadline_at", "tier")
    f = scans.wire_fields(rows)
    return f.select(F.element_at("fields", "command_no").alias("command_no"), F.element_at("fields", "deadline_at").alias("deadline_at"), F.element_at("fields", "tier").alias("tier"), F.size("fields").cast("long").alias("n"))


@query
def command_jsonl(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    line = F.when(p % 5 == 0, "not json").when(p % 5 == 1, "   ").when(p % 5 == 2, "[1]").otherwise(F.to_json(F.struct("url", F.concat(F.lit("job_"), p.cast("string")).alias("job_id"))))
    rows = scans.parse_jsonl(_pages(spark, d).select(line.alias("value")))
    return rows.select("url", "job_id", "error")


@query
def seed_scan(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    line = F.when(p % 5 == 0, F.concat(F.lit("# "), "url")).when(p % 5 == 1, "  ").otherwise(F.concat(F.lit("  "), "url", F.lit(" ")))
    return scans.seed_lines(_pages(spark, d).select(line.alias("value")))


@query
def repeat_seeds(spark: SparkSession, d: str) -> DataFrame:
    return scans.repeat_seeds(_pages(spark, d).select("page_id", "url"), F.col("page_id"), 3, 100).select("round", "page_id")


@query
def pending_reclaim(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.fetch_results(spark, d).select(F.col("result_id").alias("message_id"), F.col("deliveries").cast("long").alias("deliveries"), ((F.col("result_id") * 7919) % 1_200_000).alias("idle_ms"))
    return scans.enough_idle(rows, 600_000)


@query
def delivery_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.fetch_results(spark, d)
    known = rows.where("result_id % 3 <> 0").select(F.col("result_id").alias("message_id"), F.col("deliveries").cast("long").alias("deliveries"))
    return scans.delivery_counts(rows.select(F.col("result_id").alias("message_id")), known, 3).select("message_id", F.col("deliveries").cast("long").alias("deliveries"))


@query
def command_payload(spark: SparkSession, d: str) -> DataFrame:
    """Wrapped commands: the payload's fields replace the row's own, which say nothing here."""
    p = F.col("page_id")
    whole = F.to_json(F.struct("url", F.concat(F.lit("job_"), p.cast("string")).alias("job_id"), F.col("url").alias("canonical_url"), (p % 7).alias("max_retries"), F.lit("gold").alias("tier")))
    payload = F.when(p % 5 == 0, "not json").when(p % 5 == 1, " [1] ").when(p % 5 == 2, '{"url": null, "job_id": "x"}').when(p % 5 == 3, whole)
    rows = commands.unwrap(_pages(spark, d).select("page_id", payload.alias("payload"), F.lit("http://own.example/").alias("url"), F.lit("own").alias("job_id"), F.lit("http://own.example/").alias("canonical_url")))
    error = F.coalesce("payload_error", commands.command_error({f: F.col(f) for f in commands.FIELDS}))
    return rows.select("page_id", "url", "job_id", "tier", commands.bounded_int(F.col("max_retries")).cast("long").alias("max_retries"), error.alias("error"))


# --- policy -----------------------------------------------------------------------------------


def _decided(spark: SparkSession, d: str) -> DataFrame:
    return policy.decide(fixtures.fetch_results(spark, d), policy.scope_table(spark, POLICY), POLICY["default_policy"], "result_id")


@query
def policy_decision(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("result_id", "matched_scope_type", "matched_scope_id", "policy_paused", "policy_max_retries", "policy_sticky_pool_size", "policy_host_ip_min_delay_ms")


@query
def policy_gate(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("result_id", policy.gate(F.col("policy_paused"), F.col("policy_enabled"), F.col("deadline_at"), fixtures.NOW_MS).alias("stopped_by"))


@query
def retry_routing(spark: SparkSession, d: str) -> DataFrame:
    allowed = F.coalesce("cmd_max_retries", "policy_max_retries", F.lit(2))
    return _decided(spark, d).select("result_id", policy.outcome(F.col("status_code"), F.col("fetch_failed"), F.col("deliveries"), allowed).alias("outcome"))


# --- egress -----------------------------------------------------------------------------------


@query
def host_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).select("host").distinct().select("host", ids.host_bucket(F.col("host"), F.lit(8)).alias("bucket"))


@query
def identity_map_join(spark: SparkSession, d: str) -> DataFrame:
    """The identity under which each signal's request went out."""
    known = fixtures.identities(spark).where("seq <> 3").select("bind_ip", "public_ip")
    return egress.enrich(fixtures.signals(spark, d).select("event_id", F.col("ip").alias("bind_ip")), known).select("event_id", "bind_ip", "public_ip", "identity", "identity_type")


@query
def usable_ips(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).select("page_id", F.when(F.col("page_id") % 5 == 0, "127.0.0.1").when(F.col("page_id") % 5 == 1, "300.1.1.1").otherwise(F.concat(F.lit("10.0.0."), (F.col("page_id") % 40).cast("string"))).alias("ip"))
    return scans.usable_ips(rows, spark.createDataFrame([("10.0.0.7",)], "ip string"), F.col("page_id"))


@query
def sticky_pool_topk(spark: SparkSession, d: str) -> DataFrame:
    return egress.sticky_pool(_canonical(spark, d), _identities(spark), 4, "salt").select("host", F.col("rank").cast("long").alias("rank"), "identity")


@query
def sticky_by_host(spark: SparkSession, d: str) -> DataFrame:
    blocked = _canonical(spark, d).where("page_id % 3 = 0").select("host", F.lit("10.0.0.3").alias("identity")).union(_canonical(spark, d).where("page_id % 2 = 0").select("host", F.lit("198.51.100.4")))
    return egress.sticky_by_host(_canonical(spark, d), _identities(spark), blocked)


@query
def round_robin_assign(spark: SparkSession, d: str) -> DataFrame:
    return egress.round_robin(_pages(spark, d).select("page_id"), _identities(spark), ["page_id"])


@query
def egress_select(spark: SparkSession, d: str) -> DataFrame:
    requests = fixtures.signals(spark, d).select("event_id", "host", (F.floor(F.col("ts_us") / 1000)).cast("long").alias("now_ms"))
    who = _identities(spark)
    hosts = requests.select("host").distinct()
    base = 1704067200000
    cool = who.where("seq % 3 = 0").select("identity", (F.lit(base) + F.col("seq") * 86_400_000).alias("cooldown_until_ms"))
    number = F.substring("host", 2, 1).cast("int")
    back = hosts.join(who.where("seq % 2 = 0").select("identity", "seq"), number % 2 == F.col("seq") % 4).select("host", "identity", (F.lit(base) + F.col("seq") * 200_000_000).alias("next_allowed_ms"))
    slow = hosts.where(number % 3 == 0).select("host", F.lit(base + 1_000_000_000).alias("slowdown_until_ms"), F.lit(3.0).alias("factor"))
    pool = egress.sticky_pool(hosts, who, 3)
    return egress.select_egress(requests, pool, cool, back, slow, 2000)


@query
def later_pacer(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.signals(spark, d).groupBy("host", "ip").agg(F.max("event_id").alias("a"), F.min("event_id").alias("b"))
    ip = F.col("ip").alias("identity")
    return egress.later_pacer(rows.where("ip <> '10.0.0.3'").select("host", ip, (F.col("a") % 100).alias("next_allowed_ms")), rows.where("ip <> '10.0.0.4'").select("host", ip, ((F.col("b") * 13) % 100).alias("next_allowed_ms")))


# --- signals and windows ----------------------------------------------------------------------


@query
def response_signal(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("event_id", "signal_type", signals.weight(F.col("signal_type")).cast("long").alias("weight"))


@query
def exception_signal(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    kind = F.when(p % 3 == 0, "TimeoutError").when(p % 3 == 1, "ConnectionRefusedError").otherwise("OSError")
    message = F.when(p % 4 == 0, "read timed out").otherwise("refused")
    return _pages(spark, d).select("page_id", signals.exception_signal(kind, message).alias("signal_type"), kind.isin(signals.GLOBAL_ERRORS).alias("global_error"))


@query
def failure_window(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.signals(spark, d).where("event_type in ('error', 'click', 'purchase')")
    out = windows.failure_window(rows, ["host", "ip"], F.col("event_type") != "purchase", F.col("event_type") == "purchase", W)
    return out.select("event_id", "failures", "triggered")


@query
def failure_window_local(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.signals(spark, d).where("event_type in ('error', 'click', 'purchase')")
    captcha = F.col("body").contains("human")
    out = windows.failure_window(rows, ["host", "ip"], F.col("event_type") != "purchase", F.col("event_type") == "purchase", W, closed=True, at_once=captcha)
    return out.select("event_id", "failures", "triggered")


@query
def blacklist_state(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.signals(spark, d).where("event_type in ('error', 'click', 'purchase')")
    out = windows.failure_window(rows, ["host", "ip"], F.col("event_type") != "purchase", F.col("event_type") == "purchase", W)
    return windows.blacklist(out, ["host", "ip"]).select("event_id", "triggered", "blacklisted")


@query
def ip_failures(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.signals(spark, d).where("status_code <> 200")
    return rows.groupBy("ip").agg(F.count("*").alias("failures"), F.max_by("status_code", F.struct("ts_us", "event_id")).cast("long").alias("last_status"))


@query
def signal_gap_counter(spark: SparkSession, d: str) -> DataFrame:
    rows = _signals(spark, d).where("signal_type <> 'success'")
    out = windows.gap_counter(rows, ["host", "ip", "signal_type"], W, signals.weight(F.col("signal_type")))
    return out.select("event_id", "session", "count", "weight_sum")


@query
def signal_gap_distinct(spark: SparkSession, d: str) -> DataFrame:
    rows = _signals(spark, d).where("signal_type <> 'success'")
    out = windows.gap_distinct(rows, ["ip", "signal_type"], "host", W, signals.weight(F.col("signal_type")))
    return out.select("event_id", "distinct", "weight_sum")


@query
def softban_events(spark: SparkSession, d: str) -> DataFrame:
    return windows.soft_ban(_challenges(spark, d), W).select("event_id", "host_ip_count", "hosts_of_ip", "ips_of_host", "ips_of_host_asn", "backoff", "cooldown", "slowdown", "soft_limit")


@query
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    hits = windows.soft_ban(_challenges(spark, d), W).where("backoff").select("event_id", "ts_us", "host", "ip")
    return windows.backoff_schedule(hits, ["host", "ip"]).select("event_id", "level", "delay_ms", "next_allowed_ms")


@query
def pacer_schedule(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.signals(spark, d).select("event_id", "host", F.floor(F.col("ts_us") / 1000).cast("long").alias("arrive_ms"))
    return windows.pacer_schedule(rows, ["host"], 1_800_000)


@query
def failure_window_spans(spark: SparkSession, d: str) -> DataFrame:
    """failure_window with a key's rows dealt to several tasks by time."""
    rows = fixtures.signals(spark, d).where("event_type in ('error', 'click', 'purchase')")
    out = scans_by_span.failure_window(rows, ["host", "ip"], F.col("event_type") != "purchase", F.col("event_type") == "purchase", W)
    return out.select("event_id", "failures", "triggered")


@query
def signal_gap_counter_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = _signals(spark, d).where("signal_type <> 'success'")
    out = scans_by_span.gap_counter(rows, ["host", "ip", "signal_type"], W, signals.weight(F.col("signal_type")), 4 * W)
    return out.select("event_id", "session", "count", "weight_sum")


@query
def pacer_schedule_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.signals(spark, d).select("event_id", "host", F.floor(F.col("ts_us") / 1000).cast("long").alias("arrive_ms"))
    return scans_by_span.pacer_schedule(rows, ["host"], 1_800_000, 86_400_000)


@query
def softban_events_spans(spark: SparkSession, d: str) -> DataFrame:
    """softban_events with the signals of an address or host dealt to several tasks by time."""
    rows = scans_by_span.soft_ban(written(_challenges(spark, d), "challenges"), W, 4 * W)
    return rows.select("event_id", "host_ip_count", "hosts_of_ip", "ips_of_host", "ips_of_host_asn", "backoff", "cooldown", "slowdown", "soft_limit")


@query
def state_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Of each signal: the backoff of its host and address, and the slowdown of its host, that were in force when it came."""
    rows = fixtures.signals(spark, d).select("event_id", "host", "ip", "ts_us")
    banned = _soft(spark, d)
    backoffs = windows.backoff_schedule(banned.where("backoff").select("event_id", "ts_us", "host", "ip"), ["host", "ip"]).select("host", "ip", "ts_us", F.col("event_id").alias("n"), "next_allowed_ms", "level")
    slow = banned.where("slowdown").select("host", "ts_us", F.col("event_id").alias("n"), (F.col("ts_us") + 600_000_000).alias("until_us"))
    day = 86_400_000_000
    out = scans_by_span.as_of(rows, backoffs, ["host", "ip"], "ts_us", day, "backoff", inclusive=False)
    out = scans_by_span.as_of(out, slow, ["host"], "ts_us", day, "slow", inclusive=False)
    waits = F.col("backoff.next_allowed_ms") > F.floor(F.col("ts_us") / 1000)
    return out.select("event_id", F.when(waits, F.col("backoff.next_allowed_ms")).alias("next_allowed_ms"), F.when(waits, F.col("backoff.level")).alias("level"), F.coalesce(F.col("slow.until_us") > F.col("ts_us"), F.lit(False)).alias("slowed"))


@query
def cidr_rates(spark: SparkSession, d: str) -> DataFrame:
    """Challenge and 5xx rates by the longest known prefix of the address; prefixes, overlapping ones too, from the suppliers' keys."""
    u, k = F.col("user_id"), F.col("s_suppkey")
    text = lambda *parts: F.concat(*(p.cast("string") if hasattr(p, "cast") else F.lit(p) for p in parts))
    ip = text("10.", u % 4, ".", F.col("event_id") % 8, ".", u % 250)
    rows = _signals(spark, d).join(fixtures.table(spark, d, "events").select("event_id", ip.alias("client")), "event_id")
    cidr = F.when(k % 9 == 0, text("10.", k % 4, ".0.0/16")).when(k % 7 == 0, text("10.", k % 4, ".", k % 8, ".0/24")).when(k % 5 == 0, "10.0.0.0/9").otherwise(text("10.", k % 4, ".", k % 8, ".", (k * 8) % 250, "/", 26 + k % 6))
    return metrics.rates(ranges.longest_prefix(rows, "client", fixtures.table(spark, d, "supplier").select(cidr.alias("cidr"))), "cidr")


@query
def delayed_buffer(spark: SparkSession, d: str) -> DataFrame:
    """What of the delayed commands is due, what stays, and the oldest of both."""
    rows = pacer_schedule(spark, d)
    now = 1704067200000 + 15 * 86_400_000
    seen = rows.where(F.col("arrive_ms") <= now).withColumn("due", F.col("start_ms") <= now)
    return seen.groupBy("host", "due").agg(F.count("*").alias("n"), F.min("arrive_ms").alias("oldest_ms"), F.max("wait_ms").alias("longest_ms"))


@query
def state_key_audit(spark: SparkSession, d: str) -> DataFrame:
    before, after = _state_keys(spark, d)
    return audit.audit(before, after)


def _state_keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = fixtures.signals(spark, d).select("event_id", "host")
    n = F.col("event_id") % 9
    kind = F.when(n == 0, "profile").when(n == 1, "Rank").otherwise("host_ip")
    prefix = F.when(n == 2, "other:").otherwise(audit.PREFIX + ":")
    key = F.concat(prefix, kind, F.lit(":"), ids.stable_hash(F.concat("host", (F.col("event_id") % 50).cast("string"))))
    after = rows.select(key.alias("key"), audit.clamp_ttl(F.col("event_id")).alias("ttl")).withColumn("ttl", F.when(F.col("ttl") % 10 == 0, -1).otherwise(F.col("ttl")))
    return after.where("ttl % 4 = 1"), after


# --- facts and what follows from them ---------------------------------------------------------


@query
def crawl_attempts(spark: SparkSession, d: str) -> DataFrame:
    keep = [c for c in attempts.COLUMNS if c != "response_headers"]  # a map, which rows can't be compared by
    return _attempts(spark, d).select(*keep)


@query
def attempt_violations(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("url_hash", 1, 1)
    rows = _attempts(spark, d)
    rows = rows.withColumn("status_code", F.when(n == "0", 700).otherwise(F.col("status_code"))).withColumn("storage_key", F.when(n == "1", F.lit(None)).otherwise(F.col("storage_key")))
    rows = rows.withColumn("url_hash", F.when(n == "2", F.upper("url_hash")).otherwise(F.col("url_hash"))).withColumn("host", F.when(n == "3", F.lit("")).otherwise(F.col("host")))
    rows = rows.withColumn("schema_version", F.when(n == "4", F.lit("9")).otherwise(F.col("schema_version"))).withColumn("snapshot_id", F.when(n == "6", F.lit("")).otherwise(F.col("snapshot_id")))
    rows = rows.withColumn("content_sha256", F.when((n == "5") & F.col("content_sha256").isNotNull(), F.lit("XYZ")).otherwise(F.col("content_sha256")))
    return rows.select("attempt_id", F.array_join(attempts.violations(rows), ";").alias("violations"))


@query
def crawl_logs(spark: SparkSession, d: str) -> DataFrame:
    rows = _attempts(spark, d)
    again = rows.withColumn("finished_at_ms", F.col("finished_at_ms") + 5).withColumn("storage_result", F.lit("failed")).withColumn("snapshot_id", F.lit(None).cast("string"))
    return attempts.crawl_logs(rows.unionByName(again.where("status_code = 200"))).select("attempt_id", "finished_at_ms", "storage_result")


@query
def terminal_attempts(spark: SparkSession, d: str) -> DataFrame:
    rows = _decided(spark, d)
    stopped = policy.gate(F.col("policy_paused"), F.col("policy_enabled"), F.col("deadline_at"), fixtures.NOW_MS)
    routed = policy.outcome(F.col("status_code"), F.col("fetch_failed"), F.col("deliveries"), F.coalesce("cmd_max_retries", "policy_max_retries"))
    ended = rows.withColumn("stopped_by", F.coalesce(stopped, F.nullif(routed, F.lit("fetched")))).where("stopped_by <> 'retry'")
    return attempts.terminal_attempts(ended, fixtures.NOW_MS, POLICY["version"]).drop("response_headers", "attempted_at_ms", "finished_at_ms")


@query
def page_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return attempts.page_snapshots(_attempts(spark, d)).select("snapshot_id", "attempt_id", "content_sha256", "storage_key")


@query
def pages_latest(spark: SparkSession, d: str) -> DataFrame:
    return attempts.pages_latest(attempts.page_snapshots(_attempts(spark, d))).select("url_hash", "snapshot_id", "finished_at_ms", "uncompressed_size")


@query
def pages_latest_stream(spark: SparkSession, d: str) -> DataFrame:
    """pages_latest kept by a stream of snapshots in batches; the last batch comes twice."""
    snapshots = attempts.page_snapshots(_attempts(spark, d))
    folder, table = stream.scratch(spark, "snapshots"), stream.scratch(spark, "latest")
    snapshots.repartition(4, "snapshot_id").write.parquet(folder)
    put = upsert.upsert(table, "url_hash", ["finished_at_ms", "snapshot_id"], buckets=16)
    rows = spark.readStream.schema(snapshots.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def twice(batch: DataFrame, number: int) -> None:
        put(batch, number)
        put(batch.limit(1), number)

    rows.writeStream.foreachBatch(twice).option("checkpointLocation", stream.scratch(spark, "latest-state")).trigger(availableNow=True).start().awaitTermination()
    return upsert.read_latest(spark, table, snapshots.schema).select("url_hash", "snapshot_id", "finished_at_ms", "uncompressed_size")


@query
def host_profile_mix(spark: SparkSession, d: str) -> DataFrame:
    """Shares of each host's attempts by kind of error and by egress address."""
    return metrics.host_mix(_attempts(spark, d))


@query
def host_profile_days(spark: SparkSession, d: str) -> DataFrame:
    """Host profiles of days with sketches, merged to one of all days: counts exact, quantiles of latency and number of URLs estimated."""
    return metrics.profile_estimates(metrics.merge_profiles(metrics.daily_profiles(_attempts(spark, d))))


@query
def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    return attempts.page_metadata(_attempts(spark, d))


@query
def attempt_changes(spark: SparkSession, d: str) -> DataFrame:
    return attempts.previous_attempts(_attempts(spark, d)).select("attempt_id", "status_code", "previous_status")


@query
def fact_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = _attempts(spark, d).select("attempt_id", "status_code", "host", "error_type")
    return scans.fact_messages(rows)


@query
def host_profile(spark: SparkSession, d: str) -> DataFrame:
    return metrics.host_profile(_attempts(spark, d))


@query
def host_latency(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency_quantiles(_attempts(spark, d))


@query
def request_rollup(spark: SparkSession, d: str) -> DataFrame:
    return metrics.request_cube(_attempts(spark, d))


@query
def metric_requests(spark: SparkSession, d: str) -> DataFrame:
    return metrics.requests_total(_attempts(spark, d))


@query
def metric_response_seconds(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(_attempts(spark, d).withColumn("egress_ip", metrics.egress_ip()), ["host", "egress_ip"], F.col("finished_at_ms") - F.col("attempted_at_ms"))


@query
def metric_content_skips(spark: SparkSession, d: str) -> DataFrame:
    return metrics.content_skips(_attempts(spark, d))


@query
def metric_storage_uploads(spark: SparkSession, d: str) -> DataFrame:
    return metrics.storage_uploads(_attempts(spark, d), attempts.PROVIDER, "pages")


@query
def metric_feedback_signals(spark: SparkSession, d: str) -> DataFrame:
    rows = _signals(spark, d).join(fixtures.identities(spark).select(F.col("bind_ip").alias("ip"), "asn"), "ip")
    return metrics.signal_rates(rows)


@query
def metric_terminal(spark: SparkSession, d: str) -> DataFrame:
    stopped = policy_gate(spark, d).where("stopped_by is not null").select(F.col("stopped_by").alias("result"))
    routed = retry_routing(spark, d).where("outcome <> 'fetched'").select(F.col("outcome").alias("result"))
    return stopped.unionByName(routed).groupBy("result").agg(F.count("*").alias("value"))


@query
def metric_in_flight(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.fetch_results(spark, d)
    return rows.groupBy("job_id").agg(metrics.in_flight(F.lit(1), F.when(F.col("storage_ok"), 1).otherwise(0)).cast("long").alias("in_flight"))


@query
def metric_policy_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).groupBy("matched_scope_type").agg(F.count("*").alias("value"))


@query
def metric_stopped(spark: SparkSession, d: str) -> DataFrame:
    """Commands paused and expired, by the scope that decided."""
    rows = _decided(spark, d).withColumn("stopped_by", policy.gate(F.col("policy_paused"), F.col("policy_enabled"), F.col("deadline_at"), fixtures.NOW_MS)).where("stopped_by is not null")
    return rows.groupBy("stopped_by", "matched_scope_type", F.when(F.col("stopped_by") == "paused", F.coalesce("policy_pause_reason", F.lit("paused"))).alias("reason")).agg(F.count("*").alias("value"))


@query
def metric_blacklist_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of host and address that are on the blacklist at the time of each address's last signal."""
    rows = fixtures.signals(spark, d).where("event_type in ('error', 'click', 'purchase')")
    out = windows.failure_window(rows, ["host", "ip"], F.col("event_type") != "purchase", F.col("event_type") == "purchase", W)
    last = windows.blacklist(out, ["host", "ip"]).groupBy("host", "ip").agg(F.max_by("blacklisted", F.struct("ts_us", "event_id")).alias("on"))
    return last.groupBy("ip").agg(F.count_if("on").alias("value"))


@query
def metric_signals_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).groupBy("signal_type", F.lit("host_ip").alias("dimension")).agg(F.count("*").alias("value"), F.sum(signals.weight(F.col("signal_type")).cast("long")).alias("weight"))


def _soft(spark: SparkSession, d: str) -> DataFrame:
    return windows.soft_ban(_challenges(spark, d), W)


@query
def metric_soft_ban_totals(spark: SparkSession, d: str) -> DataFrame:
    """Cooldowns, slowdowns and soft limits that set in, by reason and, for soft limits, ASN."""
    kinds = F.array(
        F.when(F.col("cooldown"), F.struct(F.lit("ip_cooldown").alias("metric"), F.lit("cross_host_challenge").alias("reason"), F.lit("").alias("asn"))),
        F.when(F.col("slowdown"), F.struct(F.lit("host_slowdown").alias("metric"), F.lit("multi_ip_challenge").alias("reason"), F.lit("").alias("asn"))),
        F.when(F.col("soft_limit"), F.struct(F.lit("host_asn_soft_limit").alias("metric"), F.lit("host_asn_challenge").alias("reason"), F.col("asn").alias("asn"))),
    )
    rows = _soft(spark, d).select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return rows.groupBy("k.metric", "k.reason", "k.asn").agg(F.count("*").alias("value"))


@query
def metric_active_states(spark: SparkSession, d: str) -> DataFrame:
    """Cooldowns (1800 s) and slowdowns (600 s) in force at the last signal of all."""
    rows = _soft(spark, d)
    now = rows.agg(F.max("ts_us").alias("now"))
    cool = rows.where("cooldown").groupBy(F.col("ip").alias("k")).agg(F.max("ts_us").alias("at")).select(F.lit("ip_cooldown").alias("metric"), (F.col("at") + 1_800_000_000).alias("until"))
    slow = rows.where("slowdown").groupBy(F.col("host").alias("k")).agg(F.max("ts_us").alias("at")).select(F.lit("host_slowdown").alias("metric"), (F.col("at") + 600_000_000).alias("until"))
    return cool.unionByName(slow).join(F.broadcast(now), F.lit(True)).groupBy("metric").agg(F.count_if(F.col("until") > F.col("now")).alias("value"))  # now is one row


@query
def metric_backoff_active(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of host and address that are backed off at the last signal of all, by host."""
    hits = _soft(spark, d).where("backoff").select("event_id", "ts_us", "host", "ip")
    last = windows.backoff_schedule(hits, ["host", "ip"]).groupBy("host", "ip").agg(F.max_by("next_allowed_ms", F.struct("ts_us", "event_id")).alias("until"))
    now = fixtures.signals(spark, d).agg(F.floor(F.max("ts_us") / 1000).alias("now"))
    return last.join(F.broadcast(now)).groupBy("host").agg(F.count_if(F.col("until") > F.col("now")).alias("value"))  # now is one row


@query
def metric_delayed_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Commands that wait in buffers of 20, and those that a full buffer turns away."""
    host = ids.host_bucket(urls.host(F.col("url")), F.lit(8))
    rows = stream.table_stream(spark, d, "pages").select(F.concat(F.lit("consumer-"), host.cast("string")).alias("buffer"), F.col("page_id").alias("message_id"), F.lit(4_102_444_800_000).alias("eligible_ms"), F.lit(4_102_444_799_000).alias("read_ms"), F.col("url").alias("body"))
    out = stored.one_batch(stored.delay_buffer(rows, capacity=20), stream.scratch(spark, "delay"))
    return out.groupBy(F.col("buffer").alias("consumer"), F.col("event").alias("result")).agg(F.count("*").alias("value"))


@query
def metric_backoff_seconds(spark: SparkSession, d: str) -> DataFrame:
    hits = _soft(spark, d).where("backoff").select("event_id", "ts_us", "host", "ip", "signal_type")
    return metrics.histogram(windows.backoff_schedule(hits, ["host", "ip"]), ["signal_type"], F.col("delay_ms"), [1.0, 5.0, 10.0, 30.0, 60.0, 300.0])


@query
def metric_pacer_delay(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(pacer_schedule(spark, d).withColumn("reason", F.lit("host_interval")), ["reason"], F.col("wait_ms"), [1.0, 10.0, 60.0, 600.0, 3600.0, 86400.0])


@query
def metric_egress_selected(spark: SparkSession, d: str) -> DataFrame:
    """Selections by strategy and type of identity; those without one as unavailable."""
    kind = F.when(F.col("identity").isNull(), "unavailable").when(F.startswith("identity", F.lit("198.")), "public_ip").otherwise("bind_ip")
    return egress_select(spark, d).groupBy(F.lit("STICKY_POOL").alias("strategy"), kind.alias("egress_identity_type")).agg(F.count("*").alias("value"))


@query
def metric_sticky_pools(spark: SparkSession, d: str) -> DataFrame:
    sizes = sticky_pool_topk(spark, d).groupBy("host").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("value"))


@query
def metric_active_ips(spark: SparkSession, d: str) -> DataFrame:
    """Usable addresses that signals went out by, by status."""
    used = fixtures.signals(spark, d).where(net.usable_ipv4(F.col("ip"))).select(F.col("ip").alias("bind_ip")).distinct()
    return used.join(fixtures.identities(spark), "bind_ip").groupBy("status").agg(F.count("*").alias("value"))


@query
def metric_forbidden_keys(spark: SparkSession, d: str) -> DataFrame:
    before, after = _state_keys(spark, d)
    fresh = audit.new_keys(before, after).where("forbidden")
    return fresh.groupBy(audit.marker(F.col("key")).alias("pattern")).agg(F.count("*").alias("value"))


@query
def metric_state_ttl(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.split("key", ":"), -2)
    rows = _state_keys(spark, d)[1].where("ttl > 0").withColumn("state_type", kind)
    return metrics.histogram(rows, ["state_type"], F.col("ttl") * 1000, [60.0, 600.0, 3600.0, 86400.0])


# --- workers, state and the command loop ------------------------------------------------------


@query
def response_context(spark: SparkSession, d: str) -> DataFrame:
    """Responses with what their commands carried; every fourth page's commands are unknown."""
    rows = fixtures.fetch_results(spark, d)
    key = ids.command_attempt_id(F.col("job_id"), F.concat("url", F.lit("#"), F.col("page_id").cast("string"))).alias("attempt_id")
    told = rows.where("page_id % 4 <> 0").select(key, F.col("result_id").alias("message_id"), "tier", "policy_scope_id")
    return attempts.with_context(rows.select("result_id", key), told).select("result_id", "tier", "policy_scope_id")


def _worker(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    e = F.col("event_id")
    rows = fixtures.table(spark, d, "events")
    node, pod = F.concat(F.lit("node-"), (e % 5).cast("string")), F.concat(F.lit("pod-"), (e % 11).cast("string"))
    return rows, {"node": node, "pod": pod}


@query
def consumer_names(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    rows, c = _worker(spark, d)
    explicit = F.when(e % 4 == 0, F.concat(F.lit(" fixed-"), (e % 3).cast("string"), F.lit(" "))).when(e % 4 == 1, "  ")
    template = F.when(e % 3 == 0, "c-{node_name}-$(POD_NAME)").when(e % 3 == 1, "${NODE_NAME}/{POD_NAME}")
    name = runtime.consumer_name(explicit, template, c["node"], F.when(e % 6 != 0, c["pod"]), F.lit("box"))
    debug = e % 2 == 0
    return rows.select(
        "event_id", name.alias("consumer"), runtime.routed(debug, "commands", "commands-debug:{node_name}", c["node"], c["pod"]).alias("stream"),
        runtime.routed(debug, "workers", "workers-debug:{node_name}", c["node"], c["pod"]).alias("grp"),
    )


@query
def worker_readiness(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    last = F.when(e % 5 != 0, F.lit(fixtures.NOW_MS) - ((e * 37) % 100 - 20) * 1000)
    return fixtures.table(spark, d, "events").select("event_id", runtime.ready(e % 3 != 0, last, fixtures.NOW_MS).alias("ready"), runtime.heartbeat_age(last, fixtures.NOW_MS).alias("age"))


@query
def header_decode(spark: SparkSession, d: str) -> DataFrame:
    """Headers as bytes: the last value counts, bytes that are no UTF-8 go."""
    p = F.col("page_id").cast("string")
    kind = F.array(F.encode(F.lit("text/plain"), "UTF-8"), F.encode(F.concat(F.lit("text/"), p), "UTF-8"))
    server = F.array(F.when(F.col("page_id") % 2 == 0, F.unhex(F.lit("636166C3A9FF"))).otherwise(F.unhex(F.lit("E26FE2826B"))))
    found = runtime.headers(F.create_map(F.lit("content-type"), kind, F.lit("server"), server))
    return _pages(spark, d).select("page_id", F.element_at(found, "content-type").alias("content_type"), F.element_at(found, "server").alias("server"))


@query
def state_key_rules(spark: SparkSession, d: str) -> DataFrame:
    n, text = F.col("event_id") % 6, F.concat(F.lit(" a"), F.col("event_id").cast("string"))
    prefix = F.when(n == 0, " : ").when(n == 4, " p: ").otherwise(audit.PREFIX)
    part = F.when(n == 1, " ").when(n == 2, F.concat(text, F.lit("/x"))).when(n == 3, F.concat(text, F.lit("_ReCrawl"))).otherwise(text)
    return fixtures.table(spark, d, "events").select("event_id", state.key_error(prefix, "ip", part).alias("error"), state.key(prefix, "ip", part).alias("key"))


NOON_MS = 1705449600000  # 2024-01-17T00:00:00Z, within the signals


def _writes(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    e, error = F.col("event_id"), F.col("event_type") == "error"
    rows = fixtures.signals(spark, d, events)
    key = F.concat(F.lit(audit.PREFIX + ":host:"), ids.stable_hash(F.col("host")), F.lit(":"), (e % 40).cast("string"))
    status = F.col("status_code").cast("string")
    fields = F.when(error, F.create_map(F.lit("kind"), F.col("event_type"), F.lit("status"), status)).otherwise(F.create_map(F.lit("kind"), F.col("event_type")))
    return rows.select(key.alias("key"), F.floor(F.col("ts_us") / 1000).cast("long").alias("at_ms"), e.alias("n"), fields.alias("fields"), ((e * 7919) % 100_000).alias("ttl"))


@query
def state_alive(spark: SparkSession, d: str) -> DataFrame:
    rows = state.alive(_writes(spark, d), NOON_MS)
    return rows.select("key", "expires_ms", F.element_at("fields", "kind").alias("kind"), F.try_element_at("fields", F.lit("status")).alias("status"))


@query
def state_prefix_count(spark: SparkSession, d: str) -> DataFrame:
    return state.count_prefix(state.alive(_writes(spark, d), NOON_MS), audit.PREFIX + ":host:")


@query
def metric_state_reads(spark: SparkSession, d: str) -> DataFrame:
    rows = _writes(spark, d)
    return metrics.counted(state.read(rows.select("key").distinct(), state.alive(rows, NOON_MS)), F.lit("host").alias("state_type"), F.col("result"))


@query
def metric_state_writes(spark: SparkSession, d: str) -> DataFrame:
    """Writes of a stream into the state store; every tenth says no time to live and fails open."""
    writes = _writes(spark, d, stream.table_stream(spark, d, "events")).withColumn("op", F.lit("write")).withColumn("ttl", F.when(F.col("n") % 10 != 0, F.col("ttl")))
    done = stored.one_batch(stored.keyed_state(writes), stream.scratch(spark, "state-writes"))
    return metrics.counted(done, F.lit("host").alias("state_type"), F.col("result"))


@query
def state_store(spark: SparkSession, d: str) -> DataFrame:
    """What the state store holds alive after a stream of the writes up to noon, read from its checkpoint."""
    folder = stream.scratch(spark, "state-store")
    writes = _writes(spark, d, stream.table_stream(spark, d, "events")).where(F.col("at_ms") <= NOON_MS).withColumn("op", F.lit("write"))
    stored.one_batch_of_state(stored.keyed_state(writes), folder)
    rows = stored.stored_state(spark, folder + "/state", NOON_MS)
    return rows.select("key", "expires_ms", F.try_element_at("fields", F.lit("kind")).alias("kind"), F.try_element_at("fields", F.lit("status")).alias("status"))


@query
def queue_facts(spark: SparkSession, d: str) -> DataFrame:
    """Commands through the queue, retried until they succeed or their budget is spent, and published once each."""
    connectors.register(spark)
    queue, log, state_dir = (stream.scratch(spark, n) for n in ("queue", "facts", "queue-state"))
    results = fixtures.fetch_results(spark, d)
    asked = results.select("url", F.col("url").alias("canonical_url"), "job_id", "command_id", F.col("cmd_max_retries").cast("string").alias("max_retries"))
    asked.write.format("command_queue").mode("append").save(queue)
    fetched = results.select(F.col("command_id").alias("_id"), "status_code", "fetch_failed")
    while True:
        read = spark.readStream.format("command_queue").options(group="workers", minIdleMs=0, readCount=1_000_000).load(queue)
        valid, _ = stream.split_valid(read)
        rows = valid.join(fetched, F.col("command_id") == F.col("_id"))
        budget = F.coalesce(commands.bounded_int(F.col("max_retries")), F.lit(policy.BOOTSTRAP["max_retries"]))
        rows = rows.withColumn("outcome", policy.outcome(F.col("status_code"), F.col("fetch_failed"), F.col("deliveries"), budget)).where("outcome <> 'retry'")
        facts = rows.select(F.col("command_id").alias("attempt_id"), F.to_json(F.struct("command_id", "outcome", "deliveries")).alias("value"), "message_id")
        sink = facts.writeStream.format("fact_log").option("checkpointLocation", state_dir).option("path", log).options(queue=queue, group="workers")
        sink.trigger(availableNow=True).start().awaitTermination()
        if not connectors.outstanding(queue, "workers"):  # three deliveries at most
            break
    return spark.read.format("fact_log").load(log).select(F.from_json("value", "command_id string, outcome string, deliveries int").alias("x")).select("x.*")


@query
def metric_publishes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.counted(fixtures.fetch_results(spark, d), F.lit("crawl.attempts").alias("topic"), F.when(F.col("publish_ok"), "success").otherwise("failure").alias("result"))


@query
def metric_dependency_health(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.fetch_results(spark, d)
    page = ~F.coalesce("fetch_failed", F.lit(False)) & F.coalesce(F.col("status_code") == 200, F.lit(False)) & content.is_html(F.col("content_type"))
    at = (F.col("finished_at_ms").alias("at_ms"), F.col("result_id").alias("n"))
    stores = rows.where(page).select(F.lit("oci").alias("dependency"), F.col("storage_ok").alias("ok"), *at)
    return metrics.dependency_health(stores.unionByName(rows.select(F.lit("kafka").alias("dependency"), F.col("publish_ok").alias("ok"), *at)))


@query
def metric_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    rows, c = _worker(spark, d)
    return rows.groupBy(F.concat_ws("-", c["node"], c["pod"]).alias("consumer")).agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("value"))


@query
def metric_queue_events(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    rows = _decided(spark, d).withColumn("stopped_by", policy.gate(F.col("policy_paused"), F.col("policy_enabled"), F.col("deadline_at"), fixtures.NOW_MS))
    rows = rows.withColumn("outcome", policy.outcome(F.col("status_code"), F.col("fetch_failed"), F.col("deliveries"), F.coalesce("cmd_max_retries", "policy_max_retries", F.lit(2))))
    return metrics.queue_events(rows.withColumn("valid", p % 12 != 0).withColumn("wait_ms", F.when(p % 5 == 0, 1).otherwise(0)))


@query
def metric_stream_events(spark: SparkSession, d: str) -> DataFrame:
    """What a running query observed of its commands: read, valid, invalid, past their deadline."""
    folder, rows = stream.scratch(spark, "progress"), stream.scratch(spark, "commands")
    fixtures.commands(spark, d).select(F.col("command_no").cast("string").alias("command_id"), "url", "job_id", "canonical_url", "deadline_at", "max_retries").write.parquet(rows)
    schema = ", ".join(f"{f} string" for f in commands.FIELDS)
    read = spark.readStream.schema(schema).parquet(rows)
    error = commands.command_error({f: F.col(f) for f in commands.FIELDS})
    late = error.isNull() & (F.timestamp_millis(F.lit(fixtures.NOW_MS)) >= commands.deadline(F.col("deadline_at")))
    seen = read.observe("commands", *monitor.counts(read=F.lit(True), valid=error.isNull(), invalid=error.isNotNull(), deadline_expired=F.coalesce(late, F.lit(False))))
    log = monitor.ProgressLog(folder)
    spark.streams.addListener(log)
    try:
        query = seen.writeStream.queryName("commands").format("noop").option("checkpointLocation", stream.scratch(spark, "commands-state")).trigger(availableNow=True).start()
        query.awaitTermination()
        log.settle(str(query.runId))
    finally:
        spark.streams.removeListener(log)
    return monitor.observed(monitor.events(spark, folder)).select(F.col("name").alias("result"), "value")


@query
def metric_delay_expired(spark: SparkSession, d: str) -> DataFrame:
    """Commands that waited for an hour or more; they are warned of once and stay."""
    return metrics.counted(pacer_schedule(spark, d).where("wait_ms >= 3600000"), F.lit("host_interval").alias("reason"))


@query
def metric_identity_unavailable(spark: SparkSession, d: str) -> DataFrame:
    """Active identities found in cooldown, once for each request that looks at them."""
    cool = F.array(*(F.lit(1704067200000 + r["seq"] * 86_400_000) for r in fixtures.identities(spark).where("status = 'active' and seq % 3 = 0").collect()))  # of eight rows
    seen = fixtures.signals(spark, d).select(F.explode(F.filter(cool, lambda until: F.floor(F.col("ts_us") / 1000) < until)))
    return metrics.counted(seen, F.lit("ip_cooldown").alias("reason"))


@query
def metric_sticky_assignments(spark: SparkSession, d: str) -> DataFrame:
    return metrics.counted(fixtures.signals(spark, d), F.lit("sticky_pool").alias("strategy"))


def _loads(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 7
    result = F.when(n == 0, "invalid").when(n == 1, "error").when(n == 2, "not_modified").otherwise("success")
    return fixtures.table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), result.alias("result"))


@query
def metric_policy_loads(spark: SparkSession, d: str) -> DataFrame:
    return metrics.counted(_loads(spark, d), F.col("result"))


@query
def metric_policy_state(spark: SparkSession, d: str) -> DataFrame:
    """Version in force, whether it is the last known good one after a failed load, and its age then."""
    good, at = F.col("result") == "success", F.struct("us", "event_id")
    rows = _loads(spark, d).agg(
        F.max_by(F.when(good, F.concat(F.lit("v"), F.col("event_id").cast("string"))), F.when(good, at)).alias("version"),
        F.max_by(F.col("result").isin("invalid", "error"), at).alias("lkg_active"), F.max(F.when(good, F.col("us"))).alias("us"),
    )
    age = F.floor((F.lit(fixtures.NOW_MS * 1000) - F.col("us")) / 1_000_000).cast("long")
    return rows.select("version", "lkg_active", F.when(F.col("lkg_active"), age).otherwise(0).cast("long").alias("lkg_age_seconds"))


@query
def observed_ips(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    body = F.when(p % 3 == 0, F.concat(F.lit('{"origin": "10.1.1.'), (p % 200).cast("string"), F.lit('"}'))).when(p % 3 == 1, F.concat(F.lit("10.2.2."), (p % 200).cast("string"), F.lit("\nmore"))).otherwise("")
    return _pages(spark, d).select("page_id", net.observed_ip(body).alias("ip"))


@query
def pause_flags(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    text = F.when(p % 4 == 0, " YES ").when(p % 4 == 1, "off").when(p % 4 == 2, "")
    return _pages(spark, d).select("page_id", net.flag(text, F.lit(True)).alias("paused"), net.all_interfaces(text).alias("all_interfaces"))


# --- not in SQL -------------------------------------------------------------------------------


@query
def gzip_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Pages put into the object store and read back: key, whether digest and size hold, and what was unpacked."""
    rows = _canonical(spark, d).select("page_id", "url_hash", F.col("html").alias("body"))
    path = stream.scratch(spark, "objects")
    scans.write_objects(rows.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("storage_key"), "body"), path)
    back = spark.read.parquet(path).select("storage_key", content.gunzip_bytes(F.col("body")).alias("raw"))
    found = back.join(scans.verify_objects(spark, path), "storage_key")
    return found.select(F.substring_index("storage_key", "/", -1).cast("long").alias("page_id"), "ok", F.sha2("raw", 256).alias("sha256"), F.octet_length("raw").cast("long").alias("size"))


@query
def pacer_multi(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.signals(spark, d).select("event_id", "host", F.floor(F.col("ts_us") / 1000).cast("long").alias("arrive_ms"))
    return pacing.pace(rows, ["10.0.0.2", "10.0.0.3", "10.0.0.4"], 3_600_000)


@query
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Each event comes twice and is kept once, with its values."""
    rows = stream.table_stream(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    twice = rows.unionByName(rows)
    return stream.drain(stream.dedupe(twice, "event_id", "ts", "60 days")).select("event_id", "user_id", "event_type")


@query
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """All sessions: a last row beyond every session's end tells the stream that nothing more comes."""
    rows = stream.table_stream(spark, d, "events").where("event_type = 'error'").select((F.col("user_id") % 7).alias("host"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("weight"))
    last = fixtures.table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("ts")).where("ts is not null")
    end = stream.ending(last.select(F.lit(None).cast("long").alias("host"), (F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.lit(0).alias("weight")))
    return stream.drain(stream.session_counts(rows.unionByName(end), ["host"], "ts", "6 hours", "1 minute")).where("host is not null").drop("weight_sum")
