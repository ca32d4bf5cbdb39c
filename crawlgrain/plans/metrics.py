"""Operational metrics as grouped queries over facts, signals and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed bucket limits of the histograms, in seconds.
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def requests_total(attempts: DataFrame) -> DataFrame:
    status = F.coalesce(F.col("status_code").cast("string"), F.lit("error"))
    return attempts.groupBy("host", status.alias("status"), egress_ip().alias("egress_ip")).agg(F.count("*").alias("value"))


def egress_ip() -> Column:
    return F.coalesce(F.nullif(F.col("egress_local_ip"), F.lit("")), F.lit("unknown"))


def histogram(rows: DataFrame, keys: list[str], ms: Column, limits: list[float] = BUCKETS) -> DataFrame:
    """Cumulative buckets as rows (keys, le, value), '+Inf' last; one row of partial sums a key before the shuffle."""
    sums = [F.count_if(ms <= int(le * 1000)).alias(f"b{i}") for i, le in enumerate(limits)]
    wide = rows.groupBy(*keys).agg(*sums, F.count(ms).alias("b_all"))
    pairs = F.array(*(F.struct(F.lit(f"{le:g}").alias("le"), F.col(f"b{i}").alias("value")) for i, le in enumerate(limits)), F.struct(F.lit("+Inf").alias("le"), F.col("b_all").alias("value")))
    return wide.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.le", "x.value")


def storage_uploads(attempts: DataFrame, provider: str, bucket: str) -> DataFrame:
    tried = attempts.where("storage_result <> 'skipped'")
    return tried.groupBy(F.lit(provider).alias("provider"), F.lit(bucket).alias("bucket"), "storage_result").agg(F.count("*").alias("value"), F.sum("uncompressed_size").alias("bytes"))


def content_skips(attempts: DataFrame) -> DataFrame:
    reason = F.when(F.col("fetch_result") == "failed", "fetch_failed").when(F.coalesce(F.col("status_code") != 200, F.lit(True)), "non_200_status").otherwise("non_html_content")
    return attempts.where("storage_result = 'skipped'").groupBy(reason.alias("reason")).agg(F.count("*").alias("value"))


def host_profile(attempts: DataFrame) -> DataFrame:
    """Per host: attempts, stored pages, failures, bytes, links, latency, distinct URLs. Every part combines before the shuffle but the exact count of URLs."""
    ms = F.col("finished_at_ms") - F.col("attempted_at_ms")
    return attempts.groupBy("host").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("storage_result") == "stored").alias("stored"), F.count_if(F.col("fetch_result") == "failed").alias("failed"),
        F.sum("bytes_downloaded").alias("bytes"), F.sum(F.col("outlinks_count").cast("long")).alias("outlinks"), F.sum(ms).alias("latency_ms"), F.max(ms).alias("max_latency_ms"),
        F.countDistinct("url_hash").alias("urls"),
    )


def request_cube(attempts: DataFrame) -> DataFrame:
    """Attempts by host, status and storage result, with every sub-total; '*' stands for all."""
    status = F.coalesce(F.col("status_code").cast("string"), F.lit("error"))
    rows = attempts.select("host", status.alias("status"), "storage_result").cube("host", "status", "storage_result").agg(F.count("*").alias("value"))
    return rows.select(*(F.coalesce(c, F.lit("*")).alias(c) for c in ("host", "status", "storage_result")), "value")


def latency_quantiles(attempts: DataFrame) -> DataFrame:
    """Exact discrete quantiles of latency per host."""
    ms = F.col("finished_at_ms") - F.col("attempted_at_ms")
    rows = attempts.select("host", ms.alias("ms"))
    w = "percentile_disc({}) within group (order by ms)"
    return rows.groupBy("host").agg(*(F.expr(w.format(q)).cast("long").alias(n) for q, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))))


def signal_rates(signals: DataFrame) -> DataFrame:
    """Per ASN: signals and how many are challenges, per mille."""
    bad = F.col("signal_type").isin("http_429", "captcha_challenge", "anti_bot_200")
    return signals.groupBy("asn").agg(F.count("*").alias("signals"), F.count_if(bad).alias("challenges"), F.floor(1000 * F.count_if(bad) / F.count("*")).cast("long").alias("per_mille"))


def rates(signals: DataFrame, key: str) -> DataFrame:
    """Per key: signals, and how many of a thousand are challenges and server errors."""
    bad = F.col("signal_type").isin("http_429", "captcha_challenge", "anti_bot_200")
    mille = lambda c: F.floor(1000 * F.count_if(c) / F.count("*")).cast("long")
    return signals.groupBy(key).agg(F.count("*").alias("signals"), mille(bad).alias("challenges_per_mille"), mille(F.col("signal_type") == "http_5xx").alias("errors_per_mille"))


def host_mix(attempts: DataFrame) -> DataFrame:
    """(host, part, item, value, per_mille): attempts of a host by error (part error: failures and statuses of 400 and more; 'none' else) and by egress address."""
    error = F.when(F.col("fetch_result") == "failed", F.coalesce("error_type", F.lit("failed"))).when(F.col("status_code") >= 400, F.concat(F.lit("HTTP_"), F.col("status_code").cast("string"))).otherwise("none")
    items = F.array(F.struct(F.lit("error").alias("part"), error.alias("item")), F.struct(F.lit("egress").alias("part"), F.coalesce("egress_local_ip", F.lit("none")).alias("item")))
    counts = attempts.select("host", F.explode(items).alias("x")).groupBy("host", "x.part", "x.item").agg(F.count("*").alias("value"))
    whole = counts.groupBy("host", "part").agg(F.sum("value").alias("n"))
    return counts.join(whole, ["host", "part"]).select("host", "part", "item", "value", F.floor(1000 * F.col("value") / F.col("n")).cast("long").alias("per_mille"))


#: Precision of the sketches: about 1 % of rank for quantiles, 1.6 % of the number for distinct URLs.
KLL_K, HLL_LG_K = 200, 12


def daily_profiles(attempts: DataFrame) -> DataFrame:
    """(host, day, attempts, failed, stored, latency, urls): counts, a KLL sketch of latency and an HLL sketch of URLs, to be stored and merged."""
    ms = (F.col("finished_at_ms") - F.col("attempted_at_ms")).cast("long")
    rows = attempts.select("host", F.to_date(F.timestamp_millis("attempted_at_ms")).alias("day"), "fetch_result", "storage_result", "url_hash", ms.alias("ms"))
    return rows.groupBy("host", "day").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("fetch_result") == "failed").alias("failed"), F.count_if(F.col("storage_result") == "stored").alias("stored"),
        F.kll_sketch_agg_bigint("ms", F.lit(KLL_K)).alias("latency"), F.hll_sketch_agg("url_hash", F.lit(HLL_LG_K)).alias("urls"),
    )


def merge_profiles(profiles: DataFrame, *keys: str) -> DataFrame:
    """Profiles of days, or of any parts, as one for each of keys (host unless given)."""
    return profiles.groupBy(*(keys or ("host",))).agg(
        *(F.sum(c).alias(c) for c in ("attempts", "failed", "stored")), F.kll_merge_agg_bigint("latency", F.lit(KLL_K)).alias("latency"), F.hll_union_agg("urls").alias("urls")
    )


def profile_estimates(profiles: DataFrame) -> DataFrame:
    """profiles with p50, p90 and p99 of latency and the number of URLs in place of the sketches."""
    q = {n: F.kll_sketch_get_quantile_bigint("latency", F.lit(r)) for n, r in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))}
    return profiles.select(*(c for c in profiles.columns if c not in ("latency", "urls")), *(c.alias(n) for n, c in q.items()), F.hll_sketch_estimate("urls").alias("urls"))


def counted(rows: DataFrame, *keys: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("value"))


def queue_events(rows: DataFrame) -> DataFrame:
    """(result, value) from one row per delivery: valid, stopped_by, outcome, wait_ms, publish_ok.

    An invalid message is acknowledged at once and counts no further. A valid one is read, delayed if it has to
    wait, and acknowledged once it is published; a retry and a failed publish leave it with its source.
    """
    ok = F.coalesce("valid", F.lit(False))
    ended = F.col("stopped_by").isNotNull() | (F.col("outcome") != "retry")
    said = F.array(
        F.when(~ok, "invalid"), F.when(ok, "read"), F.when(ok & (F.col("wait_ms") > 0), "delayed"), F.when(ok & ~ended, "retryable_failure"),
        F.when(~ok | (ended & F.col("publish_ok")), "ack"),
    )
    return rows.select(F.explode(F.filter(said, lambda x: x.isNotNull())).alias("result")).groupBy("result").agg(F.count("*").alias("value"))


def dependency_health(seen: DataFrame) -> DataFrame:
    """(dependency, status, successes, failures) of observations (dependency, ok, at_ms, n); status is that of the last one, 1 or 0."""
    last = F.max_by(F.col("ok").cast("long"), F.struct("at_ms", "n"))
    return seen.groupBy("dependency").agg(last.alias("status"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"))


def in_flight(seen: Column, acked: Column) -> Column:
    return F.greatest(F.sum(seen) - F.sum(acked), F.lit(0))


def exposition(values: DataFrame, name: str, kind: str, text: str, value: str = "value") -> DataFrame:
    """(line_no, line): a metric in the text format that scrapers read; all columns but value are labels, null ones empty.

    Help and type come first, then samples in order of their labels.
    """
    escaped = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    labels = [F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in values.columns if c != value]
    held = F.concat(F.lit("{"), F.concat_ws(",", *labels), F.lit("}")) if labels else F.lit("")
    samples = values.select(F.concat(F.lit(name), held, F.lit(" "), F.col(value).cast("string")).alias("line"))
    numbered = samples.withColumn("line_no", F.row_number().over(Window.orderBy("line")) + 2)  # as many rows as the metric has label sets
    head = values.sparkSession.createDataFrame([(1, f"# HELP {name} {text}"), (2, f"# TYPE {name} {kind}")], "line_no int, line string")
    return head.unionByName(numbered.select("line_no", "line"))
