"""The attempt fact table, its validity rules, and the tables derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlgrain.functions import content, ids, urls

# Fixed values of the domain.
SCHEMA_VERSION, PROVIDER, COMPRESSION = "1.0", "oci", "gzip"
REQUIRED = ["schema_version", "attempt_id", "url_hash", "canonical_url", "original_url", "host", "attempted_at", "finished_at", "fetch_result", "content_result", "storage_result"]
RESULTS = {
    "fetch_result": ["succeeded", "failed"],
    "content_result": ["html_snapshot_candidate", "non_snapshot", "unknown"],
    "storage_result": ["stored", "failed", "skipped"],
}

#: All 43 columns in the order of the wire format.
COLUMNS = [
    "schema_version", "attempt_id", "snapshot_id", "command_id", "trace_id", "job_id", "url_hash", "canonical_url", "original_url", "host",
    "host_id", "site_id", "tier", "politeness_key", "policy_scope_id", "policy_version", "matched_policy_scope_type", "matched_policy_scope_id",
    "policy_lkg_active", "attempted_at", "finished_at", "fetch_result", "status_code", "content_type", "response_headers", "response_time_ms",
    "bytes_downloaded", "error_type", "error_message", "content_result", "outlinks_count", "outlinks_external_count", "storage_result",
    "storage_provider", "bucket", "storage_key", "storage_etag", "compression", "content_sha256", "uncompressed_size", "compressed_size",
    "egress_local_ip", "observed_egress_ip",
]


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def crawl_attempts(results: DataFrame, bucket: str = "pages", *, compress: bool = False) -> DataFrame:
    """Facts (COLUMNS and the _ms twins of both times) from fetch results.

    results: url, job_id, status_code, content_type, fetch_failed, error_type, storage_ok, html,
    attempted_at_ms, finished_at_ms, and any of the context columns. A failed fetch is (failed, unknown,
    skipped); a status other than 200, then another type than HTML, (succeeded, non_snapshot, skipped);
    else the page is stored, or its storage failed. compressed_size needs the page's gzip form, so it is null unless compress.
    """
    own = urls.canonical_url(F.col("url"))
    own = F.coalesce(urls.canonical_url(F.col("canonical_url")), own) if "canonical_url" in results.columns else own  # a command's own wins
    rows = results.withColumn("canonical_url", own).withColumn("url_hash", urls.url_hash(F.col("canonical_url")))
    rows = rows.withColumn("host", urls.host(F.col("canonical_url")))
    failed = F.coalesce(F.col("fetch_failed"), F.lit(False))
    page = ~failed & F.coalesce(F.col("status_code") == 200, F.lit(False)) & content.is_html(F.col("content_type"))
    stored = page & F.col("storage_ok")
    body = F.coalesce("html", F.lit("")).cast("binary")
    links = F.transform(content.hrefs(F.coalesce("html", F.lit(""))), lambda h: urls.link_host(h, F.col("host"), urls.scheme(F.col("canonical_url"))))
    rows = rows.withColumns({"_page": page, "_stored": stored, "_links": F.when(page, F.filter(links, lambda x: x.isNotNull())), "_snapshot": ids.snapshot_id(F.col("url_hash"), F.col("finished_at_ms"))})
    made = {
        "schema_version": F.lit(SCHEMA_VERSION),
        "attempt_id": ids.command_attempt_id(F.col("job_id"), F.col("canonical_url")),
        "snapshot_id": F.when(F.col("_stored"), F.col("_snapshot")),
        "original_url": F.col("url"),
        "attempted_at": ids.iso_z(F.col("attempted_at_ms")),
        "finished_at": ids.iso_z(F.col("finished_at_ms")),
        "fetch_result": F.when(failed, "failed").otherwise("succeeded"),
        "status_code": F.col("status_code").cast("int"),
        "bytes_downloaded": F.when(failed, F.lit(0)).otherwise(F.octet_length(body)).cast("long"),
        "content_result": F.when(failed, "unknown").when(F.col("_page"), "html_snapshot_candidate").otherwise("non_snapshot"),
        "outlinks_count": F.when(F.col("_page"), F.size("_links")).otherwise(0).cast("int"),
        "outlinks_external_count": F.when(F.col("_page"), F.size(F.filter("_links", lambda h: h != F.col("host")))).otherwise(0).cast("int"),
        "storage_result": F.when(F.col("_stored"), "stored").when(F.col("_page"), "failed").otherwise("skipped"),
        "storage_provider": F.when(F.col("_stored"), F.lit(PROVIDER)),
        "bucket": F.when(F.col("_stored"), F.lit(bucket)),
        "storage_key": F.when(F.col("_stored"), ids.storage_key(F.col("url_hash"), F.col("host"), F.col("_snapshot"), F.col("finished_at_ms"))),
        "compression": F.when(F.col("_stored"), F.lit(COMPRESSION)),
        "content_sha256": F.when(F.col("_page"), F.sha2(body, 256)),
        "uncompressed_size": F.when(F.col("_page"), F.octet_length(body)).cast("long"),
    }
    if compress:
        made["compressed_size"] = F.octet_length(content.gzip_bytes(F.when(F.col("_page"), body))).cast("long")
    kinds = {"policy_lkg_active": "boolean", "response_headers": "map<string,string>", "response_time_ms": "long", "compressed_size": "long"}
    picked = [(made[c] if c in made else _or_null(rows, c, kinds.get(c, "string"))).alias(c) for c in COLUMNS]
    return rows.select(*picked, "attempted_at_ms", "finished_at_ms")


def terminal_attempts(stopped: DataFrame, now_ms: int, version: str, lkg_active: bool = False) -> DataFrame:
    """Facts of commands that end without a fetch. stopped: commands as policy.decide gives them, with stopped_by (paused, deadline_expired or retry_exhausted)."""
    said = (
        F.when(F.col("stopped_by") == "paused", F.coalesce("policy_pause_reason", F.lit("Fetch command paused before request start")))
        .when(F.col("stopped_by") == "deadline_expired", F.lit("Fetch command deadline expired before request start"))
        .otherwise(F.lit("Fetch command retry budget exhausted"))
    )
    ended = {
        "fetch_failed": F.lit(True), "status_code": F.lit(None).cast("int"), "content_type": F.lit(None).cast("string"), "html": F.lit(""), "storage_ok": F.lit(False),
        "egress_local_ip": F.lit(None).cast("string"), "response_time_ms": F.lit(None).cast("long"), "error_type": F.col("stopped_by"), "error_message": said, "attempted_at_ms": F.lit(now_ms), "finished_at_ms": F.lit(now_ms), "policy_version": F.lit(version),
        "matched_policy_scope_type": F.col("matched_scope_type"), "matched_policy_scope_id": F.col("matched_scope_id"), "policy_lkg_active": F.lit(lkg_active),
    }
    return crawl_attempts(stopped.withColumns(ended))


def violations(attempts: DataFrame) -> Column:
    """Sorted array of what breaks the rules of a fact."""
    found = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(f"missing {c}")) for c in REQUIRED]
    found += [F.when(~F.coalesce(F.col(c), F.lit("")).isin(values), F.lit(f"bad {c}")) for c, values in RESULTS.items()]
    found.append(F.when(~F.coalesce(F.col("url_hash"), F.lit("")).rlike("^[0-9a-f]{64}$"), F.lit("bad url_hash")))
    found.append(F.when(F.coalesce(F.col("schema_version"), F.lit("")) != SCHEMA_VERSION, F.lit("bad schema_version")))
    found.append(F.when(~F.col("status_code").between(100, 599), F.lit("bad status_code")))
    found.append(F.when(~F.col("content_sha256").rlike("^[0-9a-f]{64}$"), F.lit("bad content_sha256")))
    kept = F.col("storage_result") == "stored"
    for c in ("snapshot_id", "storage_provider", "bucket", "storage_key", "content_sha256", "compression"):
        found.append(F.when(kept & (F.coalesce(F.col(c), F.lit("")) == ""), F.lit(f"stored without {c}")))
    found.append(F.when(kept & (F.col("storage_provider") != PROVIDER), F.lit("bad storage_provider")))
    found.append(F.when(kept & (F.col("compression") != COMPRESSION), F.lit("bad compression")))
    return F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))


def crawl_logs(attempts: DataFrame) -> DataFrame:
    """One row per attempt_id: the one that finished last. max_by combines before the shuffle, a window wouldn't."""
    names = attempts.columns
    best = attempts.groupBy("attempt_id").agg(F.max_by(F.struct(*names), F.struct("finished_at_ms", F.coalesce("snapshot_id", F.lit("")))).alias("x"))
    return best.select("x.*")


def page_snapshots(attempts: DataFrame) -> DataFrame:
    """One row per snapshot that was stored."""
    names = ["snapshot_id", "attempt_id", "url_hash", "canonical_url", "host", "finished_at_ms", "content_sha256", "uncompressed_size", "storage_key"]
    kept = attempts.where("storage_result = 'stored' and snapshot_id is not null").select(*names)
    return kept.groupBy("snapshot_id").agg(F.max_by(F.struct(*names[1:]), "attempt_id").alias("x")).select("snapshot_id", "x.*")


def pages_latest(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each url_hash; failures never replace it."""
    names = snapshots.columns
    return snapshots.groupBy("url_hash").agg(F.max_by(F.struct(*names), F.struct("finished_at_ms", "snapshot_id")).alias("x")).select("x.*")


def page_metadata(attempts: DataFrame) -> DataFrame:
    return attempts.select("url_hash", "canonical_url", "host", F.col("finished_at").alias("fetched_at"), "status_code", "content_type", "outlinks_count", "outlinks_external_count", "content_sha256", "storage_key").where("storage_key is not null")


def outlink_records(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, host, external) of every link with a host."""
    base = pages.select("page_id", "links", urls.canonical_url(F.col("url")).alias("base"))
    base = base.select("page_id", "links", urls.host(F.col("base")).alias("base_host"), urls.scheme(F.col("base")).alias("base_scheme"))
    rows = base.select("page_id", "base_host", "base_scheme", F.posexplode("links").alias("pos", "href"))
    rows = rows.withColumn("host", urls.link_host(F.col("href"), F.col("base_host"), F.col("base_scheme"))).where("host is not null")
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "href", "host", (F.col("host") != F.col("base_host")).alias("external"))


def url_dedupe(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key in order; combined before the shuffle."""
    names = rows.columns
    return rows.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*names), order).alias("x")).select("x.*")


def with_context(responses: DataFrame, commands_df: DataFrame) -> DataFrame:
    """responses with the context of the command of the same attempt_id; without one the context is null.

    A command delivered more than once counts once: its last delivery by message_id.
    """
    names = [c for c in commands_df.columns if c not in responses.columns and c != "message_id"]
    last = commands_df.groupBy("attempt_id").agg(F.max_by(F.struct(*names), "message_id").alias("x")).select("attempt_id", "x.*")
    return responses.join(last, "attempt_id", "left")


def previous_attempts(attempts: DataFrame) -> DataFrame:
    """attempts with the status of the attempt before on the same URL."""
    return attempts.withColumn("previous_status", F.lag("status_code").over(Window.partitionBy("url_hash").orderBy("attempted_at_ms", "job_id")))
