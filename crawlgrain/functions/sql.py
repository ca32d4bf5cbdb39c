"""The library's rules under SQL names: Column rules as SQL functions that Catalyst inlines, link extraction as a table function.

    register(spark)
    spark.sql("select page_id, crawl_canonical_url(url) from pages")
    spark.sql("select p.page_id, l.* from pages p, lateral crawl_outlinks(p.html, p.url) l")

Scalar functions are temporary SQL functions made of the same expressions as the Column library, so a query that calls
them has the plan that the Column library gives, without Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from crawlgrain.functions import commands, content, ids, net, signals, urls
from crawlgrain.operators import audit, policy
from crawlgrain.session import ship

#: SQL name: (parameters with types, rule over columns of these names).
FUNCTIONS: dict[str, tuple[str, Callable[..., Column]]] = {
    "crawl_canonical_url": ("url string", urls.canonical_url),
    "crawl_url_error": ("url string", urls.url_error),
    "crawl_url_host": ("url string", urls.host),
    "crawl_url_hash": ("url string", lambda url: urls.url_hash(urls.canonical_url(url))),
    "crawl_request_host": ("url string", urls.request_host),
    "crawl_link_host": ("href string, base_host string, base_scheme string", urls.link_host),
    "crawl_hrefs": ("html string", content.hrefs),
    "crawl_is_html": ("content_type string", content.is_html),
    "crawl_contains_captcha": ("content_type string, body string", content.contains_captcha),
    "crawl_failure_reason": ("status int", content.failure_reason),
    "crawl_kept_headers": ("headers map<string,string>", content.kept_headers),
    "crawl_attempt_id": ("job_id string, canonical_url string", ids.command_attempt_id),
    "crawl_snapshot_id": ("url_hash string, fetched_ms bigint", ids.snapshot_id),
    "crawl_storage_key": ("url_hash string, host string, snapshot_id string, fetched_ms bigint", ids.storage_key),
    "crawl_stable_hash": ("value string", ids.stable_hash),
    "crawl_pair_hash": ("left_value string, right_value string", ids.pair_hash),
    "crawl_host_bucket": ("host string, buckets int", ids.host_bucket),
    "crawl_host_key": ("host string", ids.host_key),
    "crawl_rendezvous_score": ("host string, identity string", ids.rendezvous_score),
    "crawl_iso_time": ("epoch_ms bigint", ids.iso_z),
    "crawl_deadline": ("value string", commands.deadline),
    "crawl_bounded_int": ("value string", commands.bounded_int),
    "crawl_usable_ipv4": ("ip string", net.usable_ipv4),
    "crawl_observed_ip": ("body string", net.observed_ip),
    "crawl_exception_signal": ("error_type string, message string", signals.exception_signal),
    "crawl_signal_weight": ("signal_type string", signals.weight),
    "crawl_outcome": ("status int, failed boolean, deliveries int, max_retries int", policy.outcome),
    "crawl_forbidden_key": ("state_key string", audit.forbidden),
}

_OPERATOR = re.compile(r"('(?:[^'\\]|\\.)*')|(?<![\w`'])([=!<>+\-*/%|&^~]+|or|and|not|in)\(")


def _sql_text(rule: Column) -> str:
    """SQL of an expression. Operators are written as functions there, so their names are quoted."""
    return _OPERATOR.sub(lambda m: m[1] or f"`{m[2]}`(", rule._jc.node().sql())


class _Links(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")

    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.found += [v or "" for k, v in attrs if k == "href"][:1]


class Outlinks:
    """One row for each <a href> of a page, resolved against the page's URL; host is null where the target has none.

    A null page has no rows. A target that can't be resolved is null. Python's HTML parser reads the page, so names of
    characters without a semicolon are resolved wherever it resolves them.
    """

    def eval(self, html: str, base: str) -> Iterator[tuple]:
        parser = _Links()
        parser.feed(html or "")
        parser.close()
        own = self._host(base or "")
        for at, href in enumerate(parser.found):
            try:
                target = urljoin((base or "").strip(), href.strip())
            except ValueError:
                target = None
            host = self._host(target) if target is not None else None
            yield at, href, target, host, (host != own) if host else None

    @staticmethod
    def _host(url: str) -> str | None:
        try:
            return urlsplit(url.strip()).hostname or None
        except ValueError:
            return None


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session; their names. Calling it again replaces them."""
    ship(spark)
    for name, (parameters, rule) in FUNCTIONS.items():
        names = [p.split()[0] for p in re.split(r",\s*(?![^<]*>)", parameters)]
        made = rule(*map(F.col, names))
        kind = spark.createDataFrame([], parameters).select(made.alias("x")).schema["x"].dataType.simpleString()
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {_sql_text(made)}")
    spark.udtf.register("crawl_outlinks", F.udtf(Outlinks, returnType="pos int, href string, target string, host string, external boolean", useArrow=True))
    return [*FUNCTIONS, "crawl_outlinks"]
