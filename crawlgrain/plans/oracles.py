"""DuckDB twins of the queries, written on their own from the rules, not from the Spark code."""

from __future__ import annotations

from crawlgrain.sources.fixtures import COMMANDS, FETCH_RESULTS, IDENTITIES, NOW_MS, SIGNALS

W = 21_600_000_000
_RESULTS = FETCH_RESULTS.replace("{pages}", "pages")
_SIGNALS = SIGNALS.replace("{micros}", "epoch_us(ts)").replace("{events}", "events")
_COMMANDS = COMMANDS.replace("{pages}", "pages")

_CANON = r"""
canon0 as (select *, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) as scheme, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) as host,
  regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') as path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as q from {source}),
canon as (select *, scheme || '://' || host || path || case when q = '' then '' else '?' || array_to_string(list_sort([case when contains(x, '=') then x else x || '=' end for x in string_split(q, '&')]), '&') end as canonical_url from canon0)
"""
PAGES = "with " + _CANON.replace("{source}", "pages")
RESULTS = f"with fr as ({_RESULTS}), " + _CANON.replace("{source}", "fr")
LINK = r"regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*[\"'']([^\"'']*)[\"'']', 1)".replace(r"\"", '"')
ATTEMPTS = (
    RESULTS
    + rf""", a0 as (select *, sha256(canonical_url) as url_hash, coalesce(fetch_failed, false) as failed,
  not coalesce(fetch_failed, false) and coalesce(status_code = 200, false) and coalesce(lower(trim(string_split(content_type, ';')[1])) in ('text/html', 'application/xhtml+xml'), false) as page,
  len({LINK}) as n_links, len([x for x in {LINK} if regexp_matches(x, '^(https?:)?//') and lower(regexp_extract(x, '^(?:https?:)?//([^/?#]*)', 1)) <> host]) as n_external from canon),
a1 as (select *, page and storage_ok as stored, url_hash || ':' || finished_at_ms as snap from a0),
att as (select '1.0' as schema_version, url_hash || ':attempt:' || substr(sha256(job_id || chr(0) || canonical_url), 1, 16) as attempt_id,
  case when stored then snap end as snapshot_id, job_id, url_hash, canonical_url, url as original_url, host, tier, policy_scope_id,
  case when attempted_at_ms % 1000 = 0 then strftime(make_timestamp(attempted_at_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') else strftime(make_timestamp(attempted_at_ms * 1000), '%Y-%m-%dT%H:%M:%S.%fZ') end as attempted_at,
  case when finished_at_ms % 1000 = 0 then strftime(make_timestamp(finished_at_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') else strftime(make_timestamp(finished_at_ms * 1000), '%Y-%m-%dT%H:%M:%S.%fZ') end as finished_at,
  case when failed then 'failed' else 'succeeded' end as fetch_result, cast(status_code as integer) as status_code, content_type,
  cast(case when failed then 0 else octet_length(encode(html)) end as bigint) as bytes_downloaded, error_type,
  case when failed then 'unknown' when page then 'html_snapshot_candidate' else 'non_snapshot' end as content_result,
  cast(case when page then n_links else 0 end as integer) as outlinks_count, cast(case when page then n_external else 0 end as integer) as outlinks_external_count,
  case when stored then 'stored' when page then 'failed' else 'skipped' end as storage_result,
  case when stored then 'oci' end as storage_provider, case when stored then 'pages' end as bucket,
  case when stored then 'pages/v1/' || strftime(make_timestamp(finished_at_ms * 1000), '%Y/%m/%d') || '/' || substr(sha256(host), 1, 16) || '/' || url_hash || '/' || snap || '.html.gz' end as storage_key,
  case when stored then 'gzip' end as compression, case when page then sha256(html) end as content_sha256,
  cast(case when page then octet_length(encode(html)) end as bigint) as uncompressed_size, attempted_at_ms, finished_at_ms, stored,
  command_id, trace_id, cast(null as varchar) as host_id, cast(null as varchar) as site_id, cast(null as varchar) as politeness_key, cast(null as varchar) as policy_version, cast(null as varchar) as matched_policy_scope_type,
  cast(null as varchar) as matched_policy_scope_id, cast(null as boolean) as policy_lkg_active, cast(response_time_ms as bigint) as response_time_ms, cast(null as varchar) as error_message, cast(null as varchar) as storage_etag,
  cast(null as bigint) as compressed_size, egress_local_ip, cast(null as varchar) as observed_egress_ip from a1)
"""
)
SIG = f"""with s as ({_SIGNALS}), sig as (select *, case when status_code = 429 then 'http_429' when contains(lower(body), 'verify you are human') then 'captcha_challenge'
  when status_code = 200 and contains(lower(body), 'bot filter') then 'anti_bot_200' when status_code between 500 and 599 then 'http_5xx' else 'success' end as signal_type from s),
weighted as (select *, case signal_type when 'http_429' then 3 when 'captcha_challenge' then 5 when 'anti_bot_200' then 4 when 'http_5xx' then 1 else 0 end as weight from sig)
"""


def _gap(rows: str, keys: str, gap: int, name: str) -> str:
    """CTE `name`: rows with session."""
    return f"""{name}0 as (select *, case when ts_us - lag(ts_us) over (partition by {keys} order by ts_us, event_id) <= {gap} then 0 else 1 end as fresh from {rows}),
{name} as (select *, sum(fresh) over (partition by {keys} order by ts_us, event_id rows unbounded preceding) as session from {name}0)"""


def _distinct(rows: str, keys: str, member: str, name: str) -> str:
    return (
        _gap(rows, keys, W, name + "g")
        + f""", {name}1 as (select *, case when row_number() over (partition by {keys}, session, {member} order by ts_us, event_id) = 1 then 1 else 0 end as one from {name}g),
{name} as (select *, cast(sum(one) over (partition by {keys}, session order by ts_us, event_id rows unbounded preceding) as bigint) as n_distinct from {name}1)"""
    )


_CH = SIG + ", ch as (select *, 'AS' || (1 + cast(string_split(ip, '.')[4] as integer) % 2) as asn from sig where signal_type in ('http_429', 'captcha_challenge', 'anti_bot_200'))"
_SOFT = (
    _CH
    + ", ch2 as (select * from ch where signal_type <> 'http_429'), "
    + _gap("ch", "host, ip, signal_type", W, "own")
    + ", own_n as (select event_id, count(*) over (partition by host, ip, signal_type, session order by ts_us, event_id rows unbounded preceding) as host_ip_count from own), "
    + _distinct("ch2", "ip, signal_type", "host", "hs")
    + ", "
    + _distinct("ch2", "host, signal_type", "ip", "ps")
    + ", "
    + _distinct("ch2", "host, asn, signal_type", "ip", "ns")
    + """, soft as (select ch.*, host_ip_count, coalesce(hs.n_distinct, 0) as hosts_of_ip, coalesce(ps.n_distinct, 0) as ips_of_host, coalesce(ns.n_distinct, 0) as ips_of_host_asn,
  host_ip_count >= 2 as backoff, coalesce(hs.n_distinct, 0) >= 3 as cooldown, coalesce(ps.n_distinct, 0) >= 3 as slowdown, coalesce(ns.n_distinct, 0) >= 3 as soft_limit
  from ch join own_n using (event_id) left join hs using (event_id) left join ps using (event_id) left join ns using (event_id))"""
)
_WHO = f"who as (select *, coalesce(public_ip, bind_ip) as identity from ({IDENTITIES}) i), active as (select *, row_number() over (order by seq) - 1 as idx from who where status = 'active')"
_FAIL = """, f as (select *, event_type <> 'purchase' as failed from s where event_type in ('error', 'click', 'purchase')),
e as (select *, sum(case when failed then 0 else 1 end) over (partition by host, ip order by ts_us, event_id rows unbounded preceding) as epoch from f),
n as (select *, cast(sum(case when failed then 1 else 0 end) over (partition by host, ip, epoch order by ts_us range between {w} preceding and current row) as bigint) as failures from e)
"""
_DECIDED = f"""with fr as ({_RESULTS}), dec as (select *, case when policy_scope_id = 'scope-paused' then 'policy_scope_id' when tier in ('gold', 'bulk') then 'tier' else 'default' end as matched_scope_type,
  case when policy_scope_id = 'scope-paused' then policy_scope_id when tier in ('gold', 'bulk') then tier end as matched_scope_id from fr),
pol as (select *, matched_scope_type = 'policy_scope_id' as policy_paused, cast(case when matched_scope_id = 'gold' then 1 else 2 end as integer) as policy_max_retries,
  cast(case when matched_scope_id = 'bulk' then 2 else 4 end as integer) as policy_sticky_pool_size, cast(2000 as integer) as policy_host_ip_min_delay_ms from dec),
gate as (select result_id, case when policy_paused then 'paused' when deadline_at = '2023-12-31T00:00:00Z' then 'deadline_expired' end as stopped_by from pol),
route as (select result_id, case when not (fetch_failed or coalesce(status_code in (408, 429, 500, 502, 503, 504, 522, 524), false)) then 'fetched'
  when deliveries <= coalesce(cmd_max_retries, policy_max_retries) then 'retry' else 'retry_exhausted' end as outcome from pol)
"""

_LINKED = PAGES + f""", l as (select page_id, host as base, scheme, regexp_extract(url, '^[a-z]+://[^/?#]*') as origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path,
 ['/u' || page_id || '?a=1&b=2', '../rA', '//CDN.example.org/y', 'mailto:a@b'] || {LINK} as links from canon),
linked as (select page_id, base, scheme, origin, path, unnest(links) as href, generate_subscripts(links, 1) - 1 as pos from l)
"""

ORACLES: dict[str, str] = {
    "canonical_url": PAGES + "select page_id, canonical_url, sha256(canonical_url) as url_hash, host, host as request_host, cast(null as varchar) as error from canon",
    "canonical_url_vectors": r"""with r as (select page_id, regexp_replace(url, '^[a-z]+://', '') as rest from pages),
x as (select page_id, rest, string_split(rest, '/')[1] as h, regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/+$', '') as path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) as q from r)
select page_id, case page_id % 4 when 0 then 'http://' || lower(h) || path || case when q = '' then '' else '?' || array_to_string(list_sort(string_split(q, '&')), '&') end
  when 1 then 'https://' || lower(h) || ':8443/A?a=1&b=2&c=' end as canonical_url,
 case page_id % 4 when 2 then 'invalid port' when 3 then 'missing scheme or host' end as error from x""",
    "url_identity": PAGES + f"""select page_id, sha256(canonical_url) as dedupe_key, sha256(canonical_url) || ':attempt:{NOW_MS}' as attempt_id,
 sha256(canonical_url) || ':attempt:' || substr(sha256('job_1' || chr(0) || canonical_url), 1, 16) as command_attempt_id, substr(sha256('salt:' || host), 1, 16) as host_hash,
 substr(sha256(host || ':10.0.0.2'), 1, 16) as host_ip_hash, host as host_key, replace(replace(host, '.', '_'), '-', '_') as host_token, host || '@10.0.0.2' as slot from canon""",
    "url_dedupe": RESULTS + "select page_id, result_id from (select *, row_number() over (partition by canonical_url order by result_id) as k from canon) where k = 1",
    "storage_keys": PAGES + """, m as (select *, 1704067200000 + page_id * 86400123 as ms, sha256(canonical_url) as h from canon)
select page_id, h || ':' || ms as snapshot_id, 'pages/v1/' || strftime(make_timestamp(ms * 1000), '%Y/%m/%d') || '/' || substr(sha256(host), 1, 16) || '/' || h || '/' || h || ':' || ms || '.html.gz' as storage_key,
 case when ms % 1000 = 0 then strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%SZ') else strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%fZ') end as fetched_at from m""",
    "content_artifact": "select page_id, sha256(html) as content_sha256, cast(octet_length(encode(html)) as bigint) as uncompressed_size from pages",
    "content_flags": f"""with fr as ({_RESULTS}) select result_id, coalesce(lower(trim(string_split(content_type, ';')[1])) in ('text/html', 'application/xhtml+xml'), false) as is_html,
 (content_type is null or lower(content_type) like '%text%' or lower(content_type) like '%html%') and (page_id % 7 = 0 or lower(substr(html, 1, 131072)) similar to '.*(captcha|verify you are human).*') as captcha,
 case when status_code in (403, 429, 503) then 'HTTP_' || status_code end as failure_reason from fr""",
    "outlink_records": PAGES + f""", l as (select page_id, host as base, {LINK} || [x for x in [case when page_id % 4 = 0 then 'https://ext.example.net/x' end, case when page_id % 5 = 0 then 'mailto:a@b' end, case when page_id % 7 = 0 then '//cdn.example.org/y' end] if x is not null] as links from canon),
u as (select page_id, base, unnest(links) as href, generate_subscripts(links, 1) - 1 as pos from l),
h as (select *, case when starts_with(href, 'https://ext') then 'ext.example.net' when starts_with(href, '//') then 'cdn.example.org' when starts_with(href, 'mailto:') then null else base end as host from u)
select page_id, cast(pos as bigint) as pos, href, host, host <> base as external from h where host is not null""",
    "link_targets": _LINKED + "select page_id, cast(pos as integer) as pos, href from linked",
    "sql_outlinks": _LINKED + """select page_id, cast(pos as integer) as pos, href, target, lower(regexp_extract(target, '^https?://([^/]*)', 1)) as host, lower(regexp_extract(target, '^https?://([^/]*)', 1)) <> base as external from
 (select *, case when starts_with(href, '/') and not starts_with(href, '//') then origin || href when href = '../rA' then origin || regexp_replace(regexp_replace(path, '/[^/]*$', ''), '/[^/]*$', '') || '/rA' when starts_with(href, '//') then scheme || ':' || href end as target from linked)
 where href <> 'mailto:a@b' union all select page_id, cast(pos as integer), href, href, null, null from linked where href = 'mailto:a@b'""",
    "sql_rules": PAGES + f"""select page_id, canonical_url, sha256(canonical_url) as url_hash, host, cast(('0x' || substr(sha256(host), 1, 8)) as bigint) % 8 as bucket,
 sha256(canonical_url) || ':attempt:' || substr(sha256('job_1' || chr(0) || canonical_url), 1, 16) as attempt_id, case when 400 + page_id % 60 in (408, 429) then 'retry_exhausted' else 'fetched' end as outcome, cast(len({LINK}) as integer) as links from canon""",
    "response_headers": "select page_id, 'text/html' as content_type, 's' || (page_id % 3) as server, cast(2 as bigint) as n from pages",
    "command_validation": f"""with c as ({_COMMANDS}) select command_no, case when trim(url) = '' then 'missing url' when trim(job_id) = '' then 'missing job_id' when canonical_url is null then 'missing canonical_url'
 when url not like '%://%' then 'invalid url' when url like '%:99999/%' then 'invalid url' when deadline_at = 'soon' then 'invalid deadline_at' when max_retries in ('-1', 'x') then 'invalid max_retries' end as error,
 true as has_context from c""",
    "command_duplicates": f"with c as ({_COMMANDS}), " + _CANON.replace("{source}", "(select trim(job_id) as job_id, url from c where url like 'http%://%' and url not like '%:99999/%')") + """, b as (select job_id, unnest([canonical_url,
  case when scheme = 'http' and regexp_matches(url, '^https?://[^/?#:]+/') then 'http://' || host || ':443' || substr(canonical_url, length('http://' || host) + 1) else canonical_url end]) as canonical_url from canon)
select job_id, canonical_url, count(*) as n from b where job_id <> '' group by all having count(*) > 1""",
    "command_generation": "select 'seed:' || lpad(cast(row_number() over (order by page_id) as varchar), 8, '0') as command_id, 'job_1' as job_id, url from pages",
    "command_wire_fields": f"with c as ({_COMMANDS}) select cast(command_no as varchar) as command_no, coalesce(deadline_at, '') as deadline_at, tier, cast(4 as bigint) as n from c",
    "command_jsonl": "select case when page_id % 5 in (3, 4) then url end as url, case when page_id % 5 in (3, 4) then 'job_' || page_id end as job_id, case when page_id % 5 in (0, 2) then 'no JSON object' end as error from pages where page_id % 5 <> 1",
    "seed_scan": "select trim(url) as url from pages where page_id % 5 > 1",
    "repeat_seeds": "select cast(r as integer) as round, page_id from pages, range(3) t(r) order by r, page_id limit 100",
    "pending_reclaim": f"with fr as ({_RESULTS}) select result_id as message_id, cast(deliveries as bigint) as deliveries, (result_id * 7919) % 1200000 as idle_ms from fr where (result_id * 7919) % 1200000 >= 600000",
    "delivery_counts": f"with fr as ({_RESULTS}) select result_id as message_id, cast(case when result_id % 3 = 0 then 3 else deliveries end as bigint) as deliveries from fr",
    "policy_decision": _DECIDED + "select result_id, matched_scope_type, matched_scope_id, policy_paused, policy_max_retries, policy_sticky_pool_size, policy_host_ip_min_delay_ms from pol",
    "policy_gate": _DECIDED + "select * from gate",
    "retry_routing": _DECIDED + "select * from route",
    "host_bucket": PAGES + "select host, cast(('0x' || substr(sha256(host), 1, 8)) as bigint) % 8 as bucket from (select distinct host from canon)",
    "identity_map_join": f"""with s as ({_SIGNALS}), i as ({IDENTITIES}), m as (select bind_ip, public_ip from i where seq <> 3) select s.event_id, s.ip as bind_ip, m.public_ip, coalesce(m.public_ip, s.ip) as identity,
 case when m.public_ip is null then 'bind_ip' else 'public_ip' end as identity_type from s left join m on m.bind_ip = s.ip""",
    "usable_ips": "select '10.0.0.' || (page_id % 40) as ip, min(page_id) as first_seen from pages where page_id % 5 > 1 and page_id % 40 <> 7 group by 1",
    "sticky_pool_topk": PAGES + f", {_WHO}" + """, r as (select host, identity, row_number() over (partition by host order by sha256('salt:' || host || ':' || identity) desc) as rank from (select distinct host from canon) h, active)
select host, rank, identity from r where rank <= 4""",
    "sticky_by_host": PAGES + f", {_WHO}" + """, h as (select distinct host, cast(('0x' || substr(sha256(host), 1, 8)) as bigint) % (select count(*) from active) as bucket from canon),
b as (select host, '10.0.0.3' as identity from canon where page_id % 3 = 0 union select host, '198.51.100.4' from canon where page_id % 2 = 0),
p as (select h.host, a.identity, (a.idx - h.bucket + (select count(*) from active)) % (select count(*) from active) as step from h, active a where not exists (select 1 from b where b.host = h.host and b.identity = a.identity))
select h.host, arg_min(p.identity, p.step) as identity from h left join p using (host) group by h.host""",
    "round_robin_assign": f"with {_WHO}, p as (select page_id, (row_number() over (order by page_id) - 1) % (select count(*) from active) as idx from pages) select page_id, identity from p join active using (idx)",
    "egress_select": f"""with s as ({_SIGNALS}), {_WHO}, q as (select event_id, host, ts_us // 1000 as now_ms, cast(substr(host, 2, 1) as integer) as num from s),
hosts as (select distinct host, num from q), pool as (select * from (select host, num, identity, seq, row_number() over (partition by host order by sha256(host || ':' || identity) desc) as rank from hosts, active) where rank <= 3),
t as (select q.*, p.identity, p.rank, coalesce(p.seq % 3 = 0 and 1704067200000 + p.seq * 86400000 > now_ms, false) as cold, case when p.seq % 3 = 0 then 1704067200000 + p.seq * 86400000 end as cold_until,
  case when p.seq % 2 = 0 and q.num % 2 = p.seq % 4 then 1704067200000 + p.seq * 200000000 end as next_ms from q join pool p using (host)),
b as (select event_id, min(case when cold then cold_until end) as free_at, arg_min(identity, case when not cold then (case when coalesce(next_ms > now_ms, false) then 1000 else 0 end) + rank end) as identity,
  min(case when not cold then (case when coalesce(next_ms > now_ms, false) then 1000 else 0 end) + rank end) as best from t group by event_id),
bt as (select b.*, t.next_ms from b left join t on t.event_id = b.event_id and t.identity = b.identity and b.best is not null)
select q.event_id, q.host, case when best is null then null else identity end as identity, case when best is null then coalesce(free_at, now_ms + 2000) when best > 1000 then next_ms else now_ms end as start_ms,
 cast(case when num % 3 = 0 and 1704067200000 + 1000000000 > now_ms then 6000 else 2000 end as bigint) as delay_ms from q left join bt using (event_id)""",
    "later_pacer": f"""with s as ({_SIGNALS}), r as (select host, ip as identity, max(event_id) % 100 as l, (min(event_id) * 13) % 100 as r from s group by all),
x as (select host, identity, case when identity <> '10.0.0.3' then l end as l, case when identity <> '10.0.0.4' then r end as r from r)
select host, identity, greatest(l, r) as next_allowed_ms, case when coalesce(r, -1) > coalesce(l, -1) then 'remote' else 'local' end as origin from x""",
    "response_signal": SIG + "select event_id, signal_type, cast(weight as bigint) as weight from weighted",
    "exception_signal": """select page_id, case when page_id % 3 = 0 or page_id % 4 = 0 then 'timeout' else 'connection_failed' end as signal_type, page_id % 3 <> 2 as global_error from pages""",
    "failure_window": f"with s as ({_SIGNALS})" + _FAIL.replace("{w}", str(W - 1)) + "select event_id, failures, failed and failures >= 5 as triggered from n",
    "failure_window_local": f"with s as ({_SIGNALS})" + _FAIL.replace("{w}", str(W)) + "select event_id, failures, failed and (failures >= 5 or contains(body, 'human')) as triggered from n",
    "ip_failures": f"""with s as ({_SIGNALS}) select ip, max(n) as failures, cast(max(case when k = n then status_code end) as bigint) as last_status from
 (select *, row_number() over (partition by ip order by ts_us, event_id) as k, count(*) over (partition by ip) as n from s where status_code <> 200) group by ip""",
    "signal_gap_counter": SIG + ", ns as (select * from weighted where signal_type <> 'success'), " + _gap("ns", "host, ip, signal_type", W, "g")
    + """ select event_id, cast(session as bigint) as session, count(*) over w as count, cast(sum(weight) over w as bigint) as weight_sum from g window w as (partition by host, ip, signal_type, session order by ts_us, event_id rows unbounded preceding)""",
    "signal_gap_distinct": SIG + ", ns as (select * from weighted where signal_type <> 'success'), " + _distinct("ns", "ip, signal_type", "host", "g")
    + """ select event_id, n_distinct as distinct, cast(sum(weight) over (partition by ip, signal_type, session order by ts_us, event_id rows unbounded preceding) as bigint) as weight_sum from g""".replace("as distinct", 'as "distinct"'),
    "softban_events": _SOFT + " select event_id, host_ip_count, hosts_of_ip, ips_of_host, ips_of_host_asn, backoff, cooldown, slowdown, soft_limit from soft",
    "backoff_schedule": _SOFT + ", hits as (select * from soft where backoff), " + _gap("hits", "host, ip", 86_400_000_000, "b")
    + """, lv as (select *, count(*) over (partition by host, ip, session order by ts_us, event_id rows unbounded preceding) as level from b)
select event_id, level, cast(least(5000 * pow(2, least(level, 60) - 1), 300000) as bigint) as delay_ms, ts_us // 1000 + cast(least(5000 * pow(2, least(level, 60) - 1), 300000) as bigint) as next_allowed_ms from lv""",
    "pacer_schedule": f"""with s as ({_SIGNALS}), r as (select event_id, host, ts_us // 1000 as arrive_ms, row_number() over (partition by host order by ts_us // 1000, event_id) - 1 as i from s),
m as (select *, i * 1800000 + max(arrive_ms - i * 1800000) over (partition by host order by arrive_ms, event_id rows unbounded preceding) as start_ms from r)
select event_id, host, arrive_ms, start_ms, start_ms - arrive_ms as wait_ms from m""",
    "state_key_audit": f"""with s as ({_SIGNALS}), k as (select (case when event_id % 9 = 2 then 'other:' else 'fetch:state:' end) || (case event_id % 9 when 0 then 'profile' when 1 then 'Rank' else 'host_ip' end) || ':' || substr(sha256(host || (event_id % 50)), 1, 16) as key,
 greatest(1, least(event_id, 86400)) as t from s), a as (select key, case when t % 10 = 0 then -1 else t end as ttl from k), fresh as (select key, max(ttl) as ttl from a where key not in (select key from a where ttl % 4 = 1) group by key),
j as (select *, split_part(key, ':', -2) in ('profile', 'Rank') as bad from fresh),
c as (select count(*) as new_keys, count(*) filter (bad or starts_with(key, 'other')) as out_of_prefix, count(*) filter (bad) as forbidden, count(*) filter (not bad and not starts_with(key, 'other') and ttl <= 0) as missing_ttl from j)
select *, out_of_prefix + forbidden + missing_ttl = 0 as passed from c""",
    "crawl_attempts": ATTEMPTS + "select * exclude (attempted_at_ms, finished_at_ms, stored) from att",
    "attempt_violations": ATTEMPTS + """select attempt_id, array_to_string(list_sort([x for x in [case when substr(url_hash, 1, 1) = '3' then 'missing host' end, case when substr(url_hash, 1, 1) = '2' and upper(url_hash) <> url_hash then 'bad url_hash' end,
 case when substr(url_hash, 1, 1) = '0' then 'bad status_code' end, case when substr(url_hash, 1, 1) = '1' and stored then 'stored without storage_key' end, case when substr(url_hash, 1, 1) = '4' then 'bad schema_version' end,
 case when substr(url_hash, 1, 1) = '5' and content_sha256 is not null then 'bad content_sha256' end, case when substr(url_hash, 1, 1) = '6' and stored then 'stored without snapshot_id' end] if x is not null]), ';') as violations from att""",
    "crawl_logs": ATTEMPTS + """select attempt_id, case when status_code = 200 then finished_at_ms + 5 else finished_at_ms end as finished_at_ms, case when status_code = 200 then 'failed' else storage_result end as storage_result
 from (select *, row_number() over (partition by attempt_id order by finished_at_ms desc) as k from att) where k = 1""",
    "page_snapshots": ATTEMPTS + "select snapshot_id, max(attempt_id) as attempt_id, max(content_sha256) as content_sha256, max(storage_key) as storage_key from att where stored group by snapshot_id",
    "pages_latest": ATTEMPTS + "select url_hash, snapshot_id, finished_at_ms, uncompressed_size from (select *, row_number() over (partition by url_hash order by finished_at_ms desc, snapshot_id desc) as k from att where stored) where k = 1",
    "page_metadata": ATTEMPTS + "select url_hash, canonical_url, host, finished_at as fetched_at, status_code, content_type, outlinks_count, outlinks_external_count, content_sha256, storage_key from att where stored",
    "attempt_changes": ATTEMPTS + "select attempt_id, status_code, lag(status_code) over (partition by url_hash order by attempted_at_ms, job_id) as previous_status from att",
    "fact_messages": ATTEMPTS + """select attempt_id as key, '{"attempt_id":"' || attempt_id || '","error_type":' || case when error_type is null then 'null' else '"' || error_type || '"' end || ',"host":"' || host || '","status_code":' || coalesce(cast(status_code as varchar), 'null') || '}' as value from att""",
    "host_profile": ATTEMPTS + """select host, count(*) as attempts, count(*) filter (stored) as stored, count(*) filter (fetch_result = 'failed') as failed, cast(sum(bytes_downloaded) as bigint) as bytes, cast(sum(outlinks_count) as bigint) as outlinks,
 cast(sum(finished_at_ms - attempted_at_ms) as bigint) as latency_ms, max(finished_at_ms - attempted_at_ms) as max_latency_ms, count(distinct url_hash) as urls from att group by host""",
    "host_latency": ATTEMPTS + """select host, quantile_disc(finished_at_ms - attempted_at_ms, 0.5) as p50, quantile_disc(finished_at_ms - attempted_at_ms, 0.9) as p90, quantile_disc(finished_at_ms - attempted_at_ms, 0.99) as p99 from att group by host""",
    "request_rollup": ATTEMPTS + """select coalesce(host, '*') as host, coalesce(status, '*') as status, coalesce(storage_result, '*') as storage_result, count(*) as value
 from (select host, coalesce(cast(status_code as varchar), 'error') as status, storage_result from att) group by cube (host, status, storage_result)""",
    "metric_requests": ATTEMPTS + "select host, coalesce(cast(status_code as varchar), 'error') as status, egress_local_ip as egress_ip, count(*) as value from att group by all",
    "metric_response_seconds": ATTEMPTS + """, b as (select unnest([5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000]) as ms, unnest(['0.005', '0.01', '0.025', '0.05', '0.075', '0.1', '0.25', '0.5', '0.75', '1', '2.5', '5', '7.5', '10']) as le union all select 1000000000000, '+Inf')
select fetch_result, le, count(*) filter (finished_at_ms - attempted_at_ms <= ms) as value from att, b group by fetch_result, le""",
    "metric_content_skips": ATTEMPTS + "select case when fetch_result = 'failed' then 'fetch_failed' when status_code <> 200 then 'non_200_status' else 'non_html_content' end as reason, count(*) as value from att where storage_result = 'skipped' group by 1",
    "metric_storage_uploads": ATTEMPTS + "select 'oci' as provider, 'pages' as bucket, storage_result, count(*) as value, cast(sum(uncompressed_size) as bigint) as bytes from att where storage_result <> 'skipped' group by 3",
    "metric_feedback_signals": SIG + f", i as ({IDENTITIES}) select asn, count(*) as signals, count(*) filter (signal_type in ('http_429', 'captcha_challenge', 'anti_bot_200')) as challenges, 1000 * count(*) filter (signal_type in ('http_429', 'captcha_challenge', 'anti_bot_200')) // count(*) as per_mille from sig join i on bind_ip = ip group by asn",
    "metric_terminal": _DECIDED + "select result, count(*) as value from (select stopped_by as result from gate where stopped_by is not null union all select outcome from route where outcome <> 'fetched') group by result",
    "metric_in_flight": f"with fr as ({_RESULTS}) select job_id, cast(count(*) - count(*) filter (storage_ok) as bigint) as in_flight from fr group by job_id",
    "observed_ips": "select page_id, case page_id % 3 when 0 then '10.1.1.' || (page_id % 200) when 1 then '10.2.2.' || (page_id % 200) else '' end as ip from pages",
    "pause_flags": "select page_id, page_id % 4 in (0, 3) as paused, page_id % 4 in (2, 3) as all_interfaces from pages",
}
ORACLES["outlink_counts"] = f"select page_id, count(*) as links, count(*) filter (external) as external from ({ORACLES['outlink_records']}) group by page_id"
ORACLES["delayed_buffer"] = f"""select host, start_ms <= 1705363200000 as due, count(*) as n, min(arrive_ms) as oldest_ms, max(wait_ms) as longest_ms from ({ORACLES['pacer_schedule']}) where arrive_ms <= 1705363200000 group by all"""
_BL = f"with s as ({_SIGNALS})" + _FAIL.replace("{w}", str(W - 1)) + """, t as (select *, failed and failures >= 5 as triggered from n),
bl as (select *, max(triggered) over (partition by host, ip order by ts_us range between 1799999999 preceding and current row) as blacklisted from t)
"""
_KEYS = ORACLES["state_key_audit"].partition("j as (")[0].rstrip().rstrip(",") + " "


def _buckets(rows: str, keys: str, value: str, limits: list[tuple[int, str]]) -> str:
    """A cumulative histogram of value, in ms, as rows (keys, le, value)."""
    le = " union all ".join(f"select {ms} as ms, '{name}' as le" for ms, name in [*limits, (10**15, "+Inf")])
    return f"select {keys}, le, count(*) filter ({value} <= ms) as value from ({rows}) r, ({le}) b group by all"


_TTL = [(60_000, "60"), (600_000, "600"), (3_600_000, "3600"), (86_400_000, "86400")]
ORACLES |= {
    "blacklist_state": _BL + "select event_id, triggered, blacklisted from bl",
    "metric_blacklist_pairs": _BL + "select ip, count(*) filter (on_list) as value from (select host, ip, arg_max(blacklisted, (ts_us, event_id)) as on_list from bl group by host, ip) group by ip",
    "command_payload": """select page_id, case page_id % 5 when 3 then url when 4 then 'http://own.example/' end as url, case page_id % 5 when 2 then 'x' when 3 then 'job_' || page_id when 4 then 'own' end as job_id,
 case when page_id % 5 = 3 then 'gold' end as tier, cast(case when page_id % 5 = 3 then page_id % 7 end as bigint) as max_retries,
 case page_id % 5 when 0 then 'invalid payload json' when 1 then 'payload must be a JSON object' when 2 then 'missing url' end as error from pages""",
    "terminal_attempts": _DECIDED + ", ended as (select pol.*, coalesce(gate.stopped_by, route.outcome) as stopped_by from pol join gate using (result_id) join route using (result_id) where coalesce(gate.stopped_by, route.outcome) not in ('fetched', 'retry')), "
    + _CANON.replace("{source}", "ended") + f""" select '1.0' as schema_version, sha256(canonical_url) || ':attempt:' || substr(sha256(job_id || chr(0) || canonical_url), 1, 16) as attempt_id, cast(null as varchar) as snapshot_id,
 command_id, trace_id, job_id, sha256(canonical_url) as url_hash, canonical_url, url as original_url, host, cast(null as varchar) as host_id, cast(null as varchar) as site_id, tier,
 cast(null as varchar) as politeness_key, policy_scope_id, 'v1' as policy_version, matched_scope_type as matched_policy_scope_type, matched_scope_id as matched_policy_scope_id, false as policy_lkg_active,
 '2024-01-31T00:00:00Z' as attempted_at, '2024-01-31T00:00:00Z' as finished_at, 'failed' as fetch_result, cast(null as integer) as status_code, cast(null as varchar) as content_type, cast(null as bigint) as response_time_ms,
 cast(0 as bigint) as bytes_downloaded, stopped_by as error_type, case stopped_by when 'paused' then 'maintenance' when 'deadline_expired' then 'Fetch command deadline expired before request start' else 'Fetch command retry budget exhausted' end as error_message,
 'unknown' as content_result, cast(0 as integer) as outlinks_count, cast(0 as integer) as outlinks_external_count, 'skipped' as storage_result, cast(null as varchar) as storage_provider, cast(null as varchar) as bucket,
 cast(null as varchar) as storage_key, cast(null as varchar) as storage_etag, cast(null as varchar) as compression, cast(null as varchar) as content_sha256, cast(null as bigint) as uncompressed_size, cast(null as bigint) as compressed_size,
 cast(null as varchar) as egress_local_ip, cast(null as varchar) as observed_egress_ip from canon""",
    "metric_policy_decisions": _DECIDED + "select matched_scope_type, count(*) as value from pol group by 1",
    "metric_stopped": _DECIDED + "select stopped_by, matched_scope_type, case when stopped_by = 'paused' then 'maintenance' end as reason, count(*) as value from pol join gate using (result_id) where stopped_by is not null group by all",
    "metric_signals_by_type": SIG + "select signal_type, 'host_ip' as dimension, count(*) as value, cast(sum(weight) as bigint) as weight from weighted group by signal_type",
    "metric_soft_ban_totals": _SOFT + """ select metric, reason, asn, count(*) as value from (select 'ip_cooldown' as metric, 'cross_host_challenge' as reason, '' as asn from soft where cooldown
 union all select 'host_slowdown', 'multi_ip_challenge', '' from soft where slowdown union all select 'host_asn_soft_limit', 'host_asn_challenge', asn from soft where soft_limit) group by all""",
    "metric_active_states": _SOFT + """, now as (select max(ts_us) as t from soft) select metric, count(*) filter (until_us > t) as value from (select 'ip_cooldown' as metric, max(ts_us) + 1800000000 as until_us from soft where cooldown group by ip
 union all select 'host_slowdown', max(ts_us) + 600000000 from soft where slowdown group by host), now group by metric""",
    "metric_backoff_seconds": _buckets(f"select event_id, signal_type, delay_ms from ({ORACLES['backoff_schedule']}) join ({_SOFT} select event_id, signal_type from soft) using (event_id)", "signal_type", "delay_ms", [(1000, "1"), (5000, "5"), (10_000, "10"), (30_000, "30"), (60_000, "60"), (300_000, "300")]),
    "metric_pacer_delay": _buckets(ORACLES["pacer_schedule"], "'host_interval' as reason", "wait_ms", [(1000, "1"), (10_000, "10"), (60_000, "60"), (600_000, "600"), (3_600_000, "3600"), (86_400_000, "86400")]),
    "metric_egress_selected": f"select 'STICKY_POOL' as strategy, case when identity is null then 'unavailable' when identity like '198.%' then 'public_ip' else 'bind_ip' end as egress_identity_type, count(*) as value from ({ORACLES['egress_select']}) group by all",
    "metric_sticky_pools": f"select size, count(*) as value from (select host, count(*) as size from ({ORACLES['sticky_pool_topk']}) group by host) group by size",
    "metric_active_ips": f"with s as ({_SIGNALS}) select status, count(*) as value from ({IDENTITIES}) i where bind_ip in (select ip from s) group by status",
    "metric_forbidden_keys": _KEYS + "select lower(split_part(key, ':', -2)) as pattern, count(*) as value from fresh where split_part(key, ':', -2) in ('profile', 'Rank') group by 1",
    "metric_state_ttl": _buckets(_KEYS + "select split_part(key, ':', -2) as state_type, ttl * 1000 as ms_value from a where ttl > 0", "state_type", "ms_value", _TTL),
    "gzip_roundtrip": "select page_id, html is not null as ok, sha256(html) as sha256, cast(octet_length(encode(html)) as bigint) as size from pages",
    "stream_dedupe": "select event_id, user_id, event_type from events",
}

# --- workers, state and the command loop ------------------------------------------------------

_SEEN = f"""with fr as ({_RESULTS}), tried as (select result_id, not coalesce(fetch_failed, false) and coalesce(status_code = 200, false)
 and coalesce(lower(trim(string_split(content_type, ';')[1])) in ('text/html', 'application/xhtml+xml'), false) as page, storage_ok, publish_ok, finished_at_ms from fr),
seen as (select 'oci' as dependency, storage_ok as ok, finished_at_ms as at_ms, result_id as n from tried where page union all select 'kafka', publish_ok, finished_at_ms, result_id from tried)
"""
_WORKER = """with w as (select event_id, 'node-' || event_id % 5 as node, 'pod-' || event_id % 11 as pod, case event_id % 4 when 0 then ' fixed-' || event_id % 3 || ' ' when 1 then '  ' end as explicit,
 case event_id % 3 when 0 then 'c-{node_name}-$(POD_NAME)' when 1 then '${NODE_NAME}/{POD_NAME}' end as template, event_id % 6 = 0 as nameless, event_id % 2 = 0 as debug from events)
"""
_WRITES = f"""with s as ({_SIGNALS}), w as (select 'fetch:state:host:' || substr(sha256(host), 1, 16) || ':' || event_id % 40 as key, ts_us // 1000 as at_ms, event_id as n, event_type, cast(status_code as varchar) as status,
 least(greatest((event_id * 7919) % 100000, 1), 86400) as ttl from s),
r as (select *, at_ms + ttl * 1000 as till from w where at_ms <= 1705449600000),
l as (select *, case when lag(till) over (partition by key order by at_ms, n) > at_ms then 0 else 1 end as fresh from r),
v as (select *, sum(fresh) over (partition by key order by at_ms, n rows unbounded preceding) as life from l),
ends as (select key, max(life) as life, arg_max(till, (at_ms, n)) as expires_ms from v group by key having arg_max(till, (at_ms, n)) > 1705449600000),
alive as (select key, expires_ms, arg_max(event_type, (at_ms, n)) as kind, arg_max(status, (at_ms, n)) filter (event_type = 'error') as status from v join ends using (key, life) group by key, expires_ms)
"""
ORACLES["metric_response_seconds"] = _buckets(ATTEMPTS + "select host, egress_local_ip as egress_ip, finished_at_ms - attempted_at_ms as took from att", "host, egress_ip", "took", [(5, "0.005"), (10, "0.01"), (25, "0.025"), (50, "0.05"), (75, "0.075"), (100, "0.1"), (250, "0.25"), (500, "0.5"), (750, "0.75"), (1000, "1"), (2500, "2.5"), (5000, "5"), (7500, "7.5"), (10_000, "10")])
ORACLES |= {
    "response_context": f"with fr as ({_RESULTS}) select result_id, case when page_id % 4 <> 0 then tier end as tier, case when page_id % 4 <> 0 then policy_scope_id end as policy_scope_id from fr",
    "consumer_names": _WORKER + """select event_id, case when event_id % 4 = 0 then 'fixed-' || event_id % 3 when nameless then 'box' when event_id % 3 = 0 then 'c-' || node || '-' || pod when event_id % 3 = 1 then node || '/' || pod else node || '-' || pod end as consumer,
 case when debug then 'commands-debug:' || node else 'commands' end as stream, case when debug then 'workers-debug:' || node else 'workers' end as grp from w""",
    "worker_readiness": "select event_id, event_id % 3 <> 0 and event_id % 5 <> 0 and (event_id * 37) % 100 - 20 <= 30 as ready, case when event_id % 5 <> 0 then cast(greatest((event_id * 37) % 100 - 20, 0) as double) end as age from events",
    "header_decode": "select page_id, 'text/' || page_id as content_type, case when page_id % 2 = 0 then 'caf' || chr(233) else 'ok' end as server from pages",
    "state_key_rules": """select event_id, case event_id % 6 when 0 then 'blank prefix' when 1 then 'blank part' when 2 then 'unsafe part' when 3 then 'forbidden marker' end as error,
 case when event_id % 6 = 4 then 'p:ip:a' || event_id when event_id % 6 = 5 then 'fetch:state:ip:a' || event_id end as key from events""",
    "state_alive": _WRITES + "select key, expires_ms, kind, status from alive",
    "state_prefix_count": _WRITES + "select count(*) as n from alive where key like 'fetch:state:host:%'",
    "metric_state_reads": _WRITES + "select 'host' as state_type, case when a.key is null then 'miss' else 'hit' end as result, count(*) as value from (select distinct key from w) k left join alive a using (key) group by all",
    "metric_state_writes": _WRITES + "select 'host' as state_type, case when n % 10 = 0 then 'failed_open' else 'written' end as result, count(*) as value from w group by all",
    "state_store": _WRITES + "select key, expires_ms, kind, status from alive",
    "queue_facts": f"with fr as ({_RESULTS}), r as (select *, coalesce(fetch_failed, false) or coalesce(status_code in (408, 429, 500, 502, 503, 504, 522, 524), false) as again from fr) select command_id, case when again then 'retry_exhausted' else 'fetched' end as outcome, cast(case when again then coalesce(cmd_max_retries, 2) + 1 else 1 end as integer) as deliveries from r",
    "metric_publishes": f"with fr as ({_RESULTS}) select 'crawl.attempts' as topic, case when publish_ok then 'success' else 'failure' end as result, count(*) as value from fr group by all",
    "metric_dependency_health": _SEEN + "select dependency, cast(arg_max(ok, (at_ms, n)) as bigint) as status, count(*) filter (ok) as successes, count(*) filter (not ok) as failures from seen group by dependency",
    "metric_heartbeat": "select 'node-' || event_id % 5 || '-pod-' || event_id % 11 as consumer, cast(max(epoch_us(ts)) // 1000000 as bigint) as value from events group by 1",
    "metric_queue_events": _DECIDED + """, d as (select result_id, page_id % 12 <> 0 as valid, gate.stopped_by is not null or route.outcome <> 'retry' as ended, publish_ok, page_id % 5 = 0 as waits from pol join gate using (result_id) join route using (result_id)),
 x as (select 'invalid' as result, not valid as on_ from d union all select 'read', valid from d union all select 'delayed', valid and waits from d union all select 'retryable_failure', valid and not ended from d union all select 'ack', not valid or (ended and publish_ok) from d)
 select result, count(*) as value from x where on_ group by result""",
    "metric_delay_expired": f"select 'host_interval' as reason, count(*) as value from ({ORACLES['pacer_schedule']}) where wait_ms >= 3600000 group by 1",
    "metric_identity_unavailable": f"""with s as ({_SIGNALS}), {_WHO}, pool as ({ORACLES['sticky_pool_topk']}) select 'ip_cooldown' as reason, count(*) as value from s join (select page_host.host, who.identity, 1704067200000 + who.seq * 86400000 as until_ms
 from (select distinct host from s) page_host, who where seq % 3 = 0 and status = 'active') c on c.host = s.host where s.ts_us // 1000 < c.until_ms""",
    "metric_sticky_assignments": f"with s as ({_SIGNALS}) select 'sticky_pool' as strategy, count(*) as value from s",
    "metric_policy_loads": "select case event_id % 7 when 0 then 'invalid' when 1 then 'error' when 2 then 'not_modified' else 'success' end as result, count(*) as value from events group by 1",
    "metric_policy_state": """with l as (select event_id, epoch_us(ts) as us, case event_id % 7 when 0 then 'invalid' when 1 then 'error' when 2 then 'not_modified' else 'success' end as result from events),
 g as (select arg_max('v' || event_id, (us, event_id)) as version, max(us) as us from l where result = 'success') select g.version, (select arg_max(result in ('invalid', 'error'), (us, event_id)) from l) as lkg_active,
 case when (select arg_max(result in ('invalid', 'error'), (us, event_id)) from l) then cast((1706659200000000 - us) // 1000000 as bigint) else 0 end as lkg_age_seconds from g""",
    "stream_sessions": _gap("(select user_id % 7 as host, epoch_us(ts) as ts_us, event_id from events where event_type = 'error')", "host", 21_600_000_000, "w0").join(["with ", " select host, min(ts_us) as start_us, max(ts_us) + 21600000000 as end_us, count(*) as count from w0 group by host, session"]),
}

ORACLES["failure_window_spans"] = ORACLES["failure_window"]
ORACLES["signal_gap_counter_spans"] = ORACLES["signal_gap_counter"]
ORACLES["softban_events_spans"] = ORACLES["softban_events"]
ORACLES["pacer_schedule_spans"] = ORACLES["pacer_schedule"]
ORACLES["pages_latest_stream"] = ORACLES["pages_latest"]
ORACLES["state_as_of"] = f"""with s as ({_SIGNALS}), b as ({ORACLES["backoff_schedule"]}), bt as (select s.host, s.ip, s.ts_us, s.event_id, level, next_allowed_ms from b join s using (event_id)),
 sl as (select s.host, s.ts_us, s.event_id from ({ORACLES["softban_events"]}) x join s using (event_id) where slowdown),
 o as (select s.event_id, any_value(s.ts_us) as ts_us, arg_max(bt.next_allowed_ms, (bt.ts_us, bt.event_id)) as n, arg_max(bt.level, (bt.ts_us, bt.event_id)) as l from s left join bt on bt.host = s.host and bt.ip = s.ip and bt.ts_us < s.ts_us group by s.event_id),
 w as (select s.event_id, max(sl.ts_us) + 600000000 as until_us from s left join sl on sl.host = s.host and sl.ts_us < s.ts_us group by s.event_id)
 select event_id, case when n > ts_us // 1000 then n end as next_allowed_ms, case when n > ts_us // 1000 then l end as level, coalesce(until_us > ts_us, false) as slowed from o join w using (event_id)"""
ORACLES["cidr_rates"] = (
    SIG
    + """, e as (select sig.signal_type, 10 * 16777216 + (user_id % 4) * 65536 + (sig.event_id % 8) * 256 + user_id % 250 as a from sig join events using (event_id)),
 k as (select distinct case when s_suppkey % 9 = 0 then ['10.' || s_suppkey % 4 || '.0.0/16', cast((10 * 256 + s_suppkey % 4) * 65536 as varchar), '16'] when s_suppkey % 7 = 0 then ['10.' || s_suppkey % 4 || '.' || s_suppkey % 8 || '.0/24', cast(((10 * 256 + s_suppkey % 4) * 256 + s_suppkey % 8) * 256 as varchar), '24']
  when s_suppkey % 5 = 0 then ['10.0.0.0/9', cast(10 * 16777216 as varchar), '9'] else ['10.' || s_suppkey % 4 || '.' || s_suppkey % 8 || '.' || (s_suppkey * 8) % 250 || '/' || (26 + s_suppkey % 6), cast(((10 * 256 + s_suppkey % 4) * 256 + s_suppkey % 8) * 256 + (s_suppkey * 8) % 250 as varchar), cast(26 + s_suppkey % 6 as varchar)] end as x from supplier),
 n as (select cast(x[3] as bigint) as len, cast(x[2] as bigint) >> (32 - cast(x[3] as bigint)) as net, min(x[1]) as cidr from k group by all),
 m as (select signal_type, (select arg_max(cidr, len) from n where a >> (32 - len) = net) as cidr from e)
 select cidr, count(*) as signals, cast(1000 * count(*) filter (signal_type in ('http_429', 'captcha_challenge', 'anti_bot_200')) // count(*) as bigint) as challenges_per_mille, cast(1000 * count(*) filter (signal_type = 'http_5xx') // count(*) as bigint) as errors_per_mille from m group by cidr"""
)
ORACLES["host_profile_mix"] = (
    ATTEMPTS
    + """, x as (select host, 'error' as part, case when fetch_result = 'failed' then coalesce(error_type, 'failed') when status_code >= 400 then 'HTTP_' || status_code else 'none' end as item from att union all select host, 'egress', coalesce(egress_local_ip, 'none') from att)
 select host, part, item, count(*) as value, cast(1000 * count(*) // sum(count(*)) over (partition by host, part) as bigint) as per_mille from x group by host, part, item"""
)

ORACLES["metric_backoff_active"] = f"""with s as ({_SIGNALS}), b as ({ORACLES["backoff_schedule"]}), l as (select s.host, s.ip, arg_max(next_allowed_ms, (s.ts_us, s.event_id)) as until from b join s using (event_id) group by all)
 select host, count(*) filter (until > (select max(ts_us) // 1000 from s)) as value from l group by host"""
ORACLES["metric_delayed_buffer"] = PAGES + """, n as (select 'consumer-' || cast(('0x' || substr(sha256(host), 1, 8)) as bigint) % 8 as consumer, count(*) as n from canon group by 1)
 select consumer, 'delayed' as result, least(n, 20) as value from n union all select consumer, 'delayed_buffer_full', n - 20 from n where n > 20"""
#: One request after the other: the first of three identities that is free, else the one that is free first.
ORACLES["pacer_multi"] = f"""with recursive s as ({_SIGNALS}), q as (select event_id, host, ts_us // 1000 as a, row_number() over (partition by host order by ts_us // 1000, event_id) as i from s),
 p as (select host, cast(0 as bigint) as i, cast(null as bigint) as event_id, cast(0 as bigint) as n1, cast(0 as bigint) as n2, cast(0 as bigint) as n3, 0 as c, cast(0 as bigint) as st from q group by host
  union all select host, i, event_id, case when c = 1 then st + 3600000 else n1 end, case when c = 2 then st + 3600000 else n2 end, case when c = 3 then st + 3600000 else n3 end, c, st
  from (select *, greatest(a, case c when 1 then n1 when 2 then n2 else n3 end) as st from (select p.host, q.i, q.event_id, q.a, p.n1, p.n2, p.n3,
   case when p.n1 <= q.a then 1 when p.n2 <= q.a then 2 when p.n3 <= q.a then 3 when p.n1 <= p.n2 and p.n1 <= p.n3 then 1 when p.n2 <= p.n3 then 2 else 3 end as c from p join q on q.host = p.host and q.i = p.i + 1) x) y)
 select event_id, host, '10.0.0.' || (c + 1) as identity, st as start_ms from p where i > 0"""

ORACLES["stream_responses"] = f"""select 'commands-' || command_no % 2 as stream, cast(command_no as varchar) as message_id, cast(case when command_no % 2 = 0 then command_no % 5 else 1 end as bigint) as deliveries, error
 from ({ORACLES["command_validation"]}) v"""
ORACLES["read_only_audit"] = f"""with c as ({_COMMANDS}), n as (select count(*) as n, count(*) filter (command_no < 100) as few, count(*) filter (command_no = 10) as hit from c)
 select 'same' as kind, n as n_before, n as n_after, true as same_length, true as same_rows from n union all select 'altered', n, n, true, hit = 0 from n union all select 'grown', n, n + few, few = 0, few = 0 from n"""
ORACLES["metric_lines"] = f"""with m as ({ORACLES["metric_requests"]}), l as (select 'requests_total{{host="' || host || '",status="' || status || '",egress_ip="' || coalesce(egress_ip, '') || '"}} ' || value as line from m)
 select cast(row_number() over (order by line) + 2 as integer) as line_no, line from l union all select 1, '# HELP requests_total Requests by host, status and egress address' union all select 2, '# TYPE requests_total counter'"""

ORACLES["metric_stream_events"] = f"""with c as (select error, deadline_at from ({_COMMANDS}) x join ({ORACLES["command_validation"]}) v using (command_no))
 select unnest(['read', 'valid', 'invalid', 'deadline_expired']) as result, unnest([count(*), count(*) filter (error is null), count(*) filter (error is not null), 0]) as value from c"""
