"""Views derived from the driver's tables; their SQL is the same for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW_MS = 1706659200000  # 2024-01-31T00:00:00Z

FETCH_RESULTS = """
select p.page_id*3+k.k as result_id, p.page_id, 'job_'||cast(k.k as varchar(9)) as job_id, p.url,
 case when (p.page_id+k.k)%25=24 then null when (p.page_id+7*k.k)%20=0 then 404
      when (p.page_id+7*k.k)%20=1 then 503 when (p.page_id+7*k.k)%20=2 then 429
      when (p.page_id+7*k.k)%20=3 then 500 else 200 end as status_code,
 case when (p.page_id+k.k)%25=24 then null when p.page_id%9=0 then 'application/pdf'
      when p.page_id%9=1 then 'Text/HTML; charset=utf-8'
      when p.page_id%9=2 then 'application/xhtml+xml' else 'text/html' end as content_type,
 (p.page_id+k.k)%25=24 as fetch_failed,
 case when (p.page_id+k.k)%25=24 then 'TimeoutError' end as error_type,
 (p.page_id+k.k)%13<>12 as storage_ok, 1+(p.page_id+k.k)%4 as deliveries,
 case when p.page_id%6=0 then 0 when p.page_id%6=1 then null else 2 end as cmd_max_retries,
 case when p.page_id%8=0 then 'scope-paused' end as policy_scope_id,
 case p.page_id%3 when 0 then 'default' when 1 then 'gold' else 'bulk' end as tier,
 case when p.page_id%10=0 then '2023-12-31T00:00:00Z'
      when p.page_id%10=1 then '2024-06-01T00:00:00+02:00' end as deadline_at,
 1704067200000+p.page_id*1500+k.k*86400000 as attempted_at_ms,
 1704067200000+p.page_id*1500+k.k*86400000+100+(p.page_id*37)%900 as finished_at_ms, p.html,
 'cmd:'||cast(p.page_id*3+k.k as varchar(20)) as command_id, 'trace-'||cast(p.page_id as varchar(20)) as trace_id,
 '10.0.0.'||cast(2+p.page_id%5 as varchar(9)) as egress_local_ip, 100+(p.page_id*37)%900 as response_time_ms, (p.page_id+k.k)%17<>0 as publish_ok
from {pages} p cross join (select 0 as k union all select 1 union all select 2) k
"""

SIGNALS = """
select event_id, {micros} as ts_us, 'h'||cast(user_id%7 as varchar(9))||'.example.com' as host,
 '10.0.0.'||cast(2+event_id%5 as varchar(9)) as ip,
 case when event_type='error' and event_id%3=0 then 403 when event_type='error' then 429
      when event_type='purchase' then 503 else 200 end as status_code,
 case when event_type='error' and event_id%3=0 then 'Please verify you are human'
      when event_type='click' and event_id%4=0 then 'access denied by bot filter'
      else 'ok' end as body, event_type
from {events}
"""

#: Corrupted commands beside every page's own one.
COMMANDS = """
select page_id*10+v.v as command_no,
 case v.v when 1 then '' when 2 then '/relative/path' when 3 then 'http://example.com:99999/' else url end as url,
 case when v.v=4 then '  ' else 'job_'||cast(page_id%4 as varchar(9)) end as job_id,
 case when v.v=5 then null else url end as canonical_url,
 case v.v when 6 then 'soon' when 7 then '2024-06-01T00:00:00Z' end as deadline_at,
 case v.v when 8 then '-1' when 9 then 'x' when 0 then '3' end as max_retries,
 case when page_id%8=0 then 'scope-paused' end as policy_scope_id,
 case page_id%3 when 0 then 'default' when 1 then 'gold' else 'bulk' end as tier
from {pages} cross join (select 0 as v union all select 1 union all select 2 union all select 3 union all select 4 union all select 5
 union all select 6 union all select 7 union all select 8 union all select 9) v
where v.v = 0 or page_id % 10 = v.v
"""

IDENTITIES = """
select '10.0.0.'||cast(n as varchar(9)) as bind_ip, case when n%2=0 then '198.51.100.'||cast(n as varchar(9)) end as public_ip,
 'AS'||cast(1+n%2 as varchar(9)) as asn, case when n=9 then 'disabled' else 'active' end as status, n as seq
from (select 2 as n union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8 union all select 9) x
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fetch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FETCH_RESULTS, pages=table(spark, sf_dir, "pages"))


def signals(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Of the table of events, or of a stream of it."""
    return spark.sql(SIGNALS.replace("{micros}", "unix_micros(cast(ts as timestamp))"), events=table(spark, sf_dir, "events") if events is None else events)


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(COMMANDS, pages=table(spark, sf_dir, "pages"))


def identities(spark: SparkSession) -> DataFrame:
    """Eight rows."""
    return spark.sql(IDENTITIES)
