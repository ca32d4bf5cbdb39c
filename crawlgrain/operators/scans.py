"""Ordered operators over the rows of a key that are dealt to several tasks: spans of time are summed up and stitched.

Each operator is a scan whose step is associative: a gap session needs a span's first and last time, a reset window its count of
resets and the rows shortly before, pacing its count and the max-plus sum, an as-of join the last state. Rows are ordered within (key, span) only;
what comes before a span is a window over spans, of which a key has few. So a key with a third of all rows is spread over as
many tasks as it has spans. All give the rows that the windows over whole keys give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _spanned(rows: DataFrame, time: str, width: int) -> DataFrame:
    return rows.withColumn("_span", F.floor(F.col(time) / width).cast("long"))


def _stitched(rows: DataFrame, keys: list[str], sums: DataFrame) -> DataFrame:
    """rows with the sums of what lies before their span. Keys are compared so that nulls meet."""
    right = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_span"])), *(c for c in sums.columns if c not in (*keys, "_span")))
    on = F.lit(True)
    for i, k in enumerate([*keys, "_span"]):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(right, on).drop(*(f"_k{i}" for i in range(len(keys) + 1)))


def sessions(rows: DataFrame, keys: list[str], gap_us: int, span_us: int) -> DataFrame:
    """windows.sessions by spans of span_us: a gap of more than gap_us since the row before begins the next session."""
    inside = Window.partitionBy(*keys, "_span").orderBy("ts_us", "event_id")
    spans = Window.partitionBy(*keys).orderBy("_span")
    r = _spanned(rows, "ts_us", span_us)
    r = r.withColumn("_gap", (F.col("ts_us") - F.lag("ts_us").over(inside) > gap_us).cast("long"))  # null for a span's first row
    r = r.withColumn("_breaks", F.coalesce(F.sum("_gap").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    sums = r.groupBy(*keys, "_span").agg(F.min("ts_us").alias("_first"), F.max("ts_us").alias("_last"), F.coalesce(F.sum("_gap"), F.lit(0)).alias("_n"))
    opens = F.coalesce((F.col("_first") - F.lag("_last").over(spans) > gap_us).cast("long"), F.lit(1))
    sums = sums.withColumn("_opens", opens)
    before = F.sum(F.col("_opens") + F.col("_n")).over(spans.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    out = _stitched(r, keys, sums.withColumn("_before", before).select(*keys, "_span", "_before"))
    return out.withColumn("session", F.col("_before") + F.col("_breaks")).drop("_span", "_gap", "_breaks", "_before")


def gap_counter(rows: DataFrame, keys: list[str], gap_us: int, weight: Column, span_us: int) -> DataFrame:
    """windows.gap_counter by spans: rows with session, and count and weight_sum since the session began."""
    r = _spanned(sessions(rows, keys, gap_us, span_us).withColumn("_weight", weight.cast("long")), "ts_us", span_us)
    inside = Window.partitionBy(*keys, "session", "_span").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = r.groupBy(*keys, "session", "_span").agg(F.count("*").alias("_n"), F.sum("_weight").alias("_w"))
    before = Window.partitionBy(*keys, "session").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "session", "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w"))
    out = _stitched(r, [*keys, "session"], sums)
    return out.withColumn("count", F.count("*").over(inside) + F.col("_n")).withColumn("weight_sum", F.coalesce(F.sum("_weight").over(inside), F.lit(0)) + F.col("_w")).drop("_n", "_w", "_span", "_weight")


def _running(rows: DataFrame, keys: list[str], value: str, span_us: int) -> DataFrame:
    """rows with the running sum of value over keys and session in place of value."""
    r = _spanned(rows, "ts_us", span_us)
    sums = r.groupBy(*keys, "session", "_span").agg(F.sum(value).alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*keys, "session").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    out = _stitched(r, [*keys, "session"], sums.select(*keys, "session", "_span", F.coalesce(before, F.lit(0)).alias("_past")))
    inside = Window.partitionBy(*keys, "session", "_span").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(value, F.sum(value).over(inside) + F.col("_past")).drop("_past", "_span")


def gap_distinct(rows: DataFrame, keys: list[str], member: str, gap_us: int, span_us: int) -> DataFrame:
    """windows.gap_distinct by spans, without weights: rows with session, and distinct, the members since the session began.

    A member's first row of a session is a minimum that combines before the shuffle, and is joined back.
    """
    r = sessions(rows, keys, gap_us, span_us)
    group = [*keys, "session", member]
    first = r.groupBy(*group).agg(F.min(F.struct("ts_us", "event_id")).alias("_first"))
    on = F.lit(True)
    for i, k in enumerate(group):
        on = on & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    joined = r.join(first.select(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(group)), "_first"), on).drop(*(f"_g{i}" for i in range(len(group))))
    flagged = joined.withColumn("distinct", (F.struct("ts_us", "event_id") == F.col("_first")).cast("long")).drop("_first")
    return _running(flagged, keys, "distinct", span_us)


def soft_ban(signals: DataFrame, gap_us: int, span_us: int, *, host_ip: int = 2, ip: int = 3, host: int = 3) -> DataFrame:
    """windows.soft_ban by spans: an address or host with any share of the signals is dealt to as many tasks as it has spans.

    signals is read by each counter, and the counters meet by event_id, which must be unique: give it as a table, not as a long plan.
    """
    cross = F.col("signal_type") != "http_429"
    counts = gap_counter(signals, ["host", "ip", "signal_type"], gap_us, F.lit(1), span_us).select("event_id", F.col("count").alias("host_ip_count"))
    rows = signals.join(counts, "event_id").withColumn("backoff", F.col("host_ip_count") >= host_ip)
    counted = [("hosts_of_ip", ["ip"], "host", "cooldown", ip), ("ips_of_host", ["host"], "ip", "slowdown", host)]
    if "asn" in signals.columns:
        counted.append(("ips_of_host_asn", ["host", "asn"], "ip", "soft_limit", host))
    for name, keys, member, said, least in counted:
        own = gap_distinct(signals.where(cross), [*keys, "signal_type"], member, gap_us, span_us).select("event_id", F.col("distinct").alias(name))
        rows = rows.join(own, "event_id", "left").withColumn(name, F.coalesce(name, F.lit(0))).withColumn(said, F.col(name) >= least)
    return rows


def pacer_schedule(requests: DataFrame, keys: list[str], interval_ms: int, span_ms: int) -> DataFrame:
    """windows.pacer_schedule by spans: start_ms and wait_ms, starts of a key interval_ms apart at least."""
    inside = Window.partitionBy(*keys, "_span").orderBy("arrive_ms", "event_id")
    r = _spanned(requests, "arrive_ms", span_ms).withColumn("_i", (F.row_number().over(inside) - 1).cast("long"))
    r = r.withColumn("_free", F.max(F.col("arrive_ms") - F.col("_i") * interval_ms).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sums = r.groupBy(*keys, "_span").agg(F.count("*").alias("_n"), F.max("_free").alias("_most"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sums = sums.withColumn("_past", F.max(F.col("_most") - F.col("_at") * interval_ms).over(before)).select(*keys, "_span", "_at", "_past")
    out = _stitched(r, keys, sums)
    start = (F.col("_at") + F.col("_i")) * interval_ms + F.greatest(F.col("_past"), F.col("_free") - F.col("_at") * interval_ms)
    return out.withColumn("start_ms", start.cast("long")).withColumn("wait_ms", F.col("start_ms") - F.col("arrive_ms")).drop("_i", "_free", "_at", "_past", "_span")


def failure_window(rows: DataFrame, keys: list[str], failed: Column, reset: Column, width_us: int, *, threshold: int = 5, at_once: Column | None = None) -> DataFrame:
    """windows.failure_window by spans of width_us: a row is counted in its own span and, as a row before, in the next one."""
    inside = Window.partitionBy(*keys, "_span").orderBy("ts_us", "event_id")
    r = _spanned(rows.withColumn("_failed", failed).withColumn("_reset", reset.cast("long")), "ts_us", width_us)
    r = r.withColumn("_own", F.sum("_reset").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sums = r.groupBy(*keys, "_span").agg(F.sum("_reset").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    r = _stitched(r, keys, sums.select(*keys, "_span", F.coalesce(before, F.lit(0)).alias("_past"))).withColumn("_epoch", F.col("_own") + F.col("_past")).drop("_own", "_past")
    twice = r.withColumn("_halo", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("_span", F.col("_span") + F.col("_halo").cast("long"))
    recent = Window.partitionBy(*keys, "_epoch", "_span").orderBy("ts_us").rangeBetween(-(width_us - 1), 0)
    out = twice.withColumn("failures", F.sum(F.col("_failed").cast("long")).over(recent)).where(~F.col("_halo"))
    hit = F.col("failures") >= threshold
    return out.withColumn("triggered", F.col("_failed") & (hit | at_once if at_once is not None else hit)).drop("_span", "_failed", "_reset", "_epoch", "_halo")


def as_of(rows: DataFrame, states: DataFrame, keys: list[str], time: str, span: int, state: str = "state", inclusive: bool = True) -> DataFrame:
    """rows with state: of states (keys, time, n, and what else is to be carried) the last one of the same keys at or before the row's time, null if none.

    One order of rows and states within (key, span); what holds at a span's start comes from the last state of the spans before.
    States of one time go by n. Without inclusive a state holds only after its time.
    """
    held = [c for c in states.columns if c not in keys]
    s = states.select(*keys, F.col(time).alias("_t"), F.lit(0 if inclusive else 2).alias("_kind"), F.col("n").alias("_n"), F.struct(*held).alias("_state"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("_row"))
    r = rows.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(states.schema["n"].dataType).alias("_n"), F.lit(None).cast(s.schema["_state"].dataType).alias("_state"), F.struct("*").alias("_row"))
    both = _spanned(s.unionByName(r), "_t", span)
    inside = Window.partitionBy(*keys, "_span").orderBy("_t", "_kind", "_n").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_seen", F.last("_state", ignorenulls=True).over(inside))
    sums = both.groupBy(*keys, "_span").agg(F.max_by("_state", F.when(F.col("_state").isNotNull(), F.struct("_t", "_n"))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    out = _stitched(found.where("_row is not null"), keys, sums.select(*keys, "_span", before.alias("_past")))
    return out.select("_row.*", F.coalesce("_seen", "_past").alias(state))
