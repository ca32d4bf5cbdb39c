"""Keyed windows over ordered signals: sliding with reset, gap counters, distinct counters, escalation, pacing.

All are window functions over one sort per key; ties in time go by event_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_US = 21_600 * 1_000_000


def failure_window(rows: DataFrame, keys: list[str], failed: Column, reset: Column, width_us: int, *, closed: bool = False, at_once: Column | None = None, threshold: int = 5) -> DataFrame:
    """rows with failures (in the window, since the last reset) and triggered.

    A failure at the window's far end counts only if closed. at_once triggers whatever the count.
    """
    ordered = Window.partitionBy(*keys).orderBy("ts_us", "event_id")
    epochs = rows.withColumn("epoch", F.sum(reset.cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    recent = Window.partitionBy(*keys, "epoch").orderBy("ts_us").rangeBetween(-(width_us if closed else width_us - 1), 0)
    out = epochs.withColumn("failures", F.sum(failed.cast("long")).over(recent))
    hit = F.col("failures") >= threshold
    return out.withColumn("triggered", failed & (hit | at_once if at_once is not None else hit)).drop("epoch")


def blacklist(rows: DataFrame, keys: list[str], cooldown_us: int = 1_800_000_000) -> DataFrame:
    """rows with triggered, as failure_window gives them, and blacklisted: a trigger of the key is less than cooldown_us old; each one arms it anew."""
    recent = Window.partitionBy(*keys).orderBy("ts_us").rangeBetween(-(cooldown_us - 1), 0)
    return rows.withColumn("blacklisted", F.max("triggered").over(recent))


def sessions(rows: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """rows with session: a gap of more than gap_us since the row before begins the next one."""
    ordered = Window.partitionBy(*keys).orderBy("ts_us", "event_id")
    before = F.lag("ts_us").over(ordered)
    return rows.withColumn("_new", (before.isNull() | (F.col("ts_us") - before > gap_us)).cast("long")).withColumn("session", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_counter(rows: DataFrame, keys: list[str], gap_us: int, weight: Column) -> DataFrame:
    """rows with count and weight_sum since the session began."""
    running = Window.partitionBy(*keys, "session").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return sessions(rows, keys, gap_us).withColumn("count", F.count("*").over(running)).withColumn("weight_sum", F.sum(weight.cast("long")).over(running))


def gap_distinct(rows: DataFrame, keys: list[str], member: str, gap_us: int, weight: Column) -> DataFrame:
    """rows with distinct (members since the session began) and weight_sum (of every row)."""
    found = sessions(rows, keys, gap_us)
    first = F.row_number().over(Window.partitionBy(*keys, "session", member).orderBy("ts_us", "event_id")) == 1
    running = Window.partitionBy(*keys, "session").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("_first", first.cast("long")).withColumn("distinct", F.sum("_first").over(running)).withColumn("weight_sum", F.sum(weight.cast("long")).over(running)).drop("_first")


def backoff_delay(level: Column, base_ms: int, factor: float, most_ms: int, scale: float = 1.0) -> Column:
    grown = F.floor(F.lit(float(base_ms)) * F.pow(F.lit(float(factor)), F.least(level, F.lit(60)) - 1))
    return F.least(F.floor(grown * F.greatest(F.lit(scale), F.lit(1.0))), F.lit(most_ms)).cast("long")


def backoff_schedule(
    triggers: DataFrame, keys: list[str], *, base_ms: int = 5000, factor: float = 2.0, most_ms: int = 300_000, memory_us: int = 86_400_000_000, success: Column | None = None
) -> DataFrame:
    """triggers with level, delay_ms and next_allowed_ms; the level is kept for memory_us after the last row of its key.

    Rows for which success holds set the level back to 0, leave the time that the trigger before them set, and have no delay.
    """
    good = F.coalesce(success, F.lit(False)) if success is not None else F.lit(False)
    rows = sessions(triggers.withColumn("_good", good), keys, memory_us)
    ordered = Window.partitionBy(*keys, "session").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_spell", F.count_if("_good").over(ordered))
    spell = Window.partitionBy(*keys, "session", "_spell").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("level", F.count_if(~F.col("_good")).over(spell))
    out = out.withColumn("delay_ms", F.when(~F.col("_good"), backoff_delay(F.col("level"), base_ms, factor, most_ms)))
    own = F.floor(F.col("ts_us") / 1000).cast("long") + F.col("delay_ms")
    return out.withColumn("next_allowed_ms", F.last(own, ignorenulls=True).over(ordered)).drop("_good", "_spell", "session")


def jitter(most_ms: int, *seeded_by: Column) -> Column:
    """Whole milliseconds from 0 to most_ms: by hash of the given columns, the same in every run, or at random without any."""
    if most_ms <= 0:
        return F.lit(0).cast("long")
    return F.pmod(F.xxhash64(*seeded_by), F.lit(most_ms + 1)) if seeded_by else F.floor(F.rand() * (most_ms + 1)).cast("long")


def soft_ban(signals: DataFrame, gap_us: int, *, host_ip: int = 2, ip: int = 3, host: int = 3) -> DataFrame:
    """Challenge signals with what they set off: backoff (host and ip), cooldown (ip), slowdown (host).

    Every signal at or above its threshold counts, and counts are kept by signal type. Cooldown, slowdown and, where
    signals have an asn, soft_limit (host and asn) look at captcha and anti-bot signals only. The windows follow each other over one frame.
    """
    one = F.lit(1)
    cross = F.col("signal_type") != "http_429"
    rows = gap_counter(signals, ["host", "ip", "signal_type"], gap_us, one).withColumnRenamed("count", "host_ip_count").drop("session", "weight_sum")
    counted = [("hosts_of_ip", ["ip"], "host", "cooldown", ip), ("ips_of_host", ["host"], "ip", "slowdown", host)]
    if "asn" in signals.columns:
        counted.append(("ips_of_host_asn", ["host", "asn"], "ip", "soft_limit", host))
    rows = rows.withColumn("backoff", F.col("host_ip_count") >= host_ip)
    for name, keys, member, said, least in counted:
        rows = gap_distinct(rows, [*keys, "signal_type"], member, gap_us, one).drop("session", "weight_sum")
        rows = rows.withColumn(name, F.when(cross, F.col("distinct")).otherwise(0)).drop("distinct").withColumn(said, F.col(name) >= least)
    return rows


def pacer_schedule(requests: DataFrame, keys: list[str], interval_ms: int) -> DataFrame:
    """requests (arrive_ms, event_id) with start_ms and wait_ms: starts of a key are interval_ms apart at least, in order of arrival.

    start(i) = i*I + max over j <= i of (arrival(j) - j*I), so no row waits for another row's result.
    """
    ordered = Window.partitionBy(*keys).orderBy("arrive_ms", "event_id")
    at = (F.row_number().over(ordered) - 1).cast("long")
    rows = requests.withColumn("_i", at)
    free = F.max(F.col("arrive_ms") - F.col("_i") * interval_ms).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start_ms", (F.col("_i") * interval_ms + free).cast("long")).withColumn("wait_ms", F.col("start_ms") - F.col("arrive_ms")).drop("_i")
