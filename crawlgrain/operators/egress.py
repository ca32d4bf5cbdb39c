"""Egress placement: rendezvous pools, sticky and round-robin choice, cooldowns, backoff and slowdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlgrain.functions import ids


def enrich(local: DataFrame, mapping: DataFrame, mode: str = "auto") -> DataFrame:
    """local (bind_ip) with public_ip, identity and identity_type; mode is public_ip, bind_ip or auto."""
    m = mapping.select(F.trim("bind_ip").alias("bind_ip"), F.nullif(F.trim("public_ip"), F.lit("")).alias("public_ip"))
    rows = local.join(m, "bind_ip", "left")
    public = F.col("public_ip").isNotNull() if mode == "auto" else F.lit(mode == "public_ip")
    return rows.withColumn("identity_type", F.when(public & F.col("public_ip").isNotNull(), "public_ip").otherwise("bind_ip")).withColumn(
        "identity", F.when(F.col("identity_type") == "public_ip", F.col("public_ip")).otherwise(F.col("bind_ip"))
    )


def _addresses(identities: DataFrame, most: int = 1024) -> list[str]:
    """Active identities in their own order; a node has `most` addresses at most."""
    rows = identities.where("status = 'active'").orderBy("seq").select("identity").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} identities")
    return [r["identity"] for r in rows]


def sticky_pool(hosts: DataFrame, identities: DataFrame, size: Column | int, salt: str = "") -> DataFrame:
    """(host, rank, identity, score): the best `size` active identities of each host by rendezvous score.

    identities is the node's own list of addresses (1024 at most). It goes to every host as one array, so
    each host is ranked where it is, without a shuffle of host x identity rows.
    """
    listed = F.array(*(F.lit(i) for i in _addresses(identities)))
    score = F.transform(listed, lambda i: F.struct(ids.rendezvous_score(F.col("host"), i, salt).alias("score"), i.alias("identity")))
    scored = hosts.select("host").distinct().select("host", F.reverse(F.array_sort(score)).alias("ranked"))
    top = F.slice("ranked", 1, size) if isinstance(size, int) else F.slice("ranked", F.lit(1), size)
    return scored.select("host", F.posexplode(top).alias("rank", "x")).select("host", (F.col("rank") + 1).alias("rank"), "x.identity", "x.score")


def sticky_by_host(hosts: DataFrame, identities: DataFrame, blocked: DataFrame) -> DataFrame:
    """(host, identity): from the host's bucket on, the first identity that isn't blocked for the host; null if all are."""
    slots = _addresses(identities)
    n = len(slots)
    listed = F.array(*map(F.lit, slots))
    rows = hosts.select("host").distinct().withColumn("bucket", ids.host_bucket(F.col("host"), F.lit(n)))
    out = blocked.groupBy("host").agg(F.collect_set("identity").alias("blocked"))  # of n identities
    order = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda step: F.element_at(listed, ((F.col("bucket") + step) % n).cast("int") + 1))
    free = F.filter(order, lambda i: ~F.array_contains(F.coalesce("blocked", F.expr("cast(array() as array<string>)")), i))
    return rows.join(out, "host", "left").select("host", F.try_element_at(free, F.lit(1)).alias("identity"))


def select_egress(requests: DataFrame, pool: DataFrame, cooldowns: DataFrame, backoffs: DataFrame, slowdowns: DataFrame, min_delay_ms: int) -> DataFrame:
    """requests (event_id, host, now_ms) with the identity to use, the time it may start and the slowdown in force.

    Identities in cooldown are out. The best-ranked one that isn't backed off is taken; if all are,
    the best-ranked with its own next time. Without any, the earliest end of a cooldown, or now + min_delay.
    """
    member = F.struct("rank", "identity", "cooldown_until_ms", "next_allowed_ms")
    states = pool.join(cooldowns, "identity", "left").join(backoffs, ["host", "identity"], "left")
    pools = states.groupBy("host").agg(F.sort_array(F.collect_list(member)).alias("pool"))  # a pool has a node's addresses at most
    # states meet per host, not per request: requests are joined once, on host, and each chooses within its own row
    out = requests.join(pools, "host", "left").join(slowdowns, "host", "left")
    now = F.col("now_ms")
    later = lambda until: F.coalesce(until > now, F.lit(False))
    warm = F.filter("pool", lambda m: ~later(m["cooldown_until_ms"]))
    free = F.try_element_at(F.filter(warm, lambda m: ~later(m["next_allowed_ms"])), F.lit(1))
    best = F.coalesce(free, F.try_element_at(warm, F.lit(1)))
    out = out.withColumn("best", F.struct(best["identity"].alias("identity"), (free.isNull() & best.isNotNull()).alias("backed_off"), best["next_allowed_ms"].alias("next_allowed_ms")))
    out = out.withColumn("free_at_ms", F.array_min(F.transform(F.filter("pool", lambda m: later(m["cooldown_until_ms"])), lambda m: m["cooldown_until_ms"])))
    factor = F.when(F.col("slowdown_until_ms") > F.col("now_ms"), F.greatest("factor", F.lit(1.0))).otherwise(F.lit(1.0))
    start = (
        F.when(F.col("best.identity").isNull(), F.coalesce("free_at_ms", F.col("now_ms") + min_delay_ms))
        .when(F.col("best.backed_off"), F.col("best.next_allowed_ms"))
        .otherwise(F.col("now_ms"))
    )
    return out.select("event_id", "host", F.col("best.identity").alias("identity"), start.alias("start_ms"), F.floor(min_delay_ms * factor).cast("long").alias("delay_ms"))


def later_pacer(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(host, identity, next_allowed_ms, origin): of local and remote state the later one, local on a tie."""
    l, r = local.withColumnRenamed("next_allowed_ms", "l"), remote.withColumnRenamed("next_allowed_ms", "r")
    both = l.join(r, ["host", "identity"], "full")
    remote_wins = F.coalesce(F.col("r"), F.lit(-1)) > F.coalesce(F.col("l"), F.lit(-1))
    return both.select("host", "identity", F.greatest("l", "r").alias("next_allowed_ms"), F.when(remote_wins, "remote").otherwise("local").alias("origin"))


def round_robin(requests: DataFrame, identities: DataFrame, order: list[str]) -> DataFrame:
    """requests with the identity of their turn: number in order modulo the active identities.

    The number is counted per range partition, so no single task holds all requests.
    """
    slots = _addresses(identities)
    listed = F.array(*map(F.lit, slots))
    ranged = requests.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    numbered = ranged.join(before, "_part").withColumn("identity", F.element_at(listed, ((F.col("before") + F.col("_at") - F.col("first")) % len(slots)).cast("int") + 1))
    return numbered.drop("_part", "_at", "n", "first", "before")
