"""Audit of state keys: what is new, and what of it breaks the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the domain.
FORBIDDEN = ["outlink", "scheduler", "dupefilter", "seen_url", "priority", "rank", "recrawl", "profile"]
PREFIX = "fetch:state"  # callers with another one pass it


def forbidden(key: Column) -> Column:
    return F.lower(key).rlike("|".join(FORBIDDEN))


def clamp_ttl(ttl: Column, most: int = 86_400) -> Column:
    return F.greatest(F.lit(1), F.least(ttl, F.lit(most)))


def marker(key: Column) -> Column:
    """The first forbidden marker, in the order of FORBIDDEN, that a key holds; null if none."""
    return F.coalesce(*(F.when(F.contains(F.lower(key), F.lit(m)), F.lit(m)) for m in FORBIDDEN))


def new_keys(before: DataFrame, after: DataFrame, prefix: str = PREFIX, extra_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(key, out_of_prefix, forbidden, missing_ttl) of keys in after (key, ttl) that before (key) hasn't.

    A key is allowed if it has the prefix and no forbidden marker; others are out of prefix unless they have an extra
    one. Only allowed keys need a time to live.
    """
    fresh = after.join(before.select("key"), "key", "left_anti").groupBy("key").agg(F.max("ttl").alias("ttl"))
    allowed = F.startswith("key", F.lit(prefix + ":")) & ~forbidden(F.col("key"))
    extra = F.lit(False)
    for p in extra_prefixes:
        extra = extra | F.startswith("key", F.lit(p.rstrip(":")))
    return fresh.select("key", (~allowed & ~extra).alias("out_of_prefix"), forbidden(F.col("key")).alias("forbidden"), (allowed & (F.coalesce("ttl", F.lit(-1)) <= 0)).alias("missing_ttl"))


def audit(before: DataFrame, after: DataFrame, prefix: str = PREFIX, extra_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """One row: how many new keys, how many break each rule, and passed."""
    rows = new_keys(before, after, prefix, extra_prefixes)
    counts = rows.agg(F.count("*").alias("new_keys"), *(F.count_if(c).alias(c) for c in ("out_of_prefix", "forbidden", "missing_ttl")))
    return counts.withColumn("passed", (F.col("out_of_prefix") + F.col("forbidden") + F.col("missing_ttl")) == 0)


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row (n, digest): how many rows, and a sum of hashes of all columns that doesn't depend on their order or partitions.

    Each copy of a row counts. Sums combine before the shuffle; an empty table has the digest 0.
    """
    hashed = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(hashed), F.lit(0)).cast("string").alias("digest"))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (n_before, n_after, same_length, same_rows): whether a stream that is only read is as it was."""
    b, a = (fingerprint(f).select(F.col("n").alias(f"n_{x}"), F.col("digest").alias(f"digest_{x}")) for f, x in ((before, "before"), (after, "after")))
    both = b.join(a)  # one row each
    return both.select("n_before", "n_after", (F.col("n_before") == F.col("n_after")).alias("same_length"), ((F.col("n_before") == F.col("n_after")) & (F.col("digest_before") == F.col("digest_after"))).alias("same_rows"))
