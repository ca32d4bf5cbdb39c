"""Keyed state with a time to live, as a table of writes: keys, what is alive, reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlgrain.operators import audit


def part_error(part: Column) -> Column:
    """What is wrong with a part of a key, null if nothing is."""
    return F.when(F.coalesce(F.trim(part), F.lit("")) == "", F.lit("blank part")).when(F.trim(part).rlike("[:/ ]"), F.lit("unsafe part"))


def key_error(prefix: Column, kind: str, *parts: Column) -> Column:
    """The first thing wrong with a key of these parts: blank prefix, blank or unsafe part, forbidden marker."""
    bare = F.rtrim(F.trim(prefix), F.lit(":"))
    whole = F.concat_ws(":", bare, F.lit(kind), *map(F.trim, parts))
    return F.coalesce(F.when(F.coalesce(bare, F.lit("")) == "", F.lit("blank prefix")), *map(part_error, parts), F.when(audit.forbidden(whole), F.lit("forbidden marker")))


def key(prefix: Column, kind: str, *parts: Column) -> Column:
    """prefix:kind:parts, null where key_error finds something."""
    made = F.concat_ws(":", F.rtrim(F.trim(prefix), F.lit(":")), F.lit(kind), *map(F.trim, parts))
    return F.when(key_error(prefix, kind, *parts).isNull(), made)


def alive(writes: DataFrame, now_ms: int) -> DataFrame:
    """(key, fields, expires_ms) of what writes (key, at_ms, n, fields map<string,string>, ttl) leave at now_ms.

    A write renews its key's time to live and replaces the fields it names; others stay, unless the key had expired before
    the write. Times to live are clamped to 1 s to 24 h. Writes of a key are ordered in one task; fields combine by key and
    field before the shuffle.
    """
    w = Window.partitionBy("key").orderBy("at_ms", "n")
    rows = writes.where((F.col("at_ms") <= now_ms) & F.col("key").isNotNull()).withColumn("_end", F.col("at_ms") + 1000 * audit.clamp_ttl(F.col("ttl")).cast("long"))
    rows = rows.withColumn("_new", F.coalesce(F.lag("_end").over(w) <= F.col("at_ms"), F.lit(True)).cast("long")).withColumn("_life", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("key").agg(F.max("_life").alias("_life"), F.max_by("_end", F.struct("at_ms", "n")).alias("expires_ms")).where(F.col("expires_ms") > now_ms)
    said = rows.select("key", "_life", "at_ms", "n", F.explode_outer("fields").alias("field", "value"))
    last = said.groupBy("key", "_life", "field").agg(F.max_by("value", F.struct("at_ms", "n")).alias("value"))
    pairs = F.filter(F.collect_list(F.struct("field", "value")), lambda x: x["field"].isNotNull())
    return ends.join(last, ["key", "_life"]).groupBy("key", "expires_ms").agg(F.map_from_entries(F.array_sort(pairs)).alias("fields")).select("key", "fields", "expires_ms")


def read(keys: DataFrame, state: DataFrame) -> DataFrame:
    """keys with fields and result: hit, or miss where the key isn't alive."""
    return keys.join(state.select("key", "fields"), "key", "left").withColumn("result", F.when(F.col("fields").isNotNull(), "hit").otherwise("miss"))


def count_prefix(state: DataFrame, prefix: str) -> DataFrame:
    """One row: how many keys begin with prefix."""
    return state.where(F.startswith("key", F.lit(prefix))).agg(F.countDistinct("key").alias("n"))
