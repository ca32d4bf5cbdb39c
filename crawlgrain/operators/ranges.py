"""Longest-prefix match of IPv4 addresses: prefixes become disjoint ranges, cut at /16 borders, and are joined by /16 and range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlgrain.functions import net

#: Pieces that are broadcast, at most; more are joined by a shuffle on the /16.
SMALL = 100_000
_BITS = 16


def ipv4_number(ip: Column) -> Column:
    """The address as a number, null if it is no IPv4 address."""
    part = F.split(F.trim(ip), r"\.")
    whole = sum((F.element_at(part, i + 1).try_cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("long"))
    return F.when(net.is_ipv4(ip), whole)


def prefixes(table: DataFrame, cidr: str = "cidr") -> DataFrame:
    """table with _low, _high and _length of its prefixes; host bits are ignored, rows that hold no IPv4 prefix go."""
    text = F.trim(cidr)
    length = F.when(F.contains(text, F.lit("/")), F.regexp_extract(text, r"/([0-9]{1,2})$", 1).try_cast("int")).otherwise(32)
    size = F.pow(F.lit(2), 32 - F.col("_length")).cast("long")
    rows = table.withColumn("_length", length).withColumn("_low", ipv4_number(F.substring_index(text, "/", 1))).where(F.col("_length").between(0, 32) & F.col("_low").isNotNull())
    return rows.withColumn("_low", F.col("_low") - F.col("_low") % size).withColumn("_high", F.col("_low") + size - 1)


def pieces(table: DataFrame, cidr: str = "cidr") -> DataFrame:
    """(block, low, high, cidr, length): disjoint ranges, each within one /16 and with the longest prefix that holds it.

    Of equal prefixes the one whose text is smallest counts. There are as many pieces as prefixes have borders, and 65,536 at most beside.
    """
    spark = table.sparkSession
    known = prefixes(table, cidr).groupBy("_length", "_low", "_high").agg(F.min(cidr).alias("cidr"))
    borders = known.select(F.explode(F.array("_low", F.col("_high") + 1)).alias("at")).unionByName(spark.range(1 << _BITS).select((F.col("id") * (1 << (32 - _BITS))).alias("at")))
    points = borders.where(F.col("at") < 1 << 32).distinct()
    # the prefixes that hold a point are at most one for each length
    asked = points.select("at", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("_length"))
    asked = asked.withColumn("_low", F.col("at") - F.col("at") % F.pow(F.lit(2), 32 - F.col("_length")).cast("long"))
    held = asked.join(known, ["_length", "_low"]).groupBy("at").agg(F.max_by("cidr", "_length").alias("cidr"), F.max("_length").alias("length"))
    block = F.shiftright("at", 32 - _BITS).cast("int")
    ends = points.withColumn("block", block).withColumn("high", F.coalesce(F.lead("at").over(Window.partitionBy("block").orderBy("at")), (F.col("block").cast("long") + 1) * (1 << (32 - _BITS))) - 1)
    return ends.join(held, "at").select("block", F.col("at").alias("low"), "high", "cidr", "length")


def longest_prefix(rows: DataFrame, ip: str, table: DataFrame, cidr: str = "cidr") -> DataFrame:
    """rows with cidr: the longest prefix of table that holds the address in column ip; null if none does or it is no IPv4 address.

    Up to SMALL pieces are broadcast; more meet the rows by /16.
    """
    found = pieces(table, cidr)
    if found.count() <= SMALL:
        found = F.broadcast(found)
    r = rows.withColumn("_ip", ipv4_number(F.col(ip))).withColumn("_block", F.shiftright("_ip", 32 - _BITS).cast("int"))
    hit = (F.col("_block") == F.col("p.block")) & F.col("_ip").between(F.col("p.low"), F.col("p.high"))
    return r.join(found.alias("p"), hit, "left").select(*rows.columns, F.col("p.cidr").alias("cidr"))
