"""IP addresses, headers and text helpers of the egress side."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BYTE = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{_BYTE}(\.{_BYTE}){{3}}$"


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(F.trim(ip).rlike(IPV4), F.lit(False))


def usable_ipv4(ip: Column) -> Column:
    """IPv4, neither loopback nor 0.0.0.0."""
    t = F.trim(ip)
    return is_ipv4(ip) & ~F.startswith(t, F.lit("127.")) & (t != "0.0.0.0")


@F.pandas_udf(T.StringType())
def normalize_ip(ips: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical text of an IPv4 or IPv6 address, null if it is none. Spark has no IPv6 parser."""

    def one(text: str | None) -> str | None:
        try:
            return str(ipaddress.ip_address(text.strip())) if text else None
        except ValueError:
            return None

    for s in ips:
        yield s.map(one, na_action="ignore")


def all_interfaces(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)), F.lit("")).isin("", "*", "all")


def flag(text: Column, default: Column) -> Column:
    """1/true/yes/on, 0/false/no/off or blank, else default."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true", "yes", "on"), F.lit(True)).when(t.isin("0", "false", "no", "off", ""), F.lit(False)).otherwise(default)


def observed_ip(body: Column) -> Column:
    """Address that an echo service reports: the first of four JSON keys, else the first line's 128 characters."""
    from_json = F.coalesce(*(F.get_json_object(body, f"$.{k}") for k in ("ip", "origin", "query", "address")))
    return F.coalesce(from_json, F.substring(F.trim(F.substring_index(F.trim(body), "\n", 1)), 1, 128))
