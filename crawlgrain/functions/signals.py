"""Feedback signals from responses and exceptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed weights of the domain.
WEIGHTS = {"http_429": 3, "captcha_challenge": 5, "anti_bot_200": 4, "http_5xx": 1, "timeout": 1, "connection_failed": 1, "success": 0}
GLOBAL_ERRORS = ["DNSLookupError", "TimeoutError", "TCPTimedOutError", "ConnectionRefusedError", "ConnectionDone", "ConnectionLost"]
CHALLENGES = ["http_429", "captcha_challenge", "anti_bot_200"]


def parse_patterns(text: str) -> list[tuple[str, str]]:
    """(id, regex) of a comma list of id:regex; the regex is its own id where none is given."""
    out = []
    for part in (p.strip() for p in text.split(",")):
        if part:
            name, colon, regex = part.partition(":")
            out.append((name.strip(), regex.strip()) if colon else (part, part))
    return out


def first_match(body: Column, patterns: list[tuple[str, str]]) -> Column:
    """Id of the first pattern, in list order, that matches in any case."""
    found = [F.when(body.rlike("(?i)" + regex), F.lit(name)) for name, regex in patterns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def response_signal(status: Column, body: Column, challenges: list[tuple[str, str]], bots: list[tuple[str, str]]) -> Column:
    """429, then challenge pages, then answers of 200 that block bots, then 5xx, else success."""
    return (
        F.when(status == 429, F.lit("http_429"))
        .when(first_match(body, challenges).isNotNull(), F.lit("captcha_challenge"))
        .when((status == 200) & first_match(body, bots).isNotNull(), F.lit("anti_bot_200"))
        .when((status >= 500) & (status < 600), F.lit("http_5xx"))
        .otherwise(F.lit("success"))
    )


def exception_signal(error_type: Column, message: Column) -> Column:
    slow = F.lower(error_type).contains("timeout") | F.coalesce(F.lower(message).rlike("timed out|timeout"), F.lit(False))
    return F.when(slow, F.lit("timeout")).otherwise(F.lit("connection_failed"))


def weight(signal: Column) -> Column:
    known = F.create_map(*(F.lit(x) for k, v in WEIGHTS.items() for x in (k, v)))
    return F.element_at(known, signal)
