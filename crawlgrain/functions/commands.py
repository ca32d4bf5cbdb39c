"""Fetch commands: validation without exceptions, bounded numbers, deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrain.functions import urls

OPTIONAL = ["command_id", "trace_id", "host_id", "site_id", "tier", "politeness_key", "policy_scope_id", "deadline_at", "max_retries"]
FIELDS = ["url", "job_id", "canonical_url", *OPTIONAL]


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def bounded_int(text: Column, low: int = 0, high: int = 100) -> Column:
    """The number, null if blank or out of range or no number."""
    t = blank_to_null(text)
    value = F.when(t.rlike(r"^[+-]?[0-9]{1,9}$"), F.regexp_replace(t, r"^\+", "").try_cast("int"))
    return F.when(value.between(low, high), value)


def deadline(text: Column) -> Column:
    """ISO time as timestamp; a time without zone is UTC (the session's zone)."""
    return F.try_to_timestamp(blank_to_null(text))


def command_error(c: dict[str, Column], payload: Column | None = None) -> Column:
    """The first thing that is wrong with a command, null if nothing is."""
    checks = []
    if payload is not None:
        given = blank_to_null(payload)
        checks.append(F.when(given.isNotNull() & (F.coalesce(F.get_json_object(given, "$"), F.lit("")).rlike(r"^\s*\{") == F.lit(False)), F.lit("payload is no JSON object")))
    for name in ("url", "job_id", "canonical_url"):
        checks.append(F.when(blank_to_null(c[name]).isNull(), F.lit(f"missing {name}")))
    for name in ("canonical_url", "url"):
        checks.append(F.when(urls.url_error(c[name]).isNotNull(), F.lit(f"invalid {name}")))
    checks.append(F.when(blank_to_null(c["deadline_at"]).isNotNull() & deadline(c["deadline_at"]).isNull(), F.lit("invalid deadline_at")))
    checks.append(F.when(blank_to_null(c["max_retries"]).isNotNull() & bounded_int(c["max_retries"]).isNull(), F.lit("invalid max_retries")))
    return F.coalesce(*checks)


def unwrap(rows: DataFrame) -> DataFrame:
    """rows whose payload, where it isn't null, replaces all FIELDS by those of its JSON object, with payload_error."""
    given = F.col("payload").isNotNull()
    valid = F.try_parse_json(F.col("payload")).isNotNull()
    whole = valid & F.startswith(F.ltrim("payload"), F.lit("{"))
    inside = F.from_json("payload", "map<string,string>")
    own = {f: F.col(f).cast("string") if f in rows.columns else F.lit(None).cast("string") for f in FIELDS}
    error = F.when(given & ~valid, F.lit("invalid payload json")).when(given & ~whole, F.lit("payload must be a JSON object"))
    return rows.withColumns({f: F.when(given & whole, F.try_element_at(inside, F.lit(f))).when(~given, c) for f, c in own.items()} | {"payload_error": error})


def has_context(c: dict[str, Column]) -> Column:
    return F.coalesce(*(blank_to_null(c[k]) for k in ("policy_scope_id", "politeness_key", "host_id", "site_id", "tier"))).isNotNull()
