"""Names and state of a worker: templates, consumer names, readiness, decoded headers, request context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlgrain.functions import commands

# Fixed values of the domain: the spellings that a template may use for each value.
SPELLINGS = {"node": ["${NODE_NAME}", "$(NODE_NAME)", "{NODE_NAME}", "{node_name}"], "pod": ["${POD_NAME}", "$(POD_NAME)", "{POD_NAME}", "{pod_name}"]}
#: Well-formed UTF-8 sequences, each byte seen as one Latin-1 character.
UTF8 = (
    r"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    r"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)


def render(template: Column, node: Column, pod: Column) -> Column:
    """The template with node and pod in place of all their spellings, trimmed."""
    for value, spellings in ((node, SPELLINGS["node"]), (pod, SPELLINGS["pod"])):
        for s in spellings:
            template = F.replace(template, F.lit(s), value)
    return F.trim(template)


def consumer_name(explicit: Column, template: Column, node: Column, pod: Column, hostname: Column) -> Column:
    """The explicit name, else the rendered template, else node-pod, else the host's name; the middle two need both node and pod."""
    blank = commands.blank_to_null
    n, p = blank(node), blank(pod)
    both = n.isNotNull() & p.isNotNull()
    return F.coalesce(blank(explicit), F.when(both, blank(render(blank(template), n, p))), F.when(both, F.concat_ws("-", n, p)), hostname)


def routed(debug: Column, plain: str, template: str, node: Column, pod: Column) -> Column:
    """Name of a stream or group: in debug mode the rendered template, else the plain name."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return F.when(F.coalesce(debug, F.lit(False)), render(F.lit(template), text(node), text(pod))).otherwise(F.lit(plain))


def heartbeat_age(last_ms: Column, now_ms: Column | int) -> Column:
    """Seconds since the last heartbeat, 0 for one ahead of time; null without one."""
    return F.when(last_ms.isNotNull(), F.greatest(F.lit(now_ms) - last_ms, F.lit(0)) / 1000)


def ready(initialized: Column, last_ms: Column, now_ms: Column | int, most_seconds: int = 30) -> Column:
    return F.coalesce(initialized, F.lit(False)) & F.coalesce(heartbeat_age(last_ms, now_ms) <= most_seconds, F.lit(False))


def readable(raw: Column) -> Column:
    """Bytes as text; bytes that are no UTF-8 are left out."""
    kept = F.array_join(F.regexp_extract_all(F.decode(raw, "ISO-8859-1"), F.lit(UTF8), F.lit(0)), "")
    return F.decode(F.encode(kept, "ISO-8859-1"), "UTF-8")


def replaced(raw: Column) -> Column:
    """Bytes as text; bytes that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def headers(raw: Column) -> Column:
    """map<string, string> of map<string, array<binary>>: the last value of each header, readable."""
    return F.transform_values(raw, lambda _, v: readable(F.try_element_at(v, F.lit(-1))))


def request_context(c: dict[str, Column]) -> Column:
    """What a request carries of its command, as one struct; deliveries are 1 at least."""
    names = [*commands.OPTIONAL, "job_id", "attempt_id", "canonical_url", "url_hash", "stream_id"]
    held = [c.get(n, F.lit(None).cast("string")).alias(n) for n in names]
    return F.struct(F.lit(True).alias("candidate"), *held, F.greatest(F.coalesce(c.get("deliveries", F.lit(1)), F.lit(1)).cast("long"), F.lit(1)).alias("deliveries"))
