"""Identities: attempt, snapshot and storage keys, stable hashes and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def attempt_id(url_hash: Column, epoch_ms: Column) -> Column:
    return F.concat_ws(":", url_hash, F.lit("attempt"), epoch_ms.cast("string"))


def command_attempt_id(job_id: Column, canonical: Column) -> Column:
    """The same for every delivery of a command; null where job or URL is blank."""
    job, url = F.trim(job_id), F.trim(canonical)
    digest = F.substring(F.sha2(F.concat(job, F.lit("\u0000"), url), 256), 1, 16)
    return F.when((job != "") & (url != ""), F.concat_ws(":", F.sha2(url, 256), F.lit("attempt"), digest))


def stable_hash(value: Column, salt: str = "", length: int = 16) -> Column:
    text = F.concat(F.lit(salt + ":"), value) if salt else value
    return F.substring(F.sha2(text, 256), 1, length)


def pair_hash(left: Column, right: Column) -> Column:
    """Unsalted hash of two dimensions."""
    return stable_hash(F.concat_ws(":", left, right))


def host_bucket(host: Column, buckets: Column) -> Column:
    return F.conv(F.substring(F.sha2(host, 256), 1, 8), 16, 10).cast("long") % buckets


def rendezvous_score(host: Column, identity: Column, salt: str = "") -> Column:
    """Fixed-width hex that sorts as the number does."""
    return F.sha2(F.concat(F.lit(f"{salt}:" if salt else ""), host, F.lit(":"), identity), 256)


def snapshot_id(url_hash: Column, fetched_ms: Column) -> Column:
    return F.concat_ws(":", url_hash, fetched_ms.cast("string"))


def storage_key(url_hash: Column, host: Column, snapshot: Column, fetched_ms: Column) -> Column:
    day = F.date_format(F.timestamp_millis(fetched_ms), "yyyy/MM/dd")
    return F.concat_ws("/", F.lit("pages/v1"), day, stable_hash(host), url_hash, F.concat(snapshot, F.lit(".html.gz")))


def iso_z(epoch_ms: Column) -> Column:
    """ISO-8601 in UTC; the fraction is left out where it is 0."""
    t = F.timestamp_millis(epoch_ms)
    return F.when(epoch_ms % 1000 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def host_key(host: Column) -> Column:
    """Percent-encoded lower-cased host for use in keys."""
    e = F.url_encode(F.lower(F.trim(host)))
    return F.replace(F.replace(F.replace(e, F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def host_token(host: Column) -> Column:
    return F.translate(host, ".-", "__")


def download_slot(host: Column, identity: Column) -> Column:
    return F.concat_ws("@", host, identity)
