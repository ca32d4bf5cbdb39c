"""Runtime policy: first-match scope lookup, field-wise override, gates, and the document with last-known-good."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlgrain.functions import commands

# Fixed values of the domain.
SCOPES = ["policy_scope_id", "politeness_key", "host_id", "site_id", "tier"]
STRATEGIES = ["STICKY_POOL", "STICKY_BY_HOST", "ROUND_ROBIN"]
RANGES = {
    "sticky_pool_size": (1, 1024), "host_ip_min_delay_ms": (0, 3_600_000), "host_ip_jitter_ms": (0, 3_600_000),
    "download_timeout_seconds": (1, 3600), "max_retries": (0, 100), "max_local_delay_seconds": (0, 86_400),
}
RETRYABLE = [408, 429, 500, 502, 503, 504, 522, 524]

#: Scopes that are looked up by broadcast, at most (some tens of MB).
SMALL = 100_000

POLICY_FIELDS = ["enabled", "paused", "pause_reason", "egress_selection_strategy", *RANGES]
POLICY_TYPE = T.StructType(
    [T.StructField("enabled", T.BooleanType()), T.StructField("paused", T.BooleanType()), T.StructField("pause_reason", T.StringType()), T.StructField("egress_selection_strategy", T.StringType())]
    + [T.StructField(f, T.IntegerType()) for f in RANGES]
)
BOOTSTRAP = {
    "enabled": True, "paused": False, "egress_selection_strategy": "STICKY_POOL", "sticky_pool_size": 4, "host_ip_min_delay_ms": 2000,
    "host_ip_jitter_ms": 500, "download_timeout_seconds": 30, "max_retries": 2, "max_local_delay_seconds": 300,
}


def document_errors(document: object) -> list[str]:
    """Everything that is wrong with a policy document (small, on the driver), sorted."""
    if not isinstance(document, dict):
        return ["document is no object"]
    errors = [] if document.get("schema_version") == "1.0" else ["schema_version"]
    if not isinstance(document.get("version"), str) or not document["version"].strip():
        errors.append("version")
    try:
        datetime.fromisoformat(document["generated_at"].strip().replace("Z", "+00:00"))
    except (KeyError, AttributeError, ValueError):
        errors.append("generated_at")

    def check(policy: object, at: str) -> None:
        if not isinstance(policy, dict):
            errors.append(at)
            return
        for name, value in policy.items():
            if name in RANGES:
                low, high = RANGES[name]
                fine = value is None or type(value) is int and low <= value <= high
            elif name in ("enabled", "paused"):
                fine = value is None or isinstance(value, bool)
            elif name == "egress_selection_strategy":
                fine = value is None or isinstance(value, str) and value.strip().upper() in STRATEGIES
            elif name == "pause_reason":
                fine = value is None or isinstance(value, str) and bool(value.strip())
            else:
                fine = False
            if not fine:
                errors.append(f"{at}.{name}")

    check(document.get("default_policy"), "default_policy")
    seen = set()
    scopes = document.get("scope_policies") or []
    if not isinstance(scopes, list):
        return sorted([*errors, "scope_policies"])
    for i, scope in enumerate(scopes):
        at = f"scope_policies[{i}]"
        if not isinstance(scope, dict) or scope.get("scope_type") not in SCOPES or not isinstance(scope.get("scope_id"), str) or not scope["scope_id"].strip():
            errors.append(at)
            continue
        key = (scope["scope_type"], scope["scope_id"].strip())
        if key in seen:
            errors.append(f"{at} repeats {key}")
        seen.add(key)
        check(scope.get("policy"), at)
    return sorted(errors)


@dataclass
class PolicyProvider:
    """The policy document in a file, looked at once per micro-batch; an invalid or missing one leaves the last good one in force."""

    path: str
    document: dict = field(default_factory=lambda: {"version": "bootstrap", "default_policy": BOOTSTRAP, "scope_policies": []})
    result: str = "bootstrap"
    good: bool = False
    _seen: float | None = None

    def current(self) -> dict:
        try:
            changed = os.stat(self.path).st_mtime_ns
            if changed == self._seen:
                self.result = "not_modified"
                return self.document
            with open(self.path, encoding="utf-8") as f:
                loaded = json.load(f)
        except OSError:
            self.result = "read_error"
            return self.document
        except ValueError:
            self.result = "validation_error"
            return self.document
        if document_errors(loaded):
            self.result = "validation_error"
        else:
            self.document, self.result, self.good, self._seen = loaded, "success", True, changed
        return self.document

    @property
    def last_known_good_active(self) -> bool:
        return self.good and self.result in ("read_error", "validation_error")


def scope_table(spark: SparkSession, document: dict) -> DataFrame:
    """(scope_type, scope_id, policy): as many rows as the document has scopes."""

    def value(policy: dict, f: str):
        v = policy.get(f)
        v = v.strip() if isinstance(v, str) else v
        return v.upper() if f == "egress_selection_strategy" and v is not None else v

    rows = [(s["scope_type"], s["scope_id"].strip(), tuple(value(s.get("policy") or {}, f) for f in POLICY_FIELDS)) for s in document.get("scope_policies") or []]
    return spark.createDataFrame(rows, T.StructType([T.StructField("scope_type", T.StringType()), T.StructField("scope_id", T.StringType()), T.StructField("policy", POLICY_TYPE)]))


def decide(commands_df: DataFrame, scopes: DataFrame, default: dict, key: str) -> DataFrame:
    """commands with matched_scope_type, matched_scope_id and the policy's fields.

    The first scope in order that has a policy decides; scopes never stack, and an override can't
    set a field back to null. Up to SMALL scopes are broadcast, one lookup for each kind; more are joined by kind and id. key identifies a command.
    """
    present = [s for s in SCOPES if s in commands_df.columns]
    over = {f: F.coalesce(F.col(f"hit.policy.{f}"), F.lit(default.get(f)).cast(POLICY_TYPE[f].dataType)) for f in POLICY_FIELDS}
    if present and scopes.count() <= SMALL:
        out = commands_df
        for s in present:
            own = scopes.where(F.col("scope_type") == s).select(F.col("scope_id").alias(f"_id_{s}"), F.struct("scope_type", "scope_id", "policy").alias(f"_hit_{s}"))
            out = out.join(F.broadcast(own), commands.blank_to_null(F.col(s)) == F.col(f"_id_{s}"), "left")
        out = out.withColumn("hit", F.coalesce(*(f"_hit_{s}" for s in present))).drop(*(f"_{x}_{s}" for x in ("id", "hit") for s in present))
        out = out.withColumns({f"policy_{f}": c for f, c in over.items()})
        return out.withColumns({"matched_scope_type": F.coalesce("hit.scope_type", F.lit("default")), "matched_scope_id": F.col("hit.scope_id")}).drop("hit")
    tried = F.array(*(F.struct(F.lit(i).alias("prio"), F.lit(s).alias("scope_type"), commands.blank_to_null(F.col(s)).alias("scope_id")) for i, s in enumerate(SCOPES) if s in present))
    asked = commands_df.select(F.col(key).alias("_k"), F.explode(F.filter(tried, lambda t: t["scope_id"].isNotNull())).alias("t")).select("_k", "t.*")
    hit = asked.join(scopes, ["scope_type", "scope_id"]).groupBy("_k").agg(F.min_by(F.struct("scope_type", "scope_id", "policy"), "prio").alias("hit"))
    out = commands_df.join(hit, F.col(key) == F.col("_k"), "left").drop("_k")
    out = out.withColumns({f"policy_{f}": c for f, c in over.items()})
    return out.withColumns({"matched_scope_type": F.coalesce("hit.scope_type", F.lit("default")), "matched_scope_id": F.col("hit.scope_id")}).drop("hit")


def gate(paused: Column, enabled: Column, deadline_at: Column, now_ms: int | Column, strategy: Column | None = None, identity: Column | None = None) -> Column:
    """What stops a command before the fetch: paused before deadline_expired before egress_unavailable; null if nothing does.

    The last one delays a command, the others end it. It is looked at where identity (what egress selection found, null: all
    candidates in cooldown) is given, and only for the strategy STICKY_POOL.
    """
    now = F.timestamp_millis(F.lit(now_ms) if isinstance(now_ms, int) else now_ms)
    stopped = F.when(paused | ~enabled, F.lit("paused")).when(now >= commands.deadline(deadline_at), F.lit("deadline_expired"))
    if identity is None:
        return stopped
    sticky = F.coalesce(strategy, F.lit("STICKY_POOL")) == "STICKY_POOL" if strategy is not None else F.lit(True)
    return F.coalesce(stopped, F.when(sticky & identity.isNull(), F.lit("egress_unavailable")))


def outcome(status: Column, failed: Column, deliveries: Column, max_retries: Column) -> Column:
    """retry, retry_exhausted, failed or fetched: a retryable result is retried while deliveries <= max_retries."""
    again = failed | F.coalesce(status.isin(RETRYABLE), F.lit(False))
    return F.when(again & (deliveries <= max_retries), F.lit("retry")).when(again, F.lit("retry_exhausted")).otherwise(F.lit("fetched"))
