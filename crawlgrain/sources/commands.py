"""Scans and sinks of commands, seeds, identity maps, objects and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlgrain.functions import commands, content, ids, net, urls
from crawlgrain.session import written

COMMAND_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in (*commands.FIELDS, "payload")])


def parse_jsonl(lines: DataFrame) -> DataFrame:
    """Command columns and error from a text column value; blank lines are skipped, other lines become rows.

    A command may come wrapped: the JSON object in its payload, an object or its text, then gives all fields.
    """
    rows = lines.where(F.trim("value") != "")
    good = F.get_json_object("value", "$").isNotNull() & F.trim("value").rlike(r"(?s)^\{.*\}$")
    found = commands.unwrap(rows.withColumn("c", F.from_json("value", COMMAND_SCHEMA)).select("value", "c.*", F.when(~good, "no JSON object").alias("error")))
    return found.select("value", *commands.FIELDS, F.coalesce("error", "payload_error").alias("error"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return parse_jsonl(spark.read.text(path))


def seed_lines(lines: DataFrame) -> DataFrame:
    """url from a text column value: blank lines and # comments go."""
    return lines.select(F.trim("value").alias("url")).where((F.col("url") != "") & ~F.startswith("url", F.lit("#")))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return seed_lines(spark.read.text(path))


def inline_seeds(spark: SparkSession, text: str) -> DataFrame:
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("at", "value"))
    return rows.select("at", F.trim("value").alias("url")).where("url <> ''")


def repeat_seeds(seeds: DataFrame, order: Column, times: int, most: int | None) -> DataFrame:
    """Seeds replayed `times` times in order, cut after `most` rows (the reader's own limit)."""
    rows = seeds.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).orderBy("round", order)
    return rows.limit(most) if most is not None else rows


def generate_commands(
    seeds: DataFrame, order: Column, job_id: str, prefix: str, *, politeness_prefix: str | None = None, host_id_prefix: str | None = None, deadline_at: str | None = None, max_retries: int | None = None
) -> DataFrame:
    """Numbered commands from url rows; command_id is prefix:00000001 and so on, in the given order.

    canonical_url is null where url has no canonical form. politeness_key is the prefix and the host, host_id the prefix and the
    host with underscores; these and deadline_at and max_retries are null unless given.
    Numbers need one global order: rows are counted per range partition first, so no task sees all rows. Ranges are written to
    the shared folder when this is called, since two readings of a plan may draw their borders in different places.
    """
    ranged = seeds.select("url", order.alias("_order")).repartitionByRange("_order").sortWithinPartitions("_order")
    ranged = written(ranged.select("url", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # one row a partition
    numbered = ranged.join(before, "_part").withColumn("no", F.coalesce("before", F.lit(0)) + F.col("_at") - F.col("first") + 1)
    host = urls.host(F.col("canonical_url"))
    number = F.col("no").cast("string")
    return numbered.withColumn("canonical_url", urls.canonical_url(F.col("url"))).select(
        F.concat(F.lit(prefix + ":"), F.lpad(number, F.greatest(F.lit(8), F.length(number)), F.lit("0"))).alias("command_id"),
        F.lit(job_id).alias("job_id"),
        "url",
        "canonical_url",
        F.concat(F.lit(host_id_prefix), ids.host_token(host)).alias("host_id"),
        F.concat(F.lit(politeness_prefix), host).alias("politeness_key"),
        F.lit(deadline_at).alias("deadline_at"),
        F.lit(max_retries).cast("int").alias("max_retries"),
    )


def duplicates(commands_df: DataFrame) -> DataFrame:
    """(job_id, canonical_url, n) of what more than one command asks for; commands without either are no duplicates."""
    named = commands_df.where((F.coalesce(F.trim("job_id"), F.lit("")) != "") & F.col("canonical_url").isNotNull())
    return named.groupBy("job_id", "canonical_url").agg(F.count("*").alias("n")).where("n > 1")


def wire_fields(commands_df: DataFrame) -> DataFrame:
    """map<string,string> of the columns: null becomes '', nested values compact JSON with their nulls, the rest text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    text = lambda f: F.to_json(f.name, {"ignoreNullFields": "false"}) if isinstance(f.dataType, nested) else F.col(f.name).cast("string")
    pairs = [x for f in commands_df.schema for x in (F.lit(f.name), F.coalesce(text(f), F.lit("")))]
    return commands_df.select(F.create_map(*pairs).alias("fields"))


def read_identity_map(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(bind_ip, public_ip) from 'csv' with header, 'csv-plain' without, or 'json' (objects, or one object of pairs)."""
    if kind == "csv-plain":
        return spark.read.schema("bind_ip string, public_ip string").csv(path)
    if kind == "csv":
        rows = spark.read.option("header", True).csv(path)
        bind = next(c for c in ("bind_ip", "private_ip") if c in rows.columns)
        return rows.select(F.trim(bind).alias("bind_ip"), F.trim("public_ip").alias("public_ip"))
    whole = spark.read.text(path, wholetext=True)
    item = "array<struct<bind_ip:string,private_ip:string,public_ip:string>>"
    listed = whole.where(F.trim("value").startswith("[")).select(F.explode(F.from_json("value", item)).alias("x")).select(F.coalesce("x.bind_ip", "x.private_ip").alias("bind_ip"), "x.public_ip")
    paired = whole.where(F.trim("value").startswith("{")).select(F.explode(F.from_json("value", "map<string,string>")).alias("bind_ip", "public_ip"))
    return listed.unionByName(paired)


def usable_ips(ips: DataFrame, excluded: DataFrame, order: Column) -> DataFrame:
    """Usable IPv4 addresses (ip), minus excluded ones, first seen once, in order of first sight."""
    good = ips.select(F.trim("ip").alias("ip"), order.alias("_o")).where(net.usable_ipv4(F.col("ip")))
    return good.join(excluded.select(F.trim("ip").alias("ip")), "ip", "left_anti").groupBy("ip").agg(F.min("_o").alias("first_seen"))


def write_objects(pages: DataFrame, path: str) -> None:
    """(storage_key, body, sha256, raw_size) as Parquet; body is gzip."""
    raw = F.col("body").cast("binary")
    pages.select("storage_key", content.gzip_bytes(raw).alias("body"), F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).alias("raw_size")).write.mode("overwrite").parquet(path)


def verify_objects(spark: SparkSession, path: str) -> DataFrame:
    """(storage_key, ok): unpacked bytes have the stored digest and size."""
    raw = content.gunzip_bytes(F.col("body"))
    return spark.read.parquet(path).withColumn("raw", raw).select("storage_key", ((F.sha2("raw", 256) == F.col("sha256")) & (F.octet_length("raw") == F.col("raw_size"))).alias("ok"))


def fact_messages(attempts: DataFrame) -> DataFrame:
    """(key, value): attempt_id and JSON with sorted keys and nulls kept, as a message sink takes them."""
    names = sorted(attempts.columns)
    return attempts.select(F.col("attempt_id").alias("key"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))


def write_facts(attempts: DataFrame, path: str) -> None:
    """Facts as Parquet, partitioned by day so that date filters prune files."""
    day = F.to_date(F.timestamp_millis("attempted_at_ms"))
    attempts.withColumn("attempted_date", day).write.mode("append").partitionBy("attempted_date").parquet(path)


def enough_idle(pending: DataFrame, least_ms: int) -> DataFrame:
    return pending.where(F.col("idle_ms") >= least_ms)


def delivery_counts(commands_df: DataFrame, pending: DataFrame, most: int) -> DataFrame:
    """commands with deliveries; where none is known it is `most`."""
    return commands_df.join(pending.select("message_id", "deliveries"), "message_id", "left").withColumn("deliveries", F.coalesce("deliveries", F.lit(most)))


def slots(commands_df: DataFrame) -> DataFrame:
    return commands_df.withColumn("download_slot", ids.download_slot(F.col("host"), F.col("identity")))


def flatten_responses(responses: DataFrame) -> DataFrame:
    """(stream, message_id, deliveries, FIELDS, error) of responses: array<struct<stream, messages: array<struct<id, deliveries, fields: map>>>>.

    One row for each message, wrapped commands unwrapped; what is wrong with a command is its error, null if nothing is. Deliveries are 1 where none are said.
    """
    rows = responses.select(F.explode("responses").alias("r")).select("r.stream", F.explode("r.messages").alias("m"))
    held = {f: F.try_element_at("m.fields", F.lit(f)).alias(f) for f in (*commands.FIELDS, "payload")}
    rows = commands.unwrap(rows.select("stream", F.col("m.id").alias("message_id"), F.coalesce("m.deliveries", F.lit(1)).cast("long").alias("deliveries"), *held.values()))
    error = F.coalesce("payload_error", commands.command_error({f: F.col(f) for f in commands.FIELDS}))
    return rows.select("stream", "message_id", "deliveries", *commands.FIELDS, error.alias("error"))
