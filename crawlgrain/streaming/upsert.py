"""A table of the latest row of each key, kept by a stream: bucketed, versioned, and idempotent by batch number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgrain.sources.connectors import Folder


def _current(folder: Folder) -> dict:
    names = folder.names("versions")
    return folder.read(f"versions/{names[-1]}") if names else {"version": 0, "batches": {}, "buckets": {}}


def upsert(path: str, key: str, order: list[str], buckets: int = 64, query: str = "stream") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps in path, for each key, the row that is last by order (ties: by all columns).

    A batch rewrites only the buckets its keys fall into, as new files; a version says which files count, and which batch came last.
    The version is written last, so readers see all of a batch or nothing, and a batch that comes again changes nothing. Files
    of the version before stay for its readers, older ones go.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, Folder(path)
        now = _current(folder)
        if number <= now["batches"].get(query, -1):
            return
        spread = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        rows = batch.withColumn("_bucket", spread).persist()
        try:
            touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # as many as there are buckets
            merged = rows
            held = [now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]]
            if held:
                merged = rows.unionByName(spark.read.schema(batch.schema).parquet(*(f"{path}/{h}" for h in held)).withColumn("_bucket", spread))
            best = merged.groupBy("_bucket", key).agg(F.max_by(F.struct(*batch.columns), F.struct(*order, *sorted(batch.columns))).alias("x")).select("_bucket", "x.*")
            label = f"data/{query}-{number:020d}"
            best.repartition(F.col("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/{label}")
        finally:
            rows.unpersist()
        version = now["version"] + 1
        after = {
            "version": version,
            "batches": now["batches"] | {query: number},
            "buckets": now["buckets"] | {str(b): f"{label}/_bucket={b}" for b in touched},
            "old": [now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]],
        }
        folder.write(f"versions/{version:020d}.json", after)
        for gone in now.get("old", []):
            folder.drop_tree(gone)

    return run


def read_latest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table as of its newest version."""
    found = [f"{path}/{p}" for p in _current(Folder(path))["buckets"].values()]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
