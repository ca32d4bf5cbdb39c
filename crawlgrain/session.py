"""What a session needs before it runs the library's Python code on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per context, so that workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_crawlgrain_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(top):  # else it came to this process as a shipped file itself
        path = os.path.join(tempfile.mkdtemp(prefix="crawlgrain-"), "crawlgrain.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(top):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("crawlgrain", os.path.relpath(full, top)))
        context.addPyFile(path)
    context._crawlgrain_shipped = True


_LOCAL_DIR = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset and the session is local (tests, one machine) is a folder made.
    """
    global _LOCAL_DIR
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="crawlgrain-")
    return "file://" + _LOCAL_DIR


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, for plans that read it several times."""
    path = os.path.join(shared_dir(df.sparkSession), "crawlgrain", f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
