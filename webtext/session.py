"""Spark session defaults for the library's jobs.

On a cluster the session is created by the platform; ``configure`` only adds
settings that are unset. ``checkpoint_dir`` reads ``spark.checkpoint.dir``
from the session; where it is unset a ``local`` master gets a fresh local folder
and any other raises an error.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # raw HTML rows are large: keep Arrow batches to the Python worker small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),
    "spark.ui.enabled": "false",
}


def _driver_memory() -> str:
    """16 GB, or 60 % of physical memory on a smaller machine (local mode runs in the driver)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    return f"{max(1, min(16, int(total * 0.6 / 2**30)))}g"


def build_session(master: str | None = None, app: str = "webtext", shuffle_partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("WEBTEXT_DRIVER_MEMORY", _driver_memory()))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``webtext`` importable by the executors' Python workers, as
    ``--py-files`` would: the package's modules are zipped once per
    SparkContext and added with ``addPyFile`` (the page parser and the
    decision decoder run on the executors)."""
    sc = spark.sparkContext
    if getattr(sc, "_webtext_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="webtext-pyfiles-"), "webtext.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._webtext_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster; a fresh local one only
    where it is unset and all tasks run in this process (``local`` masters)."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="webtext-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def reliable_checkpoint(df):
    """``df.checkpoint()`` into the session's checkpoint folder (set first when unset).

    Used where a plan reads one expensive intermediate in several branches:
    the data is written once to the shared folder, lineage is cut, and a lost
    executor does not force recomputing it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint dir for written intermediate tables and stream state."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written_table(df, name: str):
    """``df`` written once as Parquet to the shared checkpoint folder and read back.

    Cuts lineage like :func:`reliable_checkpoint`; the reader also knows the
    table's true size, so Spark picks joins by it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
