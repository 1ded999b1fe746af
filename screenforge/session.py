"""Session settings the jobs in this package rely on."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import importlib
import os
import shutil
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import SparkSession

# An Arrow batch on its way to a Python worker is cut at about so many bytes, besides Spark's row limit.
BATCH_BYTES = 4 << 20

SETTINGS = {
    # Runtime re-planning: coalesces small shuffle partitions and splits skewed join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # File contents travel to Python workers; bound a batch by bytes, not by rows alone.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "screenforge", master: str | None = None, **extra: str) -> SparkSession:
    """A session with :data:`SETTINGS`. ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name for an intermediate table.

    It lies in the shared folder of ``spark.checkpoint.dir``, or else of ``setCheckpointDir``. Where
    neither is set, a local session uses a temporary folder of this machine, which is dropped when the
    process ends; on a cluster, whose machines would not see each other's files, this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="screenforge-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df, label: str, **options: str):
    """Write ``df`` to a scratch table and read it back: cuts lineage and survives lost executors. ``options`` go to the writer."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes, so that many long texts in a row don't fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_memory_back() -> None:
    """Let a Python worker that lives on return the memory it no longer uses to its machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_shipped: set[tuple[str, str]] = set()


def ship_packages(spark: SparkSession, *names: str) -> None:
    """Give the Python workers of this application the named packages, once.

    Not needed where the packages are installed on the cluster or passed with ``--py-files``.
    """
    context = spark.sparkContext
    for name in names:
        if (context.applicationId, name) in _shipped:
            continue
        root = os.path.dirname(os.path.abspath(importlib.import_module(name).__file__))
        folder = tempfile.mkdtemp(prefix="screenforge-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = os.path.join(folder, f"{name}.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for at, _, files in os.walk(root):
                for file in files:
                    if file.endswith(".py"):
                        full = os.path.join(at, file)
                        archive.write(full, os.path.join(name, os.path.relpath(full, root)))
        context.addPyFile(target)
        _shipped.add((context.applicationId, name))
