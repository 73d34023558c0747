"""Spark session helpers.

The library never creates a cluster session behind the caller's back: every
operator takes the DataFrames it works on.  ``get_session`` exists for tests,
``bench.py`` and command-line use on a single machine.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "estatelens") -> SparkSession:
    """A session tuned for this engine's jobs (AQE on, UTC, no UI)."""
    master = master or os.environ.get("ESTATELENS_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("ESTATELENS_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("ESTATELENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for kv in filter(None, os.environ.get("ESTATELENS_SPARK_CONF", "").split(",")):
        k, v = kv.split("=", 1)
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` must name a folder that the driver and
    all executors share; it is read, never replaced, and a cluster session
    without it is refused.  A local session without one gets a scratch folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    path = tempfile.mkdtemp(prefix="estatelens-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(path)
    return path


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once an application: they do not share the driver's ``sys.path``."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="estatelens-package-"), "estatelens.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for name in sorted(f for f in files if f.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.join("estatelens", os.path.relpath(path, here)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


_written: list[str] = []
SWEEP_BYTES = 32 << 20
_large = False


def materialize(df, by=(), compression=None):
    """Write ``df`` as a parquet table under the session's checkpoint folder
    and return the frame read back from it.

    This cuts the lineage (a lost executor no longer reruns everything
    upstream, and every later use sees the same rows), and the columnar
    files are cheaper to write and re-read than serialized row blocks.
    ``by`` names columns that get a folder for each value, for readers of one
    value at a time, ``compression`` another codec than the session's.
    ``release_tables`` deletes what a session has written.  The shuffle files behind a table of ``SWEEP_BYTES`` or more are
    not read again; Spark deletes them when their plan is collected, so it is asked to, at once and before the next table
    (listeners may hold the plan a little longer).
    """
    spark = df.sparkSession
    global _large
    if _large:
        spark.sparkContext._jvm.System.gc()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path, compression=compression)
    _written.append(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _large = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength() >= SWEEP_BYTES
    if _large:
        spark.sparkContext._jvm.System.gc()
    # the types of folder columns are taken from the frame, not guessed
    return spark.read.schema(df.schema).parquet(path) if by else spark.read.parquet(path)


class Passing:
    """Records the tables that ``materialize`` writes in its ``with`` block; ``drop`` deletes them, once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Passing:
        self.before = set(_written)
        return self

    def __exit__(self, *error) -> None:
        self.paths = [p for p in _written if p not in self.before]

    def drop(self) -> None:
        _delete(self.spark, self.paths)


def finished(spark: SparkSession, build: Callable[[], DataFrame], compression: str | None = None) -> DataFrame:
    """``build()``, written; the tables that were written on the way to it are deleted."""
    with Passing(spark) as steps:
        out = build()
    out = materialize(out, compression=compression)
    steps.drop()
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if p in _written:
            _written.remove(p)
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def release_tables(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` wrote in this process; frames that read them end with it.
    Returns their number."""
    n = len(_written)
    _delete(spark, list(_written))
    return n
