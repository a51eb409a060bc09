"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job wants regardless of cluster size. Nothing here names a
# number of executors or a partition size: those belong to spark-submit.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "priorlens", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or reuse) a session with the defaults this package expects."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once per session, so that Python functions run from any folder."""
    sc = spark.sparkContext
    if getattr(sc, "_priorlens_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "priorlens.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(target)
    sc._priorlens_shipped = True


def _shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, else a local one in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession) -> str:
    """A fresh path below the shared folder, for tables and stream progress."""
    return f"{_shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as a table and read it back.

    Used for tables that several branches of a plan read, and between rounds of
    an iterative operator. The copy lives in reliable storage, so a lost executor
    costs a re-read rather than the whole history; it is columnar, so later
    branches read only their columns, and its size is known to the optimizer. Nothing
    reads the shuffle files behind it again, so they are deleted once it is written.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(table: DataFrame) -> None:
    """Delete a table that ``cut_lineage`` wrote and nothing reads any more."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
