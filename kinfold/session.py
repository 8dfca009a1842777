"""Session defaults, and the one way this library cuts a lineage: a table in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: With this the shuffle files of a finished write are removed at once, not at some later garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "kinfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and ANSI mode; `conf` overrides. On a cluster leave `master` unset."""
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app).config(map=defaults | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests, one machine), a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        # executors on other machines would each write to a disk of their own
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        given = "file://" + tempfile.mkdtemp(prefix="kinfold-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


_own: set[str] = set()


def tables_dir(spark: SparkSession) -> str:
    """This application's folder for tables. What `release` has left of it goes when the driver's Python ends."""
    folder = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    if folder not in _own:
        _own.add(folder)
        atexit.register(_remove, spark._jvm, spark._jsc.hadoopConfiguration(), folder)
    return folder


def _remove(jvm, conf, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by then
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, so that no node needs it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_kinfold_shipped", None) != sc.applicationId:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="kinfold-ship-")
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "kinfold_package"), "zip", os.path.dirname(here), os.path.basename(here)))
        sc._kinfold_shipped = sc.applicationId


def release(*tables: DataFrame) -> None:
    """Delete tables made by `materialise` that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        if not hasattr(df, "_kinfold_path"):
            continue
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kinfold_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    The lineage ends there, lost executors cost no recomputation, and the planner
    knows the table's true size, so later broadcasts rest on a measured bound.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinfold_path = path
    return out


#: If this setting is true, `table` deals out a table whose scan has fewer tasks than there are cores (one row group is one task).
SPREAD = "spark.kinfold.spreadSmallScans"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder, as the scan gives it; see SPREAD."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spark.conf.get(SPREAD, "false") != "true":
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
