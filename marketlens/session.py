"""Session helpers."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_marked: set[str] = set()
_written: list[str] = []  # scratch tables in the order of their writing


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Where the session names none, a temporary folder is made and set if driver and
    executors are one process on one machine; any other master is refused.
    """
    path = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{_CHECKPOINT_KEY} must name a folder that all executors share (master {master})")
        path = tempfile.mkdtemp(prefix="marketlens-")
        spark.conf.set(_CHECKPOINT_KEY, path)
    return path


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def run_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/marketlens-{spark.sparkContext.applicationId}"
    if path not in _marked:
        system, where = file_system(spark, path)
        system.mkdirs(where)
        system.deleteOnExit(where)
        _marked.add(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what was written so far; results that were not read yet are lost."""
    path = run_dir(spark)
    system, where = file_system(spark, path)
    system.delete(where, True)
    _marked.discard(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def no_shuffle_kept(spark: SparkSession):
    """Writes inside remove their shuffle files as they end: what was written stands for them.

    Spark would keep them until the driver happens to collect its garbage, those of
    every step of a job at once.
    """
    before = spark.conf.get(_CLEANUP_KEY, None)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP_KEY)
        else:
            spark.conf.set(_CLEANUP_KEY, before)


def materialize(df, name: str):
    """Write a table to the shared folder and read it back.

    Cuts lineage in a way that survives losing executors, and gives the
    optimizer real sizes for what follows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with no_shuffle_kept(spark):
        df.write.mode("errorifexists").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Writes what `build` returns and deletes the tables that were written on the way to it.

    Only for a `build` whose intermediate tables nothing else reads.
    """
    begun = len(_written)
    out = materialize(build(), name)
    for path in _written[begun:-1]:
        system, where = file_system(spark, path)
        system.delete(where, True)
    del _written[begun:-1]
    return out


def ship_package() -> None:
    """Sends this package's functions to Python workers with the tasks.

    Workers then need no copy of the package, and no file has to be placed
    anywhere for them.
    """
    cloudpickle.register_pickle_by_value(sys.modules["marketlens"])
