"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pressloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this package expects; cluster settings win when already given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local folder is only made up for a
    ``local`` master, where driver and executors share one disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="pressloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


ROW_GROUP = 16 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("_scopes", default=())


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a frame once to the shared folder and read it back: lineage ends, executors may die.

    The shuffle files of the write go with its end, as the table replaces them. Inside ``scratch`` the table
    goes with the scope; with ``keep`` it belongs to the scope around that one, or to the caller.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with setting(spark, CLEANUP, "true"):
        # a task buffers a whole row group, several times the size of what lies on disk
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    owners = _scopes.get()[:-1] if keep else _scopes.get()
    if owners:
        owners[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(table: DataFrame) -> None:
    """Drop a table written by ``materialise`` before its scope ends; nothing may read it any more."""
    for path in {os.path.dirname(file) for file in table.inputFiles()}:
        _delete(table.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drop the tables written by ``materialise`` inside, at the end or when the work fails.

    Nothing lazy that reads them may leave the scope: end it with a kept table.
    """
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            _delete(spark, path)


def spread(scan: DataFrame, *keys) -> DataFrame:
    """Spread a scan over the cores when it has fewer splits than cores; never lower their number.

    Only for frames without a shuffle in them: the partition count comes from planning alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)
