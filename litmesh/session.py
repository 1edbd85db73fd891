"""Session helpers shared by every operator: tables, staging, checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables in ``sf_dir``; column pruning and pushdown stay with Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one a cluster names in ``spark.checkpoint.dir``.

    Only where executors and driver are one machine (tests, local mode) a temporary folder does
    instead; on a cluster without the setting this is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="litmesh-checkpoint-")
        context.setCheckpointDir(named)
    return named


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is the cluster's to sweep
        pass


_SCOPES: list[list[tuple[SparkSession, str]]] = []


@contextlib.contextmanager
def staged():
    """Tables staged within are removed at the end: write or collect the result inside. Outside of any scope they stay until the driver ends."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, path in _SCOPES.pop():
            _remove(spark, path)
            _PATHS.discard((spark, path))


_PATHS: set[tuple[SparkSession, str]] = set()


@atexit.register
def _sweep() -> None:
    for spark, path in _PATHS:
        _remove(spark, path)


def stage(df: DataFrame, *, partition_hint: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    Unlike a cached frame it survives the loss of executors, unlike ``checkpoint()`` it is columnar
    and compressed. It is removed at the end of the `staged` scope it was made in, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stage-{os.getpid()}-{uuid.uuid4().hex}"
    (df if partition_hint is None else df.coalesce(partition_hint)).write.option("compression", "zstd").parquet(path)
    _PATHS.add((spark, path))
    if _SCOPES:
        _SCOPES[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
