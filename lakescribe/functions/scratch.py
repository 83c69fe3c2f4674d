"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder in local mode only: executors of a
    cluster could not see it, so there an unset folder is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or _OWN_FOLDER.get(sc.applicationId)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _OWN_FOLDER[sc.applicationId] = tempfile.mkdtemp(prefix="checkpoint-")
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """The rows without their lineage: written as a Parquet table in the shared folder, and read from there.

    The table stays until the folder is cleaned, as checkpoints do.
    """
    return written(df, codec)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder below the shared one, once nothing reads it any more."""
    if not path.startswith(shared_folder(spark) + "/"):
        raise ValueError(f"not below the shared folder: {path}")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end within have their shuffle files removed at once. Otherwise these stay until the driver happens to
    collect its garbage, so that the steps of a report add up on the executors' disks."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, codec: str | None = None) -> tuple[DataFrame, str]:
    """`cut`, and the folder of the table, for those who `remove` it later."""
    path = new_folder(df.sparkSession, "cut")
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
