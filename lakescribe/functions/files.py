"""Names and small files below a folder that the driver and all executors share."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of what lies in a folder; none if there is no such folder."""
    fs, where = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def write_text(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A small file that is there as a whole or not at all; its name must be new."""
    fs, hidden = _at(spark, f"{folder}/.{name}.part")
    out = fs.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(hidden, _at(spark, f"{folder}/{name}")[1]):
        raise OSError(f"cannot write {folder}/{name}")


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).head().value
