"""Data tables to be measured."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def read_tables(
    spark: SparkSession,
    directory: str,
    names: Iterable[str],
    fmt: str = "parquet",
    suffix: str = ".parquet",
) -> dict[str, DataFrame]:
    """One lazy frame per table; nothing is scanned beyond the file footers."""
    base = directory.rstrip("/")
    return {name: spark.read.format(fmt).load(f"{base}/{name}{suffix}") for name in names}
