"""The normalised metadata lake: canonical frames, landed once and read by all reports and audits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescribe.model import FRAMES, Catalog, LazyFrames


def read_catalog(spark: SparkSession, path: str, buckets: Iterable[int] | None = None) -> Catalog:
    """Catalog written by write_catalog; a choice of buckets prunes directories."""
    chosen = None if buckets is None else list(buckets)

    def read(kind: str) -> DataFrame:
        schema = FRAMES[kind]
        landed = T.StructType([*schema.fields, T.StructField("source_bucket", T.IntegerType())])
        rows = spark.read.schema(landed).parquet(f"{path.rstrip('/')}/{kind}")
        if chosen is not None:
            rows = rows.where(F.col("source_bucket").isin(*chosen))
        return rows.select(*schema.names)

    return LazyFrames({kind: lambda kind=kind: read(kind) for kind in FRAMES})
