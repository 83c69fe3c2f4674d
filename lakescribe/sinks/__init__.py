"""Writers. Every dataset is partitioned by a hash bucket of its source, since one directory per
source would be too many for a fleet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescribe.functions.scratch import shuffles_removed
from lakescribe.model import Catalog
from lakescribe.operators import docs
from lakescribe.operators.documents import schema_documents
from lakescribe.operators.enrich import ORDER

BUCKETS = 64

# The four sheets, in their order.
SHEETS = {
    "Overview": docs.doc_overview,
    "Tables": docs.doc_tables,
    "Columns": docs.doc_columns,
    "Objects": docs.doc_objects,
}


def with_bucket(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("source_bucket", F.pmod(F.xxhash64("source_id"), F.lit(buckets)).cast("int"))


def _write(df: DataFrame, path: str, fmt: str, buckets: int, mode: str, order: list[str]) -> None:
    """Rows of a bucket come together but in as many tasks as their size needs: the rebalance hint
    splits a bucket that holds a huge source, and small buckets make one file each."""
    bucketed = with_bucket(df, buckets).hint("rebalance", "source_bucket")
    writer = bucketed.sortWithinPartitions("source_bucket", *order).write.mode(mode).partitionBy("source_bucket")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    with shuffles_removed(df.sparkSession):
        writer.format(fmt).save(path)


def write_sheets(cat: Catalog, path: str, fmt: str = "parquet", buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """One dataset per sheet below path, as Parquet or CSV."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"sheets are written as parquet or csv, not {fmt}")
    orders = {
        "Overview": ["source_id", "ord"],
        "Tables": ["source_id", "owner", "name"],
        "Columns": ["source_id", "owner", "table_name", "position"],
        "Objects": ["source_id", "section", "line", "owner", "name", "detail"],
    }
    for sheet, build in SHEETS.items():
        _write(build(cat), f"{path.rstrip('/')}/{sheet}", fmt, buckets, mode, orders[sheet])


def write_pages(pages: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """HTML pages as rows, from table_pages or summary_pages."""
    order = [c for c in pages.columns if c != "html"]
    _write(pages, path, "parquet", buckets, mode, order)


def write_documents(cat: Catalog, path: str, buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """JSON documents as rows (source_id, at, json), in the order of both within a file: a reader that appends the
    texts of a source as they come has its document."""
    _write(schema_documents(cat), path, "parquet", buckets, mode, ["source_id", "at"])


def write_catalog(cat: Catalog, path: str, buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Canonical frames as Parquet. Reports that read them back neither repeat the joins of the
    extraction nor depend on its lineage."""
    for kind, df in cat.items():
        _write(df, f"{path.rstrip('/')}/{kind}", "parquet", buckets, mode, list(ORDER[kind]))
