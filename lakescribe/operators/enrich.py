"""Steps between the normalisers and the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from lakescribe.model import OBJECT_KINDS, Catalog, LazyFrames, spread, union_all

# The columns that order each frame.
ORDER = {
    "sources": ("source_id",),
    "tables": ("source_id", "owner", "name"),
    "columns": ("source_id", "owner", "table_name", "position"),
    "views": ("source_id", "owner", "name"),
    "indexes": ("source_id", "owner", "table_name", "name"),
    "routines": ("source_id", "owner", "name", "signature"),
    "sequences": ("source_id", "owner", "name"),
    "triggers": ("source_id", "owner", "target_table", "name"),
    "synonyms": ("source_id", "owner", "name"),
}


def union_dialects(catalogs: Sequence[Catalog]) -> Catalog:
    """One canonical frame per kind from the catalogs of all dialects."""
    kinds = ("sources", "columns", *OBJECT_KINDS)
    return LazyFrames({kind: lambda kind=kind: union_all([c[kind] for c in catalogs]) for kind in kinds})


def flatten_indexes(indexes: DataFrame, tables: DataFrame) -> DataFrame:
    """Database-level index list: the indexes of documented tables."""
    documented = tables.withColumnRenamed("name", "table_name").select("source_id", "owner", "table_name")
    return indexes.join(spread(documented), ["source_id", "owner", "table_name"], "left_semi")


def stable_order(df: DataFrame, frame: str) -> DataFrame:
    """Range-sorted by owner, object and position; no single task sees a whole source."""
    return df.orderBy(*ORDER[frame])
