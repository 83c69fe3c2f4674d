"""Which owners and which kinds of objects are documented."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescribe.model import OBJECT_KINDS, Catalog, LazyFrames, spread

ALL = "*"
Schemas = Sequence[str] | str | None

# Owners kept when none are named; MySQL keeps the connected database, Oracle all.
DEFAULT_OWNERS = {"postgresql": ("public",), "mssql": ("dbo",)}
SYSTEM_OWNERS = {
    "postgresql": ("pg_catalog", "information_schema"),
    "mysql": ("mysql", "performance_schema", "sys", "information_schema"),
    "oracle": ("SYS", "SYSTEM"),
    "mssql": ("sys", "INFORMATION_SCHEMA"),
}


def filter_schemas(
    df: DataFrame, dialect: str, names: Schemas = None, owner: str = "owner", info: DataFrame | None = None
) -> DataFrame:
    """Keep the named owners, the dialect's default when none are named, or all for '*'.

    A list is a literal filter, so it reaches the scan. Only the MySQL default differs by source; it is
    a semi join with one row per source.
    """
    if names == ALL:
        return df
    names = [names] if isinstance(names, str) else list(names or DEFAULT_OWNERS.get(dialect, ()))
    if names:
        return df.where(F.col(owner).isin(*names))
    if dialect == "mysql":
        if info is None:
            raise ValueError("the MySQL default is the connected database, which needs database_info")
        connected = info.select("source_id", F.col("database_name").alias(owner)).distinct()
        return df.join(spread(connected), ["source_id", owner], "left_semi")
    return df


@dataclass(frozen=True)
class ObjectFilter:
    """Switches of an extraction; the defaults keep everything."""

    include: Sequence[str] = OBJECT_KINDS
    exclude_types: Sequence[str] = ()
    tables: Sequence[str] = ()
    exclude_system: bool = False
    row_counts: bool = True


# Where a frame names the table that it belongs to, and which frames have excludable types.
_TABLE_NAME = {"tables": "name", "columns": "table_name", "indexes": "table_name", "triggers": "target_table"}
_TYPED = ("tables", "views", "routines", "indexes")


def _filter_kind(kind: str, df: DataFrame, cfg: ObjectFilter) -> DataFrame:
    if kind in OBJECT_KINDS and kind not in cfg.include:
        return df.where(F.lit(False))  # folded away with everything below it
    if kind == "columns":  # go with the object they belong to
        for owner_kind, object_kind in (("tables", "TABLE"), ("views", "VIEW")):
            if owner_kind not in cfg.include:
                df = df.where(F.col("object_kind") != object_kind)
    if cfg.exclude_types and kind in _TYPED:
        df = df.where(~F.col("type").isin(*cfg.exclude_types))
    if cfg.exclude_system and "owner" in df.columns:
        for dialect, owners in SYSTEM_OWNERS.items():
            df = df.where(~((F.col("dialect") == dialect) & F.col("owner").isin(*owners)))
    if cfg.tables and kind in _TABLE_NAME:
        named = F.col(_TABLE_NAME[kind]).isin(*cfg.tables)
        df = df.where(named if kind != "columns" else named | (F.col("object_kind") != "TABLE"))
    if kind == "tables" and not cfg.row_counts:
        df = df.withColumn("row_count", F.lit(0).cast("long"))
    return df


# Which columns name the table or view that the rows of a frame belong to.
_BELONGS = {"columns": "table_name", "indexes": "table_name", "triggers": "target_table"}


def _without_excluded(cat: Catalog, df: DataFrame, name: str, cfg: ObjectFilter) -> DataFrame:
    """Less the rows that belong to a table or view of an excluded type."""
    gone = None
    for kind in ("tables", "views"):
        part = cat[kind].where(F.col("type").isin(*cfg.exclude_types)).select("source_id", "owner", F.col("name").alias(name))
        gone = part if gone is None else gone.unionByName(part)
    return df.join(spread(gone.distinct()), ["source_id", "owner", name], "left_anti").select(*df.columns)


def filter_objects(cat: Catalog, cfg: ObjectFilter) -> Catalog:
    """Leave out kinds, types, tables and system owners; frames that are left out stay, without rows.

    What belongs to a table or view of an excluded type (columns, indexes, triggers) goes with it.
    """

    def build(kind: str) -> DataFrame:
        df = _filter_kind(kind, cat[kind], cfg)
        if cfg.exclude_types and kind in _BELONGS:
            df = _without_excluded(cat, df, _BELONGS[kind], cfg)
        return df

    return LazyFrames({kind: lambda kind=kind: build(kind) for kind in cat})
