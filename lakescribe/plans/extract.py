"""Complete extraction: every object kind of every source, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescribe.functions.scratch import cut
from lakescribe.model import Catalog, LazyFrames, empty
from lakescribe.operators import catalog_mssql as ms
from lakescribe.operators import catalog_mysql as my
from lakescribe.operators import catalog_oracle as ora
from lakescribe.operators import catalog_pg as pg
from lakescribe.operators.catalog_common import Frames, source_info
from lakescribe.operators.enrich import flatten_indexes, union_dialects
from lakescribe.operators.filters import ObjectFilter, Schemas, filter_objects

Normaliser = Callable[..., DataFrame]


def _mssql_columns(frames: Frames, schemas: Schemas = None) -> DataFrame:
    return ms.mssql_columns(frames, schemas).unionByName(ms.mssql_viewcols(frames, schemas))


# Kinds that are missing here do not exist in the dialect and stay empty.
NORMALISERS: dict[str, dict[str, Normaliser]] = {
    "postgresql": {
        "tables": pg.pg_tables, "columns": pg.pg_columns, "views": pg.pg_views, "indexes": pg.pg_indexes,
        "routines": pg.pg_routines, "sequences": pg.pg_sequences, "triggers": pg.pg_triggers,
    },
    "mysql": {
        "tables": my.mysql_tables, "columns": my.mysql_columns, "views": my.mysql_views,
        "indexes": my.mysql_indexes, "routines": my.mysql_routines, "triggers": my.mysql_triggers,
    },
    "oracle": {
        "tables": ora.ora_tables, "columns": ora.ora_columns, "views": ora.ora_views, "indexes": ora.ora_indexes,
        "routines": ora.ora_routines, "sequences": ora.ora_sequences, "triggers": ora.ora_triggers,
        "synonyms": ora.ora_synonyms,
    },
    "mssql": {
        "tables": ms.mssql_tables, "columns": _mssql_columns, "views": ms.mssql_views,
        "indexes": ms.mssql_indexes, "routines": ms.mssql_routines, "sequences": ms.mssql_sequences,
        "triggers": ms.mssql_triggers, "synonyms": ms.mssql_synonyms,
    },
}
KINDS = ("tables", "columns", "views", "indexes", "routines", "sequences", "triggers", "synonyms")


@dataclass(frozen=True)
class ExtractConfig:
    """Owners to keep (None: each dialect's default, '*': all), kinds and filters, and the run's time.

    staged: each kind of each dialect is written when it is first asked for, one after the other, in place of one plan whose
    joins all keep their shuffle files until the end. For reports that read most of a catalog.
    """

    schemas: Schemas = None
    objects: ObjectFilter = field(default_factory=ObjectFilter)
    extracted_at: datetime | None = None
    staged: bool = False


def extract_dialect(frames: Frames, dialect: str, cfg: ExtractConfig) -> Catalog:
    stamp = (cfg.extracted_at or datetime.now(timezone.utc)).astimezone(timezone.utc)
    micros = int(stamp.timestamp() * 1_000_000)
    known = NORMALISERS[dialect]

    def build(kind: str) -> DataFrame:
        if kind == "sources":
            df = source_info(frames, dialect, F.timestamp_micros(F.lit(micros)))
        elif kind not in known:
            return empty(frames["database_info"].sparkSession, kind)
        else:
            df = known[kind](frames, cfg.schemas)
        df = flatten_indexes(df, catalog["tables"]) if kind == "indexes" else df
        return cut(df, "zstd") if cfg.staged else df

    catalog = LazyFrames({kind: lambda kind=kind: build(kind) for kind in ("sources", *KINDS)})
    return catalog


def extract(frames_by_dialect: Mapping[str, Frames], cfg: ExtractConfig | None = None) -> Catalog:
    """All canonical frames of all dialects; nothing runs until a frame is used (if staged, until one is asked for)."""
    cfg = cfg or ExtractConfig()
    catalogs = [extract_dialect(frames, dialect, cfg) for dialect, frames in frames_by_dialect.items()]
    return filter_objects(union_dialects(catalogs), cfg.objects)
