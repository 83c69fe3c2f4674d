from lakescribe.sources.catalog import read_catalog
from lakescribe.sources.fleet import Database, read_fleet
from lakescribe.sources.jdbc import JdbcSource, read_catalog_jdbc
from lakescribe.sources.lake import read_tables
from lakescribe.sources.snapshot import (
    clean_snapshot,
    compact_snapshot,
    land_databases,
    land_fleet,
    read_snapshot,
    snapshot_changes,
    write_snapshot,
)

__all__ = [
    "Database", "JdbcSource", "clean_snapshot", "compact_snapshot", "land_databases", "land_fleet", "read_catalog", "read_catalog_jdbc",
    "read_fleet", "read_snapshot", "read_tables", "snapshot_changes", "write_snapshot",
]
