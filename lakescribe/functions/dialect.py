"""Names of the four supported database dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Supported dialects, accepted aliases, labels in reports.
DIALECTS = ("oracle", "mysql", "postgresql", "mssql")
ALIASES = {"postgres": "postgresql", "pg": "postgresql", "sqlserver": "mssql"}
LABELS = {"oracle": "Oracle", "mysql": "MySQL", "postgresql": "PostgreSQL", "mssql": "MSSQL"}


def normalise_dialect(raw: Column) -> Column:
    """Canonical dialect name, null when it is not supported."""
    name = F.lower(F.trim(raw))
    known = F.when(name.isin(*DIALECTS), name)
    for alias, dialect in ALIASES.items():
        known = known.when(name == alias, F.lit(dialect))
    return known


def split_dialects(sources: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """Sources with their dialect, and those whose dialect is not supported with the reason."""
    named = sources.withColumn("dialect", normalise_dialect(F.col(raw)))
    reason = F.concat(F.lit("unsupported database type: "), F.lower(F.trim(F.col(raw))))
    return (
        named.where(F.col("dialect").isNotNull()),
        named.where(F.col("dialect").isNull()).withColumn("error", reason),
    )
