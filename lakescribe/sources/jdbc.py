"""Catalog relations of live databases through Spark's JDBC source.

Each relation of each database is one scan, so a batch of databases is read in parallel by as many
tasks. Texts that only the server can evaluate are evaluated in the query; definitions and bodies are
never selected.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescribe.model import union_all
from lakescribe.sources.native import NATIVE, native_schema


@dataclass(frozen=True)
class JdbcSource:
    """One database. Credentials belong in `options` (user, password), the driver class too."""

    source_id: int
    url: str
    options: Mapping[str, str] = field(default_factory=dict, repr=False)


def _plain(table: str, relation: str, dialect: str, where: str = "") -> str:
    """SELECT of the relation's own columns; the usual case."""
    names = ", ".join(f.split(" ", 1)[0] for f in NATIVE[dialect][relation].split(", "))
    return f"SELECT {names} FROM {table}" + (f" WHERE {where}" if where else "")


def _queries() -> dict[str, dict[str, str]]:
    pg = {r: _plain(f"pg_catalog.{r}", r, "postgresql") for r in ("pg_namespace", "pg_am", "pg_language")}
    pg |= {
        "database_info": "SELECT 1 AS line, current_database()::text AS database_name, version() AS version",
        "pg_class": "SELECT oid::bigint, relname::text, relnamespace::bigint, relkind::text, relam::bigint, "
                    "pg_stat_get_live_tuples(oid) AS live_tuples FROM pg_catalog.pg_class",
        "pg_description": "SELECT objoid::bigint, objsubid, classoid::regclass::text AS classname, description "
                          "FROM pg_catalog.pg_description",
        "pg_attribute": "SELECT attrelid::bigint, attnum::int, attname::text, format_type(atttypid, atttypmod) "
                        "AS format_type, attnotnull, attisdropped FROM pg_catalog.pg_attribute",
        "pg_attrdef": "SELECT adrelid::bigint, adnum::int, pg_get_expr(adbin, adrelid) AS expr_text "
                      "FROM pg_catalog.pg_attrdef",
        "pg_index": "SELECT indexrelid::bigint, indrelid::bigint, indkey::int[] AS indkey, indisunique, indisprimary "
                    "FROM pg_catalog.pg_index",
        "pg_constraint": "SELECT conname::text, conrelid::bigint, confrelid::bigint, conkey::int[] AS conkey, "
                         "confkey::int[] AS confkey, contype::text FROM pg_catalog.pg_constraint",
        "views": "SELECT table_schema::text, table_name::text, is_updatable::text FROM information_schema.views",
        "pg_proc": "SELECT oid::bigint, proname::text, pronamespace::bigint, prokind::text, "
                   "pg_get_function_identity_arguments(oid) AS identity_args, format_type(prorettype, NULL) "
                   "AS return_type, prolang::bigint FROM pg_catalog.pg_proc",
        "pg_sequences": "SELECT c.oid::bigint AS seqrelid, s.min_value AS seqmin, s.max_value AS seqmax, "
                        "s.increment_by AS seqincrement, s.last_value, s.cycle AS seqcycle FROM pg_sequences s "
                        "JOIN pg_namespace n ON n.nspname = s.schemaname "
                        "JOIN pg_class c ON c.relnamespace = n.oid AND c.relname = s.sequencename",
        "pg_trigger": "SELECT oid::bigint, tgname::text, tgrelid::bigint, tgtype::int, tgenabled::text, tgisinternal "
                      "FROM pg_catalog.pg_trigger",
    }
    my = {r: _plain(f"information_schema.{r}", r, "mysql")
          for r in NATIVE["mysql"] if r != "database_info"}
    my["database_info"] = "SELECT 1 AS line, DATABASE() AS database_name, VERSION() AS version"
    ora = {r: _plain(r, r, "oracle") for r in NATIVE["oracle"] if r != "database_info"}
    ora |= {
        "database_info": "SELECT ROWNUM AS line, SYS_CONTEXT('USERENV', 'DB_NAME') AS database_name, "
                         "BANNER AS version FROM V$VERSION",
        "all_tables": "SELECT t.owner, t.table_name, t.num_rows, o.created, o.last_ddl_time FROM all_tables t "
                      "LEFT JOIN all_objects o ON o.owner = t.owner AND o.object_name = t.table_name "
                      "AND o.object_type = 'TABLE'",
    }
    sys = {r: _plain(f"sys.{r}", r, "mssql") for r in (
        "schemas", "tables", "partitions", "types", "indexes", "index_columns", "foreign_keys",
        "foreign_key_columns", "procedures", "parameters", "synonyms")}
    sys |= {
        "database_info": "SELECT 1 AS line, DB_NAME() AS database_name, @@VERSION AS version",
        "columns": _plain("sys.columns", "columns", "mssql"),
        "extended_properties": "SELECT class, major_id, minor_id, name, CAST(value AS nvarchar(max)) AS value "
                               "FROM sys.extended_properties",
        "default_constraints": "SELECT parent_object_id, parent_column_id, definition AS default_text "
                               "FROM sys.default_constraints",
        "views": "SELECT v.object_id, v.schema_id, v.name, CAST(CASE WHEN EXISTS (SELECT 1 FROM sys.sql_modules m "
                 "WHERE m.object_id = v.object_id AND m.definition LIKE '%INSTEAD OF%') THEN 1 ELSE 0 END AS bit) "
                 "AS has_instead_of FROM sys.views v",
        "sequences": "SELECT object_id, schema_id, name, CAST(minimum_value AS decimal(38,0)) AS minimum_value, "
                     "CAST(maximum_value AS decimal(38,0)) AS maximum_value, CAST(increment AS decimal(38,0)) "
                     "AS increment, CAST(current_value AS decimal(38,0)) AS current_value, is_cycling "
                     "FROM sys.sequences",
        "triggers": "SELECT object_id, parent_id, name, "
                    + ", ".join(
                        f"CAST(OBJECTPROPERTY(object_id, 'ExecIs{p}Trigger') AS bit) AS is_{column}"
                        for p, column in (("Insert", "insert"), ("Update", "update"), ("Delete", "delete"),
                                          ("After", "after"), ("InsteadOf", "instead_of")))
                    + ", is_disabled, is_ms_shipped FROM sys.triggers",
    }
    return {"postgresql": pg, "mysql": my, "oracle": ora, "mssql": sys}


QUERIES = _queries()


def read_catalog_jdbc(
    spark: SparkSession,
    sources: Iterable[JdbcSource],
    dialect: str,
    queries: Mapping[str, str] | None = None,
    fetch_size: int = 10_000,
) -> dict[str, DataFrame]:
    """Native frames of the given databases, each row with its source_id.

    For a fleet, use land_fleet, which lands a batch of databases at a time: a plan has one scan per
    database and relation, and each scan asks its database for the query's schema when it is built.
    """
    sources = list(sources)
    if not sources:
        raise ValueError("no sources")
    frames = {}
    for relation, query in (queries or QUERIES[dialect]).items():
        schema = native_schema(dialect, relation)
        scans = []
        for source in sources:
            scan = (
                spark.read.format("jdbc").option("url", source.url).option("query", query)
                .option("fetchsize", fetch_size).options(**source.options).load()
            )
            scans.append(
                scan.select(F.lit(source.source_id).cast("long").alias("source_id"),
                            *[scan[f.name].cast(f.dataType).alias(f.name) for f in schema.fields[1:]])
            )
        frames[relation] = union_all(scans)
    return frames
